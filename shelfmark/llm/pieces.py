"""Unigram segmentation with the pieces of a SentencePiece file: token counts, ids and texts.

The text gets one space in front and spaces become U+2581, nothing else is changed. A
segmentation into pieces scores the sum of the pieces' scores, the best one wins, and of equal
ones the one whose last piece is longer. A character without a piece scores ten less than the
worst piece and becomes its UTF-8 bytes. No piece holds U+2581 behind another character, so
every segmentation has a boundary in front of each run of it; the parts between are the
pre-tokens.

The only public file at hand comes from pair merging; its scores are taken as unigram scores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import map_stream, texts

MARK = "▁"
UNKNOWN = 10.0  # an unknown character scores so much less than the worst piece
CACHE = 250_000  # pre-tokens that a task remembers
SLICE = 2 << 20  # bytes of text whose pre-tokens are worked on together


class Pieces:
    """The pieces of a file: ids and scores, the longest, the ids of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece, out = model.id_to_piece(i), b""
            if model.is_byte(i):
                out = bytes([int(piece[3:5], 16)])
                self.bytes[out[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.known[piece] = (model.get_score(i), i)
                out = piece.replace(MARK, " ").encode()
            self.out.append(out)
        if any(MARK in p.lstrip(MARK) for p in self.known):
            raise ValueError("pieces across words are not supported")
        self.longest = max(map(len, self.known))
        self.unknown = min(s for s, _ in self.known.values()) - UNKNOWN
        lengths: dict[str, set[int]] = {}
        for piece in self.known:
            if len(piece) > 2:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        # By the last three characters: the lengths that pieces with such an end have.
        self.lengths = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in lengths.items()}


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens: runs of U+2581 and what follows each, up to the next run."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, marks = [], 0
    for part in parts:  # several spaces in a row: the further ones belong to the next part
        if part:
            out.append(MARK * marks + part if marks else part)
            marks = 0
        else:
            marks += 1
    return out + [MARK * (marks - 1)] * (marks > 0)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """A batch in slices of about SLICE bytes of text, with the pre-tokens of every row."""
    start, size, out = 0, 0, []
    for i, text in enumerate(texts(batch)):
        out.append(pre_tokens(text.decode("utf-8", "replace")))
        size += len(text)
        if size >= SLICE or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), out
            start, size, out = i + 1, 0, []


class Memory(dict):
    """What is known of pre-tokens (their first U+2581 not written), of bounded size."""

    def learn(self, rows: list[list[str]], work) -> None:
        """Make sure that all pre-tokens of ``rows`` are known; ``work`` gives the values of
        sorted new ones."""
        wanted: set[str] = set()
        for row in rows:
            wanted.update(row)
        if len(self) > CACHE:  # what is wanted again is likely to be frequent
            for token in self.keys() - wanted:
                del self[token]
        self.update(work(sorted(wanted - self.keys())))


def trie_counts(tokens: list[str], pieces: Pieces) -> Iterator[tuple[str, int]]:
    """(pre-token, number of tokens) of sorted distinct pre-tokens.

    They form a trie, which is walked depth first: sorted order is the order of that walk. A
    node is a prefix and holds the best score of its segmentation and that segmentation's
    length; it is worked out once, from the nodes above it, for all pre-tokens that share it,
    and is kept as long as the walk is below it. The ends of pre-tokens give their counts.
    """
    known, lengths, unknown, short = pieces.known, pieces.lengths, pieces.unknown, (2, 1)
    last, scores, counts = MARK, [0.0], [0]
    for token in tokens:
        text = MARK + token
        shared = min(common_prefix(last, text), len(scores) - 1)
        del scores[shared + 1:], counts[shared + 1:]
        for end in range(shared + 1, len(text) + 1):
            best, count = -float("inf"), 0
            for n in lengths.get(text[end - 3:end] if end > 2 else text[:end], short):
                if n <= end:
                    piece = known.get(text[end - n:end])
                    if piece is not None:
                        if scores[-n] + piece[0] > best:
                            best, count = scores[-n] + piece[0], counts[-n] + 1
                    elif n == 1 and scores[-1] + unknown > best:
                        best = scores[-1] + unknown
                        count = counts[-1] + len(text[end - 1].encode())
            scores.append(best)
            counts.append(count)
        last = text
        yield token, counts[-1]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of documents (doc_id, text).

    Every task counts the distinct pre-tokens of a bounded stretch of rows by their trie and
    remembers a bounded number of them; nothing is shuffled. A null or empty text has none.
    Repeated rows are counted alike, null ids come back, other columns are ignored, an empty
    table gives no rows.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = pieces_of(path), Memory()
        for batch in batches:
            for part, rows in slices(batch):
                counts.learn(rows, lambda new: trie_counts(new, pieces))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, rows), pa.int64()),
                     pa.array([sum(map(counts.__getitem__, r)) for r in rows], pa.int64())],
                    ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_stream(docs.select("doc_id", "text"),
                      f"doc_id {kind}, n_pretokens bigint, n_tokens bigint", work)


class Window:
    """The best segmentation of a text that arrives bit by bit.

    Whatever follows starts from one of the latest ends, as many as the longest piece has
    characters. As soon as the paths back from all of these run through one boundary, the ids
    before it are final: they are given out, and text, scores and backpointers before it go.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # since the last common boundary
        self.final = False  # whether ids have been given out
        self.score: list[float] = [0.0]
        self.back: list[tuple[int, int]] = [(0, 0)]  # by end: length and id of the last piece

    def keep(self, n: int) -> None:
        """Take back what follows the first ``n`` characters; before ids are given out."""
        self.text = self.text[:n]
        del self.score[n + 1:], self.back[n + 1:]

    def extend(self, more: str) -> list[int]:
        """Add characters; the ids that are final now."""
        known, lengths, unknown = self.pieces.known, self.pieces.lengths, self.pieces.unknown
        score, back, out, short = self.score, self.back, [], (2, 1)
        turn = 2 * self.pieces.longest
        at = len(self.text)
        text = self.text + more
        start = 0  # of the window in ``text``; scores and backpointers begin there
        for end in range(at + 1, len(text) + 1):
            best, last, room = -float("inf"), (1, -1), end - start
            for n in lengths.get(text[end - 3:end] if end > 2 else text[:end], short):
                if n <= room:
                    found = known.get(text[end - n:end])
                    if found is not None:
                        if score[-n] + found[0] > best:
                            best, last = score[-n] + found[0], (n, found[1])
                    elif n == 1 and score[-1] + unknown > best:
                        best, last = score[-1] + unknown, (1, -1)
            score.append(best)
            back.append(last)
            if room % turn == 0:
                self.text = text[start:end]
                common = self.meeting()
                if common:
                    out += self.ids(common)
                    self.final = True
                    start += common
                    del score[:common], back[:common]
        self.text = text[start:]
        return out

    def meeting(self) -> int:
        """The furthest boundary that the paths back from the latest ends share."""
        end = len(self.text)
        alive = set(range(max(0, end - self.pieces.longest + 1), end + 1))
        while len(alive) > 1:  # step back from the furthest until the paths meet
            alive.remove(furthest := max(alive))
            alive.add(furthest - self.back[furthest][0])
        return alive.pop()

    def ids(self, end: int) -> list[int]:
        """The ids up to a boundary."""
        back, out = self.back, []
        while end:
            n, piece = back[end]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.pieces.bytes[b] for b in reversed(self.text[end - 1].encode())]
            end -= n
        out.reverse()
        return out


def viterbi(chars: Iterable[str], pieces: Pieces) -> Iterator[int]:
    """Ids of the best segmentation of a stream of characters, as they become final."""
    window = Window(pieces)
    for some in chars:
        yield from window.extend(some)
    yield from window.ids(len(window.text))


def packed_ids(tokens: list[str], pieces: Pieces) -> Iterator[tuple[str, bytes]]:
    """(pre-token, packed ids) of sorted distinct pre-tokens. A boundary stands in front of
    each, so they are segmented one by one; a prefix shared with the one before stays in the
    window."""
    window = Window(pieces)
    for token in tokens:
        text = MARK + token
        if window.final:
            window = Window(pieces)
        window.keep(common_prefix(window.text, text))
        ids = window.extend(text[len(window.text):])
        ids += window.ids(len(window.text))
        yield token, struct.pack(f"<{len(ids)}I", *ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of documents (doc_id, text); ids are packed as unsigned
    little-endian 32-bit numbers (``numpy.frombuffer(ids, '<u4')``).

    A null or empty text has no ids. Repeated rows are encoded alike, null ids come back,
    other columns are ignored, an empty table gives no rows. Nothing is shuffled.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids = pieces_of(path), Memory()
        for batch in batches:
            for part, rows in slices(batch):
                ids.learn(rows, lambda new: packed_ids(new, pieces))
                packed = [b"".join(map(ids.__getitem__, r)) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_stream(docs.select("doc_id", "text"), f"doc_id {kind}, ids binary", work)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the texts of packed ids. U+2581 comes back as a space, the space
    that encoding put in front goes, bytes that are not UTF-8 become U+FFFD; null ids give an
    empty text, control ids nothing."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pieces_of(path).out
        for batch in batches:
            found = []
            for packed in batch.column("ids").to_pylist():
                ids = np.frombuffer(packed or b"", "<u4").tolist()
                text = b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace")
                found.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(found, pa.string())],
                ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_stream(encoded.select("doc_id", "ids"), f"doc_id {kind}, ids binary, text string",
                      work)
