"""Order-preserving packing of tokens into sequences by dynamic programming.

The documents of a partition are one stream of ids. Sequences are windows of it, cut at the
end of a document or of a sentence where that costs little. The plan minimises padding plus
penalties: with f(j) the least cost of a plan whose last cut is at place p(j),

    f(j) = penalty(j) + min over p(j) - p(i) <= LENGTH of f(i) + LENGTH - (p(j) - p(i)),

a sliding-window minimum of f(i) + p(i), kept in a monotone queue, so every place costs
constant time. A window whose length is a power of two needs no padding.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import map_stream, texts

LENGTH = 2048
END = 1  # the id behind every document
STRIDE = 48  # a longer stretch without the end of a sentence can be cut every so many ids
PENALTY_SEQUENCE, PENALTY_SENTENCE, PENALTY_WORD = 4, 1, 8
BLOCK = 1 << 19  # ids planned at a time
# Window lengths that need no padding; the short ones only at the end of a stream.
POWERS = [1 << k for k in range(LENGTH.bit_length() - 1)]
LONG_POWERS = [256, 512, 1024]
BLANKS = 100_000  # white space in a row from which on it is encoded by itself
# Unicode white space, as the pattern of the tokenizer has it; tried at the start of a run only.
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_RUN = re.compile(f"(?<!{_SPACE}){_SPACE}{{{BLANKS},}}+")


def _bytes_of(token: str) -> bytes:
    """The bytes that a byte-level token stands for: printable ones stand for themselves, the
    others for the characters from U+0100 on, in order."""
    return bytes(_BYTE[c] for c in token)


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _PLAIN} | {
    chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class Tokens:
    """Ids of texts by a byte-level pair-merging tokenizer file. Its merges are in the order of
    its ids, so its ids serve as ranks for the quicker of the two libraries, which then gives
    the same ids. That one fails on about a million white-space characters in a row, so long
    runs go to the other."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {_bytes_of(t): i for t, i in vocabulary.items() if all(c in _BYTE for c in t)}
        special = "<|endoftext|>".encode()  # in a text it is ordinary text
        self.encoding = tiktoken.Encoding(
            path, pat_str=PATTERN, special_tokens={},
            mergeable_ranks={b: i for b, i in ranks.items() if b != special})
        size = max(ranks.values()) + 1
        raw = [b""] * size
        for token, i in ranks.items():
            raw[i] = token
        self.ends = np.array([t.endswith((b".", b"!", b"?")) for t in raw])
        self.line = np.array([t.endswith(b"\n") for t in raw])
        self.starts = np.array([t.startswith((b" ", b"\n")) for t in raw])

    def packed(self, text: str) -> bytes:
        out, at = [], 0
        for run in _RUN.finditer(text) if len(text) >= BLANKS else ():
            # The pattern takes a run as one, without its last character if a text follows.
            end = run.end() - (run.end() < len(text))
            out += [self.encoding.encode_ordinary(text[at:run.start()]),
                    self.tokenizer.encode(text[run.start():end], add_special_tokens=False).ids]
            at = end
        out.append(self.encoding.encode_ordinary(text[at:] if at else text))
        return b"".join(np.array(ids, "<u4").tobytes() for ids in out)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places behind a sentence or a line."""
        return np.flatnonzero((self.ends[ids[:-1]] & self.starts[ids[1:]])
                              | self.line[ids[:-1]]) + 1


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def plan(places: list[int], penalties: list[int], open_end: bool) -> list[int]:
    """The places of the cuts of a cheapest plan, from the sorted candidate ``places`` (the
    first is 0, no gap exceeds LENGTH). The last cut is at the last place, or with
    ``open_end`` at the cheapest one of the last LENGTH."""
    n, total = len(places), places[-1]
    tail = total if open_end else max(0, total - LENGTH)
    cost, back, value = [0] * n, [0] * n, [0] * n
    index = {p: i for i, p in enumerate(places)}
    queue = deque([0])
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - LENGTH:
            queue.popleft()
        i = queue[0]
        best = value[i] + LENGTH - p
        for power in LONG_POWERS if p < tail else POWERS:
            k = index.get(p - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + penalties[j] + PENALTY_SEQUENCE
        back[j] = i
        value[j] = best = best + p
        while queue and value[queue[-1]] > best:
            queue.pop()
        queue.append(j)
    last = n - 1
    if open_end:
        last = min((i for i in range(n) if places[i] > max(0, total - LENGTH)),
                   key=lambda i: (cost[i], -i))
    cuts = []
    while last:
        cuts.append(places[last])
        last = back[last]
    return cuts[::-1]


@dataclass
class Part:
    """A run of ids of one document."""

    doc_id: object
    start: int
    doc_tokens: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4


def parts_of(doc_id, packed: bytes) -> Iterator[Part]:
    """A document, from the packed ids of its text, in parts of at most BLOCK ids."""
    packed += np.array([END], "<u4").tobytes()
    for start in range(0, len(packed) // 4, BLOCK):
        yield Part(doc_id, start, len(packed) // 4, packed[4 * start:4 * (start + BLOCK)])


@dataclass
class Packer:
    """Plans blocks of parts; what a block leaves open goes on in the next one."""

    tokens: Tokens
    first_sequence: int
    parts: list[Part] = field(default_factory=list)
    size: int = 0
    sequences: int = 0

    def add(self, part: Part) -> list[tuple]:
        self.parts.append(part)
        self.size += len(part)
        return self.flush(open_end=True) if self.size >= BLOCK else []

    def candidates(self, heads: np.ndarray, open_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places that can be cut, and their penalties."""
        penalty = np.full(self.size + 1, -1)
        ends = self.tokens.sentence_ends(np.frombuffer(b"".join(p.ids for p in self.parts), "<u4"))
        edges = np.unique(np.concatenate([ends, heads]))
        gaps = np.diff(edges)
        for at, gap in zip(edges[:-1][gaps > STRIDE].tolist(), gaps[gaps > STRIDE].tolist()):
            penalty[at + STRIDE:at + gap:STRIDE] = PENALTY_WORD
        if not open_end:  # any place may be cut at the very end, so that little is padded there
            penalty[max(1, self.size - LENGTH):] = PENALTY_WORD
        penalty[ends] = PENALTY_SENTENCE
        last = [p.start + len(p) == p.doc_tokens for p in self.parts]
        penalty[heads[1:]] = np.where(last, 0, PENALTY_WORD)
        penalty[0] = 0
        places = np.flatnonzero(penalty >= 0)
        return places, penalty[places]

    def flush(self, open_end: bool) -> list[tuple]:
        """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
        if not self.size:
            return []
        heads = np.cumsum([0, *(len(p) for p in self.parts)])
        places, penalties = self.candidates(heads, open_end)
        out, which, at, heads = [], 0, 0, heads.tolist()
        for cut in plan(places.tolist(), penalties.tolist(), open_end):
            offset = 0
            while at < cut:
                part, head = self.parts[which], heads[which]
                upto = min(cut, head + len(part))
                out.append((part.doc_id, part.start + at - head, upto - at,
                            part.ids[4 * (at - head):4 * (upto - head)], part.doc_tokens,
                            self.first_sequence + self.sequences, offset))
                offset += upto - at
                at = upto
                which += at == head + len(part)
            self.sequences += 1
        rest = self.parts[which:]
        if rest:
            p, done = rest[0], at - heads[which]
            rest[0] = Part(p.doc_id, p.start + done, p.doc_tokens, p.ids[4 * done:])
        self.parts, self.size = rest, self.size - at
        return out


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most LENGTH ids: (doc_id, start,
    length, ids, doc_tokens, sequence_id, offset), ids packed as unsigned little-endian 32-bit
    numbers.

    A document is the ids of its text and END; a null or empty text is END alone. Documents
    keep the order they have in their partition of the table, every partition is packed for
    itself as a stream with bounded memory, and nothing is shuffled. Sequence ids are unique;
    the number of a partition is in their upper bits. Repeated rows are packed repeatedly, null
    ids come back, other columns are ignored, an empty table gives no rows.
    """
    from pyspark import TaskContext

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, of_id = tokens_of(path), []
        packer = Packer(tokens, TaskContext.get().partitionId() << 40)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [of_id[0], *([pa.int64()] * 2), pa.binary(), *([pa.int64()] * 3)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            of_id[:] = [batch.column("doc_id").type]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                for part in parts_of(doc_id, tokens.packed(text.decode("utf-8", "replace"))):
                    if rows := packer.add(part):
                        yield batch_of(rows)
        if rows := packer.flush(open_end=False):
            yield batch_of(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_stream(
        docs.select("doc_id", "text"), f"doc_id {kind}, start bigint, length bigint, ids binary, "
        "doc_tokens bigint, sequence_id bigint, offset bigint", work)
