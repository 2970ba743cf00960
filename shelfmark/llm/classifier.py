"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded; a
gated attention (tanh times sigmoid) weighs the passages; the weighted sum of their encodings
gives the score. Encoder, attention and output are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, texts, with_columns_from_text

PASSAGE = 64  # words
PIECE = 1 << 20  # bytes of text encoded at a time
SAMPLE = 6000  # labelled documents that are learned from, at most
BAG = 32  # evenly spaced passages of one of these, at most
THRESHOLD = 0.7
HIDDEN, GATE, BATCH, RATE, DECAY = 16, 8, 64, 0.01, 1e-3
EPOCHS, STEPS = 20, 1500  # at least so many passes, and at least so many steps

FEATURES = ["words", "word_bytes", "longest", "distinct", "same_as_last", "pairs_repeated",
            "symbols", "punctuation", "exclaims", "upper", "digits", "beyond_ascii", "newlines",
            "short", "no_letter", "closed"]

# Byte classes, one bit each.
_SPACE, _SYMBOL, _PUNCT, _BANG, _UPPER, _LETTER, _DIGIT, _HIGH, _LINE = (1 << i for i in range(9))


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for bit, chars in ((_SPACE, b" \t\n\x0b\x0c\r"), (_SYMBOL, b"#*$%&|<>"),
                       (_PUNCT, b".,;:!?\"'()[]{}-_/\\@^~`+="), (_BANG, b"!"), (_LINE, b"\n"),
                       (_UPPER, range(65, 91)), (_LETTER, [*range(65, 91), *range(97, 123)]),
                       (_DIGIT, range(48, 58)), (_HIGH, range(128, 256))):
        table[list(chars)] |= bit
    return table


_CLASS = _classes()


def _encode_piece(text: bytes) -> np.ndarray:
    """One row of FEATURES for every passage of a text; none for a text without words."""
    data = np.frombuffer(text, np.uint8)
    kinds = _CLASS[data]
    blank = np.concatenate([[True], (kinds & _SPACE) > 0, [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    n = len(starts)
    if not n:
        return np.empty((0, len(FEATURES)))
    heads = np.arange(0, n, PASSAGE)
    at = starts[heads]
    at[0] = 0
    words = np.diff(np.append(heads, n)).astype(float)
    length = (ends - starts).astype(float)

    def of_bytes(bit: int) -> np.ndarray:
        return np.add.reduceat((kinds & bit) > 0, at, dtype=np.int32)

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, heads)

    # A word's hash, whatever its place: bytes times powers by their position in the word.
    inside = ~blank[1:-1]
    place = np.arange(len(data)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    mixed = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023],
                     np.uint64(0))
    key = np.add.reduceat(mixed, starts) if n else mixed[:0]
    group = np.repeat(np.arange(len(heads)), words.astype(int)).astype(np.uint64)
    head = np.zeros(n, bool)
    head[heads] = True
    after = np.empty_like(key)
    after[0], after[1:] = 0, key[:-1]

    def distinct(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, groups))
        v, g = values[order], groups[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
        return np.bincount(g[new].astype(int), minlength=len(heads))

    letter = np.add.reduceat((kinds & (_LETTER | _HIGH)) > 0, starts, dtype=np.int32)
    last = kinds[ends - 1]
    letters = np.maximum(of_bytes(_LETTER), 1)
    size = np.maximum(of_words(length), 1)
    pairs = key[~head] * np.uint64(0x9E3779B97F4A7C15) ^ after[~head]
    n_pairs = np.maximum(words - 1, 1)
    return np.stack([
        np.log1p(words), of_words(length) / words, np.log(np.maximum.reduceat(length, heads)),
        distinct(key, group) / words, of_words((key == after) & ~head) / words,
        1 - distinct(pairs, group[~head]) / n_pairs, of_bytes(_SYMBOL) / words,
        of_bytes(_PUNCT) / words, of_bytes(_BANG) / words, of_bytes(_UPPER) / letters,
        of_bytes(_DIGIT) / size, of_bytes(_HIGH) / size, of_bytes(_LINE) / words,
        of_words(length < 3) / words, of_words(letter == 0) / words,
        of_words((last & _PUNCT) > 0) / words], 1)


_POWERS = np.cumprod(np.full(1024, 0x100000001B3, np.uint64), dtype=np.uint64)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space where there is any."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b, at, at + PIECE) for b in (b" ", b"\n"))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: bytes) -> Iterator[np.ndarray]:
    """Feature rows of the passages of a text, piece by piece; one row of zeros if the text
    has no words."""
    some = False
    for piece in pieces(text):
        rows = _encode_piece(piece)
        if len(rows):
            some = True
            yield rows
    if not some:
        yield np.zeros((1, len(FEATURES)))


@dataclass
class Model:
    """Weights of encoder (w, b), attention (v, u, a) and output (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings, and attention logits (bounded, so they need no shift)."""
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        gate = np.tanh(h @ self.p["v"]) / (1 + np.exp(-(h @ self.p["u"])))
        return h, gate @ self.p["a"]

    def score(self, text: bytes) -> float:
        total, weighed = 0.0, np.zeros(HIDDEN)
        for rows in encode(text):
            h, logit = self.passages(rows)
            weight = np.exp(np.clip(logit, -30, 30))
            total += weight.sum()
            weighed += weight @ h
        logit = float(weighed / total @ self.p["c"] + self.p["d"][0])
        return 1 / (1 + float(np.exp(-np.clip(logit, -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Learn from bags (one array of passage features each) and their labels 0 or 1. Without
    both classes the score is constant: the share of ones, or one half."""
    rng = np.random.default_rng(seed)
    d = len(FEATURES)
    p = {"w": rng.normal(0, d ** -.5, (d, HIDDEN)), "b": np.zeros(HIDDEN),
         "v": rng.normal(0, HIDDEN ** -.5, (HIDDEN, GATE)),
         "u": rng.normal(0, HIDDEN ** -.5, (HIDDEN, GATE)), "a": rng.normal(0, .3, GATE),
         "c": rng.normal(0, HIDDEN ** -.5, HIDDEN), "d": np.zeros(1)}
    if len(bags) == 0 or labels.min() == labels.max():
        share = labels.mean() if len(bags) else .5
        p["c"][:] = 0
        p["d"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(d), np.ones(d), p)
    rows = np.concatenate(bags)
    model = Model(rows.mean(0), rows.std(0) + 1e-3, p)
    m, v, step = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}, 0
    epochs = max(EPOCHS, -(-STEPS // -(-len(bags) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            grads = _gradients(model, [bags[i] for i in chosen], labels[chosen])
            step += 1
            rate = RATE * .5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k] = .9 * m[k] + .1 * g
                v[k] = .999 * v[k] + .001 * g * g
                p[k] -= rate * (m[k] / (1 - .9 ** step)) / (np.sqrt(v[k] / (1 - .999 ** step)) + 1e-8)
    return model


def _gradients(model: Model, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy, by the chain rule through output, attention and encoder."""
    p = model.p
    heads = np.cumsum([0, *(len(b) for b in bags[:-1])])
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    x = np.clip((np.concatenate(bags) - model.mean) / model.scale, -5, 5)
    h = np.tanh(x @ p["w"] + p["b"])
    left, right = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    weight = np.exp((left * right) @ p["a"])
    weight /= np.add.reduceat(weight, heads)[bag]
    z = np.add.reduceat(weight[:, None] * h, heads)
    error = (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30))) - labels) / len(bags)
    dz = error[:, None] * p["c"]
    dweight = (h * dz[bag]).sum(1)
    dlogit = weight * (dweight - np.add.reduceat(weight * dweight, heads)[bag])
    dleft = dlogit[:, None] * p["a"] * right * (1 - left ** 2)
    dright = dlogit[:, None] * p["a"] * left * right * (1 - right)
    dh = weight[:, None] * dz[bag] + dleft @ p["v"].T + dright @ p["u"].T
    dx = dh * (1 - h ** 2)
    return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dleft, "u": h.T @ dright,
            "a": (left * right).T @ dlogit, "c": z.T @ error, "d": np.array([error.sum()])}


def held_out(doc_id=None):
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality).

    At most SAMPLE labelled rows that are not held out are used, the first by a hash of their
    id, and at most BAG evenly spaced passages of each; both bounds are parameters of the
    module. Rows without id or label are left out; of several labels the lowest counts."""
    sample = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).groupBy(
        "doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bags = []
        for text in texts(batch):
            rows = np.concatenate(list(encode(text)))
            if len(rows) > BAG:
                rows = rows[np.linspace(0, len(rows) - 1, BAG).astype(int)]
            bags.append(rows.astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(bags, pa.binary())],
            ["doc_id", "quality", "bag"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # SAMPLE ids
    found = map_batches(chosen, f"doc_id {kind}, quality int, bag binary", work).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "bag", "quality"))))
    bags = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)).astype(float)
            for _, b, _ in rows]
    return fit(bags, np.array([float(q) for *_, q in rows]))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(_row, score): the columns ``keep`` of every row as a struct, and the score of its whole
    text. The texts pass once and are not shuffled."""
    return with_columns_from_text(docs, keep, [("score", "double")], lambda found: [
        pa.array([model.score(t) for t in found], pa.float64())])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents (doc_id, text).

    The score is the probability of label 1, from the text only; predicted is 1 from 0.7 on. A
    null or empty text is a bag with one empty passage and is scored too. A null id counts as
    not held out. Repeated rows get the same score, other columns are ignored, an empty table
    gives no rows.
    """
    rows = scored(docs, learn(docs, labels), ["doc_id"])
    return rows.select("_row.doc_id", "score").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their own columns."""
    rows = scored(docs, learn(docs, labels), docs.columns)
    return rows.where(F.col("score") >= THRESHOLD).select("_row.*")
