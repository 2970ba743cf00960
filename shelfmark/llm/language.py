"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into words of letters; every word, with a boundary mark on
each side, gives its character n-grams of one to ``GRAMS`` code points. Each n-gram is
hashed into one of ``BUCKETS`` rows of an embedding table; a text's vector is the mean of
its rows, and a linear softmax over it gives the languages. Embeddings and softmax are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled
documents (``PER_LANG`` rows and ``BYTES_PER_LANG`` bytes of each lang at most, drawn by a
hash of id and text, never by position). A temperature fitted on a calibration share of
the sample calibrates the scores, and a rejection bound is chosen there as the least
score above which calibration rows are right at ``PRECISION`` or more.

Hashing is vectorised over the code points of a whole text (no prefix is taken, and no
Python loop runs per n-gram); prediction is a ``mapInArrow`` over all documents with the
model broadcast. The model's size is fixed by ``BUCKETS``, ``DIM`` and the number of langs,
not by the data.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.0 and not
accepted; rows of null lang are never learned from; repeated rows count once in the
sample; extra columns are not read; an empty table gives no row; with no labelled row the
model knows no lang, and every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, texts

BUCKETS = 1 << 18
DIM = 24
GRAMS = 4
PER_LANG = 2000  # labelled rows of one lang learned from, at most
BYTES_PER_LANG = 6 << 20  # and their text bytes, at most
EPOCHS = 6
RATE = 0.2
CALIBRATION = 5  # one in so many sampled rows calibrates instead of training
PRECISION = 0.98
SEED = 7
HELD_OUT = 2  # crc32(doc_id as text) % 4 == 2 is held out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point of the basic plane: is it a letter, and its lower case."""
    letter = np.zeros(1 << 16, dtype=bool)
    lower = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if unicodedata.category(ch).startswith("L"):
            letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return letter, lower


def grams(text: str | None) -> np.ndarray:
    """Bucket numbers of all n-grams of all words of a whole text (may repeat)."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter, lower = _tables()
    small = cps < (1 << 16)
    is_letter = np.where(small, letter[np.minimum(cps, 0xFFFF)], False)
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    seq = np.where(is_letter, np.where(small, lower[np.minimum(cps, 0xFFFF)], cps), 0).astype(np.uint64)
    edge = np.zeros(1, dtype=np.uint64)
    seq = np.concatenate((edge, seq, edge))  # 0 marks a boundary
    sep = seq == 0
    out = []
    n = len(seq)
    for g in range(1, GRAMS + 1):
        if n < g:
            break
        h = np.full(n - g + 1, np.uint64(1469598103934665603), dtype=np.uint64)
        inner = np.zeros(n - g + 1, dtype=np.int64)
        for j in range(g):
            h = (h ^ seq[j:n - g + 1 + j]) * np.uint64(1099511628211)
            if 0 < j < g - 1:
                inner += sep[j:n - g + 1 + j]
        ok = inner == 0  # no boundary but at its ends
        if g == 1:
            ok &= ~sep[: n]
        elif g == 2:  # a letter at least
            ok &= ~(sep[:n - 1] & sep[1:])
        h = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g)
        out.append((h >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def bag(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares: the mean of the rows without repeating them."""
    ids, counts = np.unique(ids, return_counts=True)
    return ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # BUCKETS x DIM
    weight: np.ndarray  # DIM x langs
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ids, weights = bag
        return (weights @ self.embed[ids]) @ self.weight + self.bias

    def probabilities(self, bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = self.logits(bag) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str],
        seed: int = SEED) -> Model:
    """Embeddings and softmax by stochastic gradient descent, one text a step."""
    rnd = np.random.default_rng(seed)
    model = Model(langs, (rnd.standard_normal((BUCKETS, DIM), dtype=np.float32) * 0.1),
                  np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32))
    steps = EPOCHS * len(bags)
    done = 0
    for _ in range(EPOCHS):
        for i in rnd.permutation(len(bags)):
            rate = RATE * (1 - done / max(steps, 1)) + 1e-3
            done += 1
            ids, weights = bags[i]
            if len(ids) == 0:
                continue
            x = weights @ model.embed[ids]
            z = x @ model.weight + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad_x = model.weight @ p
            model.weight -= rate * np.outer(x, p)
            model.bias -= rate * p
            model.embed[ids] -= rate * np.outer(weights, grad_x)  # ids are distinct
    return model


def calibrate(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Temperature by least log loss on calibration rows; the rejection bound from them."""
    usable = [(b, y) for b, y in zip(bags, labels) if len(b[0])]
    if not usable:
        return model
    logits = np.array([model.logits(b) for b, _ in usable])
    truth = np.array([y for _, y in usable])
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 60)):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    z = logits / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ok = np.nonzero(precision >= PRECISION)[0]
    model.reject = float(score[order][ok[-1]]) if len(ok) else 1.0
    return model


def held_out(doc_id=None):
    """crc32 of the id as text, remainder 2 of 4: never learned from."""
    return (F.crc32(F.col("doc_id").cast("string")) % 4) == HELD_OUT


def sample(docs: DataFrame) -> DataFrame:
    """The bounded training sample: (lang, text, part) with part 0 to learn, 1 to calibrate."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    counts = rows.groupBy("lang").count()  # one row per lang
    # Thin each lang by its hash first, so that the bounded window below sees few rows.
    share = F.least(F.lit(1.0), F.lit(2.0 * PER_LANG) / F.col("count"))
    unit = (F.col("_h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30))
    thinned = rows.join(F.broadcast(counts), "lang").where(unit < share).drop("count") \
        .dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy("_h")
    bounded = thinned.withColumn("_n", F.row_number().over(order)).withColumn(
        "_b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return bounded.where((F.col("_n") <= PER_LANG) & (F.col("_b") <= BYTES_PER_LANG)).select(
        "lang", "text", ((F.col("_n") % CALIBRATION) == 0).cast("int").alias("part"))


def learn(docs: DataFrame) -> Model:
    langs, bags, labels, part = [], [], [], []
    # Bounded: PER_LANG rows and BYTES_PER_LANG bytes a lang; streamed, each text kept
    # only as its distinct buckets.
    for r in sample(docs).toLocalIterator():
        if r.lang not in langs:
            langs.append(r.lang)
        bags.append(bag(grams(r.text)))
        labels.append(r.lang)
        part.append(bool(r.part))
    langs = sorted(langs)
    index = {lang: i for i, lang in enumerate(langs)}
    labels = np.array([index[lang] for lang in labels], dtype=np.int64)
    part = np.array(part, dtype=bool)
    train = [b for b, p in zip(bags, part) if not p]
    model = fit(train, labels[~part], langs)
    return calibrate(model, [b for b, p in zip(bags, part) if p], labels[part])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: BUCKETS x DIM floats

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        preds, scores = [], []
        for raw in texts(batch, "text"):
            ids = grams(raw.decode("utf-8", "replace"))
            if len(ids) == 0 or not m.langs:
                preds.append("und")
                scores.append(0.0)
                continue
            p = m.probabilities(bag(ids))
            k = int(p.argmax())
            preds.append(m.langs[k])
            scores.append(float(p[k]))
        scores_arr = pa.array(scores, pa.float64())
        accepted = pa.array([s >= m.reject and s > 0 for s in scores], pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()),
             scores_arr, accepted], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text"))
    return map_batches(rows, "doc_id bigint, held_out boolean, lang_pred string, score double, "
                             "accepted boolean", work)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the allowed rows of ``docs``, then predict every row."""
    return predict(docs, learn(docs))
