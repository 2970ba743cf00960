"""Quality rules whose thresholds follow the data: quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import with_columns_from_text
from shelfmark.session import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SKETCH_K = 400  # size of a sketch; its rank error is well under one percent
LEAST_ROWS = 200  # a group with fewer rows takes the thresholds of its language
# A ratio is too high above q75 + REACH * max(q75 - q50, its least spread), and too low below
# the mirror image; the least spread keeps groups without any variation from rejecting
# documents that merely differ.
REACH = 4.0
SPREAD = {"symbol_ratio": 0.05, "dup_line_ratio": 0.1, "repeat_ratio": 0.05, "word_length": 0.75}
TWO_SIDED = {"word_length"}

_CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measures(text: bytes) -> tuple[int, ...]:
    """The counts of COUNTS for one UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reached = 0  # words before this one are counted
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + WINDOW - max(i, reached)
                reached = i + WINDOW
    return (len(words), len(b"".join(words).translate(None, _CONTINUATION)),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated, len(lines))


def measured_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of every row, as (kept struct, counts)."""
    def work(found: list[bytes]) -> list[pa.Array]:
        counts = [measures(t) for t in found]
        return [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]

    return with_columns_from_text(docs, keep, [(c, "long") for c in COUNTS], work)


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*): the bounds for every language and source of the rows
    (lang, source, counts).

    One sketch per ratio, language and source; sketches of a language, and of everything, are
    merges of these. A group of fewer than LEAST_ROWS rows takes its language's bounds, a
    language of fewer takes the overall ones. A null language or source is a group as well.
    """
    names = list(SPREAD)
    by_source = written(measured.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[
            F.kll_sketch_agg_double(ratios()[r], SKETCH_K).alias(r) for r in names]))
    merged = [F.sum("n").alias("n"), *[
        F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in names]]

    def bounds(level: DataFrame, keys: list[str], tag: str) -> DataFrame:
        columns = []
        for r in names:
            q25, q50, q75 = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (.25, .5, .75))
            step = lambda width: REACH * F.greatest(width, F.lit(SPREAD[r]))
            columns.append((q75 + step(q75 - q50)).alias(f"high_{r}"))
            if r in TWO_SIDED:
                columns.append((q25 - step(q50 - q25)).alias(f"low_{r}"))
        return level.where("n > 0").select(*keys, F.col("n").alias(f"n_{tag}"),
                                           F.struct(*columns).alias(tag))

    languages = bounds(by_source.groupBy("lang").agg(*merged), ["lang"], "by_lang")
    overall = bounds(by_source.agg(*merged), [], "overall")
    own = bounds(by_source, ["lang", "source"], "own").join(
        languages.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    chosen = F.when(F.col("n_own") >= LEAST_ROWS, F.col("own")).when(
        F.col("n_by_lang") >= LEAST_ROWS, F.col("by_lang")).otherwise(F.col("overall"))
    one = F.broadcast(overall.withColumn("_one", F.lit(1)))  # one row, as it has no group
    return own.withColumn("_one", F.lit(1)).join(one, "_one").select(
        "lang", "source", chosen.alias("b")).select("lang", "source", "b.*")


def judged(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    """``measured`` (lang, source, counts) with base_failed and kept."""
    own = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    within = [F.col(f"_ratios.{r}") <= F.col(f"high_{r}") for r in SPREAD]
    within += [F.col(f"_ratios.{r}") >= F.col(f"low_{r}") for r in TWO_SIDED]
    joined = measured.withColumn(
        "_ratios", F.struct(*[c.alias(r) for r, c in ratios().items()])).join(
        own, F.col("lang").eqNullSafe(F.col("_lang"))
        & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(*[f"`{c}`" for c in measured.columns], base_failed().alias("base_failed"),
                         (~base_failed() & reduce(Column.__and__, within)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row for every row of documents (doc_id, text, lang, source): doc_id, the counts of
    COUNTS, base_failed and kept.

    A document is not kept if it fails the fixed base rules (fewer than ten words, or more
    than a fifth of its words in repeated five-word windows), or if a ratio lies outside the
    bounds of its language and source. A null or empty text has no words and fails. Nulls in
    lang and source form groups of their own, ties at a bound are kept, repeated rows are
    judged alike, other columns are ignored and an empty table gives no rows.
    """
    measured = written(measured_documents(docs, ["doc_id", "lang", "source"]).select(
        "_row.*", *COUNTS))
    return judged(measured, thresholds(measured)).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns. The texts are
    measured once for the bounds and once more as they pass, instead of being shuffled."""
    bounds = written(thresholds(measured_documents(docs, ["lang", "source"]).select(
        "_row.*", *COUNTS)))
    passing = measured_documents(docs, docs.columns).select(
        "_row", "_row.lang", "_row.source", *COUNTS)
    return judged(passing, bounds).where("kept").select("_row.*")
