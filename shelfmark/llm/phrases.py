"""Phrase collocation mining by top-order marginalisation of pruned windows.

Every word position of a piece gives one row: the word and the next three words of its
piece as *lead-window columns*, padded with nulls where the piece ends. Each padded longest
window is counted once, and a ROLLUP over (w1, w2, w3, w4) sums successively shorter prefixes
for free: the level (w1..wk) is the count of every k-word phrase.

A window is cut before it is counted: a phrase found LEAST_COUNT times has no pair and no
triple of words found more seldom, so a window ends before the first pair or triple that
is. No phrase that counts loses an occurrence, and most windows, which say something unique,
become equal to others and are combined before the shuffle, as hot words are. The pairs
and triples to keep are counted under 32-bit numbers: two that share one count together,
which keeps too much at worst. Every task is sent a bit for each, folded onto MARKS bits, so
that the more there are, the more seldom ones stay, with the same result. Pieces are written once as arrays of word numbers, from which
pairs, triples and windows are read; texts are taken apart for that and for the words' counts.

Defined cases: a null text is empty, a null lang is ``und``; texts of any length are read
whole (one row per word, streamed); an empty table or one without candidates gives no
row; ties in the final order fall to the phrase in UTF-8 byte order; extra columns are not
read. Scores are exact: ``a * 2000000`` is a decimal, never a 64-bit product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import small_side, written

# Fixed values of the contract.
PIECE_SPLIT = "[.,;:!?\\x0A-\\x0D]"
WORD = "[^\\x20\\x09]+"
PIECE_WORD = "[^\\x20\\x09.,;:!?\\x0A-\\x0D]+"  # a WORD of a piece, in the whole text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 4
LEAST_COUNT = 30
SCALE = 2_000_000
CONTAINED = (100, 80)  # 100 * f(longer) >= 80 * a drops the shorter candidate
TOP = 2000
MARKS = 1 << 26  # bits for frequent pairs or triples: at most 1,048,576 rows of 64 to broadcast
BUCKETS = 64  # first ranking inside (lang, bucket), then inside lang over the survivors


def _texts(docs: DataFrame) -> DataFrame:
    """(lang, text): every text in lower case, as far as A-Z goes. ``lower`` is that for ASCII
    texts, and cheaper."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)).alias("text"))


def _code(lang: Column, word: Column) -> Column:
    """A word of a lang as a 64-bit number."""
    return F.xxhash64(lang, word)


COLS = [f"c{k}" for k in range(1, LONGEST + 1)]


def coded(docs: DataFrame) -> DataFrame:
    """(w): the words of every piece of two words and more as an array of their numbers."""
    pieces = _texts(docs).select("lang", F.explode(F.split("text", PIECE_SPLIT)).alias("piece"))
    words = pieces.select("lang", F.regexp_extract_all("piece", F.lit(WORD), 0).alias("w")).where(F.size("w") > 1)
    return words.select(F.transform("w", lambda word: _code(F.col("lang"), word)).alias("w"))


def windows(codes: DataFrame) -> DataFrame:
    """(c1, c2, c3, c4): one row per word occurrence in the pieces (w), its number and the next
    three of its piece, padded with nulls."""
    at = codes.select("w", F.posexplode("w").alias("i", "c1"))
    return at.select("c1", *[F.get("w", F.col("i") + k).alias(f"c{k + 1}") for k in range(1, LONGEST)])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, word, f, c): every distinct word of every lang with its count and number. Two
    distinct words with one number would merge counts; ``check_codes`` refuses them."""
    words = _texts(docs).select("lang", F.explode(F.regexp_extract_all("text", F.lit(PIECE_WORD), 0)).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f")).withColumn(
        "c", _code(F.col("lang"), F.col("word")))


def check_codes(words: DataFrame) -> None:
    """Raise if two distinct words share a number (for 64-bit numbers, as good as never)."""
    if not words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("two distinct words share a 64-bit number; counts would merge")


def _marks(cut: DataFrame, size: int) -> DataFrame:
    """(at, marks): the word groups of this size that begin a window LEAST_COUNT times or more,
    as bits of at most MARKS / 64 rows, however many they are. They are counted under 32-bit
    numbers; two that share a number or a bit are kept or not together."""
    group = cut.where(F.col(COLS[size - 1]).isNotNull()).select(F.hash(*COLS[:size]).alias("h"))
    often = group.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    at, bit = _place(F.col("h"))
    return F.broadcast(written(often.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"))))


def _place(number: Column) -> tuple[Column, Column]:
    """Row and bit of a number among the marks."""
    return F.shiftright(number.bitwiseAND(F.lit(MARKS - 1)), 6), number.bitwiseAND(F.lit(63))


def _ending_before(rows: DataFrame, marks: DataFrame, last: int, size: int) -> DataFrame:
    """Windows that end before word ``last`` if the ``size`` words up to it are not marked."""
    at, bit = _place(F.hash(*COLS[last - size:last]))
    found = rows.withColumn("_at", at).join(marks, F.col("_at") == F.col("at"), "left")
    stays = F.getbit("marks", bit) == 1  # null without marks
    return found.select(*COLS[:last - 1], *[F.when(stays, F.col(c)).alias(c) for c in COLS[last - 1:]])


def pruned_windows(docs: DataFrame) -> DataFrame:
    """The windows of two words and more, cut before the first pair or triple of words that
    is found less than LEAST_COUNT times."""
    rows = windows(written(coded(docs))).where(F.col("c2").isNotNull())
    pairs = _marks(rows, 2)
    rows = _ending_before(rows, pairs, 2, 2).where(F.col("c2").isNotNull())
    rows = _ending_before(rows, pairs, 3, 2)
    triples = _marks(rows, 3)
    rows = _ending_before(rows, triples, 3, 3)
    return _ending_before(rows, triples, 4, 3)


def counts(docs: DataFrame) -> DataFrame:
    """(k, c1, c2, c3, c4, f) for every phrase of two to four words that is found LEAST_COUNT
    times or more, by numbers: the levels of one ROLLUP over the distinct windows."""
    distinct = pruned_windows(docs).groupBy(*COLS).agg(F.count(F.lit(1)).alias("f"))
    rolled = distinct.rollup(*COLS).agg(F.sum("f").alias("f"), F.grouping_id().alias("g"))
    # grouping id: 2**(4-k) - 1 for the level (c1..ck); 15 is the grand total.
    k = F.when(F.col("g") == 0, 4).when(F.col("g") == 1, 3).when(F.col("g") == 3, 2)
    level = rolled.withColumn("k", k).where(F.col("k").isNotNull() & (F.col("f") >= LEAST_COUNT))
    return level.where(_all_present(COLS)).select("k", *COLS, "f")  # padding nulls: no phrase


def _all_present(cols: list[str]) -> Column:
    ok = F.lit(True)
    for i, c in enumerate(cols, start=1):
        ok = ok & ((F.col("k") < i) | F.col(c).isNotNull())
    return ok


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of every lang: first inside (lang, bucket of the phrase),
    then inside the lang over at most BUCKETS * top survivors, so that a hot lang is
    not sorted whole in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.abs(F.xxhash64("phrase")) % BUCKETS
    first = scored.withColumn("_b", bucket).withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order)))
    kept = first.where(F.col("_r") <= top).drop("_b", "_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (longs) of the first ``top`` collocations
    of every lang; see the module and the contract for the rules."""
    words = written(dictionary(docs))
    check_codes(words)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = small_side(written(words.where(F.col("f") >= LEAST_COUNT)))
    # Candidates, each as the array of its words' numbers, and with the single words the parts
    # of their cuts. A number holds the lang of its word, so phrases of two langs never meet.
    kept = written(counts(docs).select(F.slice(F.array(*COLS), 1, F.col("k")).alias("p"), "k", "f"))
    parts = small_side(written(kept.select("p", "f").unionByName(
        frequent.select(F.array("c").alias("p"), "f"))))

    cuts = kept.withColumnRenamed("f", "a").select(
        "*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.slice("p", 1, F.col("cut"))).withColumn(
        "tail", F.slice("p", F.col("cut") + 1, F.col("k") - F.col("cut")))
    left = parts.select(F.col("p").alias("head"), F.col("f").alias("l"))
    right = parts.select(F.col("p").alias("tail"), F.col("f").alias("r"))
    scored = (cuts.join(left, "head").join(right, "tail")
              .withColumn("score", F.expr(f"CAST(a AS DECIMAL(38,0)) * {SCALE} div (CAST(l AS DECIMAL(38,0)) + r)")))
    lowest = scored.groupBy("p").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", "k")).alias("m")).select(
        "p", "m.a", "m.l", "m.r", "m.k", F.col("m.score").cast("bigint").alias("score"))
    lowest = written(lowest.join(frequent.select("lang", F.col("c").alias("_c")), F.col("p")[0] == F.col("_c"))
                     .drop("_c"))

    # Every shorter part (two words or more) of every longer candidate, with its count.
    longer = kept.where(F.col("k") >= 3).select(
        "p", "k", F.col("f").alias("fq"),
        F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("len"))
    inner = longer.select("fq", "len", "p",
                          F.explode(F.sequence(F.lit(1), F.col("k") - F.col("len") + 1)).alias("at"))
    strongest = inner.select("fq", F.slice("p", F.col("at"), F.col("len")).alias("p")) \
        .groupBy("p").agg(F.max("fq").alias("fq"))
    up, down = CONTAINED
    survivors = lowest.join(strongest, "p", "left").where(
        F.col("fq").isNull() | (F.col("fq") * up < F.col("a") * down)).drop("fq")

    # The words back from their numbers.
    spelled = survivors.select("lang", "p", F.posexplode("p").alias("i", "c")).join(
        frequent.select("c", "word"), "c")
    phrase = spelled.groupBy("lang", "p").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    with_n = survivors.join(phrase, ["lang", "p"]).join(n, "lang")
    ranked = _ranked(with_n, top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase",
                         *[F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")])
