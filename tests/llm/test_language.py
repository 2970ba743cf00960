"""op11: held-out accuracy, defined cases and the bounded sample."""

import numpy as np

from shelfmark.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_table(spark):
    got = queries.REGISTRY["op11_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100
    right = np.mean([r.lang_pred == r.lang for r in rows])
    assert right >= 0.95, right
    accepted = [r for r in rows if r.accepted]
    assert np.mean([r.lang_pred == r.lang for r in accepted]) >= right
    assert all(0.0 <= r.score <= 1.0 for r in rows)
    assert got.count() == docs.count()


def test_grams_whole_text_and_letters():
    assert len(language.grams(None)) == 0 and len(language.grams("12 ?! ")) == 0
    assert len(language.grams("ab")) == 2 + 3 + 2 + 1  # <ab>: a b; <a ab b>; <ab ab>; <ab>
    long = "wort " * 100_000
    assert len(language.grams(long)) == 100_000 * len(language.grams("wort"))
    assert np.array_equal(language.grams("ABC"), language.grams("abc"))


def test_defined_cases(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate(
        [("the cat and the dog were here", "en")] * 30 + [("der hund und die katze waren da", "de")] * 30)]
    rows += [(100, None, "en", "s"), (101, "1234 !!", "de", "s"), (102, "", None, "s"),
             (103, "le chat", None, "s"), (104, "the cat " * 50_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df.withColumn("score", df.doc_id)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und"
    assert got[100].score == 0.0 and not got[100].accepted
    assert got[103].lang_pred in ("en", "de")
    assert got[104].lang_pred == "en"
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty).count() == 0
