"""Admission over small literal tables; the cases are listed in FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from shelfmark import Index, schemas
from shelfmark.functions.text import extract_text
from shelfmark.operators import admission
from shelfmark.session import scratch_path
from shelfmark.sources import corpus

ENTRIES = [
    ("v1", "/docs/a.txt", "file", "txt"),
    ("v1", "/docs/.b.txt", "file", "txt"),
    ("v1", "/.cfg/c.txt", "file", "txt"),
    ("v1", "/./d.txt", "file", "txt"),
    ("v1", "/docs/link", "symlink", "txt"),
    ("v1", "/docs", "dir", None),
    ("v1", "/img/e.bin", "file", "bin"),
    ("v1", "/index/seg1", "file", "txt"),
    ("v1", "/indexes/f.txt", "file", "txt"),
    ("v1", "/tmp/x/g.txt", "file", "txt"),
    ("v1", "/tmpfile.txt", "file", "txt"),
    ("v1", None, "file", "txt"),
    ("v2", "/tmp/x/g.txt", "file", "txt"),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(*e, "text") for e in ENTRIES], schemas.FILE_ENTRIES)


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("txt",), ("html",)], schemas.SUPPORTED_TYPES)


@pytest.fixture(scope="module")
def excludes(spark):
    return spark.createDataFrame([("v1", "/tmp/")], schemas.EXCLUDES)


def places(rows):
    return {(r["volume"], r["path"]) for r in rows.select("volume", "path").collect()}


def test_hidden_entries(entries):
    hidden = {("v1", "/docs/.b.txt"), ("v1", "/.cfg/c.txt"), ("v1", None)}
    assert places(entries) - places(admission.visible_paths(entries)) == hidden


def test_kinds(entries):
    assert ("v1", "/docs") not in places(admission.regular_files(entries))
    assert ("v1", "/docs/link") not in places(admission.no_symlinks(entries))
    assert ("v1", "/docs") in places(admission.no_symlinks(entries))


def test_index_directory(entries):
    kept = places(admission.not_in_index_dir(entries))
    assert ("v1", "/index/seg1") not in kept and ("v1", "/indexes/f.txt") in kept


def test_excluded_directories(entries, excludes):
    kept = places(admission.not_excluded(entries, excludes))
    assert places(entries) - kept == {("v1", "/tmp/x/g.txt")}


@pytest.mark.parametrize("more", [0, 1500])
def test_a_directory_is_meant_with_or_without_its_slash(spark, entries, more):
    """Whatever the number of excluded directories."""
    rows = [("v1", "/tmp"), ("v2", "/tmp/x/"), ("v1", "/docs/a"), ("v3", "/tmp/"), ("v1", None)]
    rows += [("v1", f"/none/{i}") for i in range(more)]
    kept = places(admission.not_excluded(entries, spark.createDataFrame(rows, schemas.EXCLUDES)))
    assert places(entries) - kept == {("v1", "/tmp/x/g.txt"), ("v2", "/tmp/x/g.txt")}
    rows.append(("v1", "/"))
    kept = places(admission.not_excluded(entries, spark.createDataFrame(rows, schemas.EXCLUDES)))
    assert kept == {("v1", None)}


def test_types(entries, types):
    assert ("v1", "/img/e.bin") not in places(admission.supported_types(entries, types))


def test_status_order(spark, types):
    rows = spark.createDataFrame(
        [("v1", None, "file", "bin", ""), ("v1", "/index/a.bin", "file", "bin", ""),
         ("v1", "/index/a.txt", "file", "txt", ""), ("v1", "/a.txt", "file", "txt", "")],
        schemas.FILE_ENTRIES)
    found = admission.admission_status(rows, types).orderBy(F.col("path"), "type")
    assert [r["admission_status"] for r in found.collect()] == [
        "bad_value", "OK", "nspt", "excl"]
    unnamed = spark.createDataFrame([("", "/a.txt", "file", "txt", ""),
                                     (None, "/a.txt", "file", "txt", "")], schemas.FILE_ENTRIES)
    bad = admission.admission_status(unnamed, types).collect()
    assert [r["admission_status"] for r in bad] == ["bad_value"] * 2
    report = admission.rejection_report(found).collect()
    assert {r["admission_status"]: r["n_entries"] for r in report} == {
        "bad_value": 1, "OK": 1, "nspt": 1, "excl": 1}


def test_admit(entries, types, excludes):
    assert places(admission.admit(entries, types, excludes)) == {
        ("v1", "/docs/a.txt"), ("v1", "/./d.txt"), ("v1", "/indexes/f.txt"),
        ("v1", "/tmpfile.txt"), ("v2", "/tmp/x/g.txt")}


def test_index_takes_in_what_is_admitted(spark, entries, types, excludes):
    rules = admission.Admission(types, excludes)
    index = Index(spark, scratch_path(spark, "index"), buckets=2, admission=rules)
    admitted = places(admission.admit(entries, types, excludes))
    one = spark.createDataFrame([("v1",)], "volume STRING")
    index.build(entries, one)
    assert places(index.doc_list()) == {p for p in admitted if p[0] == "v1"}
    index.bootstrap(entries, spark.createDataFrame([("v1",), ("v2",)], "volume STRING"))
    assert places(index.doc_list()) == admitted
    changes = spark.createDataFrame(
        [("v1", p, "created", 1) for _, p, *_ in ENTRIES if p] + [("v1", "/docs/a.txt", "removed", 2)],
        "volume STRING, path STRING, op STRING, batch BIGINT")
    index.commit(changes, entries)
    assert places(index.doc_list()) == admitted - {("v1", "/docs/a.txt")}


def test_removals_are_not_filtered(spark, entries, excludes):
    changes = spark.createDataFrame(
        [(1, "v1", "/docs/a.txt", "created"), (2, "v1", "/.cfg/c.txt", "created"),
         (3, "v1", "/.cfg/c.txt", "removed"), (4, "v1", "/tmp/x/g.txt", "created"),
         (5, "v1", "/none.txt", "created"), (6, "v1", "/docs", "created"),
         (7, "v9", "/gone.txt", "removed")],
        "seq BIGINT, volume STRING, path STRING, op STRING")
    kept = admission.admit_updates_only(changes, entries, excludes)
    assert {r["seq"] for r in kept.collect()} == {1, 3, 7}


def test_volumes(spark):
    volumes = spark.createDataFrame(
        [("v1", False, True, 1), ("v2", True, True, 2), ("v3", False, False, 3)],
        schemas.VOLUMES)

    def names(rows):
        return {r["volume"] for r in rows.collect()}

    assert names(corpus.eligible_volumes(volumes)) == {"v1"}
    assert names(corpus.eligible_volumes(volumes, monitor_removable=True)) == {"v1", "v2"}
    scope = corpus.eligible_volumes(volumes)
    grown = corpus.attach_volume(scope, volumes, monitor_removable=True)
    assert names(grown) == {"v1", "v2"} and grown.count() == 2
    assert names(corpus.attach_volume(scope, volumes)) == {"v1"}
    assert names(corpus.detach_volume(grown, scope)) == {"v2"}


def test_raw_files(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.TXT").write_text("Été 1", encoding="utf-8")
    (root / "sub" / "b.html").write_text("<p>x</p>", encoding="utf-8")
    (root / "sub" / "c.txt").write_bytes(b"\xff\xfe\xff")
    rows = corpus.read_files(spark, str(root), "v1").collect()
    assert {(r["path"], r["type"], r["contents"]) for r in rows} == {
        ("/a.TXT", "txt", "Été 1"), ("/sub/b.html", "html", "<p>x</p>"),
        ("/sub/c.txt", "txt", None)}
    late = corpus.read_files(spark, str(root), "v1", modified_after="2999-01-01T00:00:00")
    assert late.count() == 0


def test_hosts_name_the_volume(spark):
    urls = ["HTTPS://X.org/a", "//x.org/b", "http://x.org?c", "file:///etc/d", "/e", None]
    pages = spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(urls)],
                                  "page_id BIGINT, url STRING, html STRING")
    assert [r["volume"] for r in corpus.pages_corpus(pages).collect()] == [
        "x.org", "x.org", "x.org", corpus.NO_HOST, corpus.NO_HOST, corpus.NO_HOST]


def test_references_become_letters(spark):
    html = "caf&eacute; na&#239;ve &#x41;&amp;lt; &nope; &amp &#0;&#xD800;&NotEqualTilde;<b>&#128512;"
    row = spark.createDataFrame([(html,), (None,), ("",)], "t STRING").select(
        extract_text(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in row] == ["café naïve A&lt; &nope; &amp ≂̸ 😀", None, ""]
