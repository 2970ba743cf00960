"""Extraction: the parser, the decoder against all labellings, held-out layouts, whole table."""

import itertools
import random
import re

import numpy as np
import pytest

from shelfmark.llm import pages, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"


def article_text(page):
    """The text of the one article of a generated page: its blocks, without any tree."""
    body = page[page.index("<article>"):]
    body = re.split(r"</article>|<footer>", body)[0]
    body = re.sub(r"<[^>]*\Z", "", re.sub(r"<!--.*?-->", "", body, flags=re.S))
    blocks = re.split(r"</?(?:article|p|h1|h2|li|ul|div|table|tr|td)\b[^>]*>", body)
    from html import unescape
    blocks = [" ".join(unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace(
        "</b>", "")).split()) for b in blocks]
    return "\n\n".join(b for b in blocks if b)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.REGISTRY["op10_html_extraction"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_text(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url


def texts(page):
    return [n.text for n in pages.parse(page) if n.tag == "#text"]


@pytest.mark.parametrize("page, expected", [
    ("<p>a &amp; b&eacute; &#233;&#x41;&nbsp;c\n\t d</p>", ["a & bé éA c d"]),
    ("<p>one<p>two<ul><li>x<li>y</ul>z", ["one", "two", "x", "y", "z"]),
    ("<p><b>bold<br>line<p>next", ["bold line", "next"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t", ["t"]),
    ("<!-- <p>no</p> --><p title='a>b'>yes<!-- open", ["yes"]),
    ("a<div>b<span>c</span>d</div>e &am", ["a", "bcd", "e &am"]),
    ("<title>x</title><p>half <a hre", ["half"]),
    ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<select><option>x</select><noscript><p>n</p></noscript><p>k", ["k"]),
    ("<textarea><p>raw</textarea><P CLASS=X>up</P>", ["up"]),
    ("<p title=\"never closed>text</p>", ["text"]), ("", []), ("   ", []), ("</div></p>", [])])
def test_parser(page, expected):
    assert texts(page) == expected


@pytest.mark.parametrize("page, expected", [
    ("<html><head><title>x</title><body><article>t</article>", ["t"]),
    ("<head><meta charset=utf-8><link href=x><title>x</title><p>t", ["t"]),
    ("<head><title>x</title>t<div>u</div>", ["t", "u"]),
    ("<head><script>if (i<n\" )</script></head><p class=\"x\">t</p>", ["t"]),
    ("<head><title>a <b\" c</title><style>p<q'</style></head><p class='\"'>t</p>", ["t"]),
    ("<p>s</p><svg viewBox='0 0 1 1'/><p>t", ["s", "t"]),
    ("<svg><svg/><g/><title>a</svg></title><style>a<b'</style>x</svg><p id='y'>t", ["t"]),
    ("<div><button>b</div><p>t", ["t"]), ("<div><select><option>b</div><p>t", ["t"]),
    ("<div><object><p>b</p></div><p>t", ["t"]), ("<div><noscript>b</div><p>t", ["t"]),
    ("<div><svg><path></div><p>t", ["t"]), ("<div><video>b</div><p>t", ["t"]),
    ("<head><noscript><link></head><p>t", ["t"]), ("<html><head><noscript><body><p>t", ["t"]),
    ("<button>a<button>b</button>t", ["t"]),
    ("<div><button><div>b</div>c</p></button>t</div>u", ["t", "u"]),
    ("<div><noscript><script>'</div>'</script>b</noscript>t</div>u", ["t", "u"])])
def test_silent_elements_end(page, expected):
    assert texts(page) == expected


def test_subtrees_end_where_they_should():
    nodes = pages.parse("<div><p>a</p><p>b</div>c<ul><li>d<li>e")
    for i, node in enumerate(nodes):
        inside = {i}
        for j in range(i + 1, len(nodes)):
            if nodes[j].parent in inside:
                inside.add(j)
        assert node.end == max(inside) + 1


def test_decoder_is_best_and_consistent():
    rng = random.Random(1)
    for _ in range(60):
        nodes = [pages.Node("#root", -1)]
        for i in range(1, 9):
            inner = [j for j, n in enumerate(nodes) if n.tag != "#text"]
            nodes.append(pages.Node(rng.choice(["div", "#text", "#text"]), rng.choice(inner)))
        nodes = [nodes[0], *nodes[1:]]
        odds = np.array([rng.uniform(-3, 3) for _ in nodes])

        def worth(kept):
            """The kept leaves, and the kept elements that hold one; None if inconsistent."""
            if any(kept[i] and not kept[n.parent] for i, n in enumerate(nodes) if i):
                return None
            holds = [n.tag == "#text" and k for n, k in zip(nodes, kept)]
            for i in range(len(nodes) - 1, 0, -1):
                holds[nodes[i].parent] |= holds[i]
            if any(k and not h for k, h in list(zip(kept, holds))[1:]):
                return None
            return sum(o for o, h in list(zip(odds, holds))[1:] if h)

        options = [worth((True, *kept)) for kept in itertools.product([True, False], repeat=8)]
        got = worth(pages.decode(nodes, odds))
        assert got == pytest.approx(max(o for o in options if o is not None))


def test_held_out_layouts(spark):
    """Layouts of pages that were not learned from; other seeds than in learning."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    lessons = [pages.lessons(r.html) for r in rows[:120]]
    trees = pages.boost(np.concatenate([x for x, _ in lessons]),
                        np.concatenate([y for _, y in lessons]).astype(float),
                        np.ones(sum(len(y) for _, y in lessons)))
    right = wrong = 0
    for r in rows[120:200]:
        nodes = pages.parse(r.html)
        good = pages.marked(nodes)
        blocks = [n.text for n, g in zip(nodes, good) if g and n.tag == "#text"]
        other = [n.text for n in nodes if n.tag == "#text" and n.text not in blocks]
        chunks = pages.rebuild(blocks, other, 7_000_000 + r.page_id)
        expected = [t for chunk, main in chunks if main for t in texts(chunk)]
        got = pages.main_text("".join(c for c, _ in chunks), trees)
        right += got == "\n\n".join(expected)
        wrong += got != "\n\n".join(expected)
    assert wrong <= 0.05 * right


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"),
            (3, "u", "<nav><a href='/'>m</a></nav><article><p>Long text, here it is.</p>"
                     "</article><footer>f</footer>"), (3, "u", "<p>" + "word, " * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = pages.extract(frame).collect()
    assert len(got) == 5
    assert {(r.page_id, r.text) for r in got if r.page_id in (1, 2)} == {(1, ""), (2, "")}
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(1, "u", "<p>only this</p>")], SCHEMA)
    assert [r.text for r in pages.extract(alone).collect()] == ["only this"]


def test_rare_articles_are_learned_from(spark, monkeypatch):
    """Pages without lessons neither fill the sample nor end the search for others."""
    monkeypatch.setattr(pages, "SAMPLE", 4)
    real = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").limit(3).collect()]
    idle = "<main></main><div>no lesson here</div>"
    rows = [(i, "u", real[i // 30] if i % 30 == 7 else idle) for i in range(90)]
    frame = spark.createDataFrame(rows + rows[7:8], SCHEMA)
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert [got[i] for i in (7, 37, 67)] == [article_text(p) for p in real]


def test_names_decide_without_lessons(spark):
    page = ("<body class='site-header'><nav>m</nav><div class=sidebar><p>s</p></div><div><p>Long "
            "text, here it is, and so on.</p><p>More.</p></div><footer>f</footer>")
    rows = [(1, "u", page), (2, "u", f"<form>{page}</form>"), (3, "u", "<p>only this</p>")]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = "Long text, here it is, and so on.\n\nMore."
    assert got == {1: text, 2: text, 3: "only this"}


def test_trees_learn_what_a_line_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(pages.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.3)).astype(float)
    trees = pages.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
