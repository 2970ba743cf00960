"""Main text of web pages: gradient-boosted trees over the nodes of the document tree.

A page becomes a tree of block elements; runs of text between them are leaves. Trees score
every node from the text density and link density of its subtree, its attribute words, its
depth and its siblings. A node and what lies below it cannot disagree: the decoder chooses the
consistent labelling (everything below a dropped node is dropped) with the greatest total
log-odds. The kept leaves, in page order, are the text.

The trees learn from a bounded sample of the table's own pages. What is right there is told by
the page's own mark-up where it has an article, and by construction in rebuilt pages, in which
the sample's paragraphs are laid out anew: other tags, other names, with sidebars, notices,
forms and comments around and between them.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import map_batches, texts

SAMPLE = 300  # pages that are learned from, at most
REBUILT = 3  # new layouts of each of them
NODES = 400  # nodes of a page that are learned from, at most
MARK = "\ue000"
TREES, DEPTH, RATE, BINS, LEAST = 60, 4, 0.2, 32, 5.0

# What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style template noscript iframe object svg canvas audio video "
                   "select textarea button input title xmp noembed noframes datalist".split())
UNNESTED = frozenset({"button", "select"})  # one of these does not stand in another
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd "
                   "label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
                   "wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "tbody": {"table"}}
# Words of class, id and role that name page furniture, and those that name the text.
FURNITURE = frozenset("""ad ads advert advertisement adverts alert aside author-box banner
    breadcrumb breadcrumbs byline-links comment comments consent cookie cookies copyright
    disclaimer discussion dropdown footer foot form gdpr head header hero login masthead menu
    meta-links modal nav navbar navigation newsletter notice notification pager pagination
    popup promo promotion recommend recommended related replies reply respond rail search share
    sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tooltip topbar
    trending widget widgets complementary contentinfo""".split())
BODY = frozenset("article articlebody body content entry entry-content main maincontent page post "
                 "post-body story text".split())
TAGS = ("nav header footer aside form article main section p div ul ol li table td blockquote pre "
        "h1 h2 h3 h4 figure dl body").split()
OUTER = "nav header footer aside form article main".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)", re.S)
_NAMES = re.compile(r"(?:\A|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))",
                    re.I | re.S)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An element, or with tag '#text' a run of text between block elements."""

    tag: str
    parent: int
    names: frozenset[str] = frozenset()
    text: str = ""
    linked: int = 0  # characters of the text inside links
    end: int = 0  # behind the last node of the subtree


def _names(attributes: str) -> frozenset[str]:
    out = set()
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            out.add(name)
            out.update(_WORDS.findall(name))
    return frozenset(out)


def parse(page: str) -> list[Node]:
    """The block elements and text runs of a page, in page order (parents first). Elements
    that show no text are left out, with all they hold. Character references are decoded and
    white space within a run is one space; what is never closed ends with its parent.
    A head has no end of its own: what may stand in it shows no text anyway, and anything else
    is of the body, as HTML has it."""
    nodes = [Node("#root", -1)]
    stack = [0]
    run: list[str] = []
    linked = 0
    in_link = False
    inside: list[str] = []  # the silent element that is open, and the open ones in it
    endless: set[str] = set()  # raw elements whose end does not come any more

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            nodes.append(Node("#text", stack[-1], text=text, linked=min(linked, len(text)),
                              end=len(nodes) + 1))
        run.clear()
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            nodes[stack.pop()].end = len(nodes)

    def add(text: str) -> None:
        nonlocal linked
        if text and not inside:
            text = html.unescape(text)
            run.append(text)
            if in_link:
                linked += len(text)

    def raw_end(tag: str, at: int) -> int:
        """The place of the end tag of a raw element; -1 if it has none."""
        end = None if tag in endless else re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
        if not end:
            endless.add(tag)
        return end.start() if end else -1

    at = 0
    while True:
        match = _TOKEN.search(page, at)
        add(page[at:match.start() if match else len(page)])
        if not match:
            break
        at = match.end()
        slash, tag, rest = match[1] or match[5], match[2] or match[6], match[3] or match[7] or ""
        if not tag or not (match[4] or match[8]):
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag = tag.lower()
        if tag == "head" or tag == "body" and not slash and len(stack) <= 2 and (
                nodes[stack[-1]].tag in ("#root", "html")):
            inside.clear()  # what the head left open
        if tag == "head":
            flush()
            continue
        empty = rest.endswith("/") and (tag == "svg" or "svg" in inside)
        if inside:
            if not slash:
                if empty or tag in VOID or tag in INLINE:
                    continue
                if tag in RAW:
                    at = max(at, raw_end(tag, at))
                elif tag != inside[0] or tag not in UNNESTED:
                    inside.append(tag)
                continue
            if tag in inside:
                while inside.pop() != tag:
                    pass
                continue
            if tag in INLINE or all(nodes[i].tag != tag for i in stack):
                continue
            inside.clear()  # its parent ends
        if slash:
            if tag in INLINE:
                in_link = in_link and tag != "a"
                continue
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    flush()
                    close(i)
                    in_link = False
                    break
            continue
        if tag in SILENT:
            if tag in VOID:
                continue
            if tag not in INLINE:
                flush()
            if empty:
                continue
            if tag in RAW:  # nothing in it is mark-up
                end = raw_end(tag, at)
                at = end if end >= 0 else len(page)
            inside.append(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            in_link = in_link or tag == "a"
            continue
        flush()
        in_link = False
        if tag in ("html", "body") and len(stack) > 1:
            if any(nodes[i].tag == tag for i in stack):
                continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in HOLDS.get(tag, ()):
                    break
                if nodes[stack[i]].tag in CLOSES[tag]:
                    close(i)
                    break
        for i in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block starts
            if nodes[stack[i]].tag == "p":
                close(i)
                break
            if nodes[stack[i]].tag in ("td", "th", "table", "div", "article", "section"):
                break
        if tag not in VOID:
            nodes.append(Node(tag, stack[-1], _names(rest) if rest else frozenset()))
            stack.append(len(nodes) - 1)
    flush()
    close(0)
    return nodes


FEATURES = [
    "chars", "link_share", "chars_per_node", "chars_per_leaf", "marks_per_char", "words_per_leaf",
    "depth", "children", "place", "siblings_alike", "sibling_chars", "of_siblings", "of_page",
    "of_parent", "starts_at", "furniture", "body", "furniture_above", "body_above", "is_text",
    "furniture_below", "body_below", *(f"is_{t}" for t in TAGS), *(f"in_{t}" for t in OUTER)]
_TAG_AT = {t: len(FEATURES) - len(OUTER) - len(TAGS) + i for i, t in enumerate(TAGS)}
_OUTER_AT = {t: i for i, t in enumerate(OUTER)}


def features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES for every node."""
    n = len(nodes)
    out = np.zeros((n, len(FEATURES)), np.float32)
    own = np.zeros((n, 6))  # of a subtree: chars, linked chars, leaves, marks, words, nodes
    own[:, 5] = 1
    parent = [node.parent for node in nodes]
    named = np.zeros((n, 2))
    above = np.zeros((n, 2))
    outer = np.zeros((n, len(OUTER)), np.float32)
    depth, children, place = [0] * n, [0] * n, [0] * n
    alike: dict[tuple[int, str], int] = {}
    for i, node in enumerate(nodes):
        p = parent[i]
        if node.tag == "#text":
            t = node.text
            own[i, :5] = (len(t), node.linked, 1, sum(map(t.count, ".,;!?")), t.count(" ") + 1)
        else:
            if node.names:
                named[i] = len(node.names & FURNITURE), len(node.names & BODY)
            if node.tag in _TAG_AT:
                out[i, _TAG_AT[node.tag]] = 1
        if p >= 0:
            depth[i], place[i] = depth[p] + 1, children[p]
            children[p] += 1
            alike[p, node.tag] = alike.get((p, node.tag), 0) + 1
            above[i] = above[p] + named[p]
            outer[i] = outer[p]
            if nodes[p].tag in _OUTER_AT:
                outer[i, _OUTER_AT[nodes[p].tag]] = 1
    begins = np.concatenate([[0.0], np.cumsum(own[:, 0])])
    ends = np.array([node.end or n for node in nodes])
    sums = np.concatenate([np.zeros((1, 6)), np.cumsum(own, 0)])
    below = np.concatenate([np.zeros((1, 2)), np.cumsum(named, 0)])
    here = np.arange(n)
    tree = sums[ends] - sums[here]
    chars, leaves = tree[:, 0], np.maximum(tree[:, 2], 1)
    up = np.maximum(np.array(parent), 0)
    count = np.maximum(np.array(children)[up], 1)
    total = max(chars[0], 1)
    rest = chars[up] - chars
    out[:, :15] = np.stack([
        np.log1p(chars), tree[:, 1] / np.maximum(chars, 1), np.log1p(chars / tree[:, 5]),
        np.log1p(chars / leaves), tree[:, 3] / np.maximum(chars, 1), np.log1p(tree[:, 4] / leaves),
        depth, np.log1p(children), np.array(place) / count,
        [alike.get((p, node.tag), 1) for p, node in zip(parent, nodes)] / count,
        np.log1p(rest / np.maximum(count - 1, 1)), chars / np.maximum(rest, 1).clip(1),
        chars / total, chars / np.maximum(chars[up], 1), begins[:-1] / total], 1)
    out[:, 11] = np.log1p(out[:, 11])
    out[:, 15:17], out[:, 17:19] = np.minimum(named, 3), np.minimum(above, 3)
    out[:, 19] = [node.tag == "#text" for node in nodes]
    out[:, 20:22] = np.minimum(below[ends] - below[here] - named, 5)
    out[:, -len(OUTER):] = outer
    return out


@dataclass
class Trees:
    """Boosted trees in flat arrays: per tree and inner node the feature and the threshold
    (left below or equal), and per leaf the value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (2 ** DEPTH - 1)]
        return out


def by_names() -> Trees:
    """What is known without lessons: an element that mark-up calls furniture goes, unless it
    holds more than half of the page's text, as a form or a body may; all else stays."""
    at = {name: i for i, name in enumerate(FEATURES)}
    asks = [[(f"is_{t}", 0.5), ("of_page", 0.5)] for t in ("nav", "header", "footer", "aside", "form")]
    asks.append([("furniture", 0.5), ("of_page", 0.5), ("is_article", 0.5), ("is_main", 0.5)])
    inner = 2 ** DEPTH - 1
    feature, threshold = np.zeros((len(asks), inner), int), np.full((len(asks), inner), np.inf)
    value = np.zeros((len(asks), inner + 1))
    for k, ask in enumerate(asks):
        spot = 0
        for j in range(DEPTH):  # to the right where furniture is named, then always to the left
            if j < len(ask):
                feature[k, spot], threshold[k, spot] = at[ask[j][0]], ask[j][1]
            spot = 2 * spot + (2 if j == 0 else 1)
        value[k, spot - inner] = -1e9  # more than all that it holds can be worth
    return Trees(1.0, feature, threshold, value)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees of depth DEPTH for the logistic loss, grown level by level on binned features.
    Without both classes (or any row) there are no trees, and the base says which it is."""
    share = float((y * weight).sum() / weight.sum()) if len(y) else 1.0
    base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    inner = 2 ** DEPTH - 1
    if not 0 < share < 1:
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    cell = binned + np.arange(d) * BINS
    score = np.full(len(y), base)
    features_, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, size = 2 ** level - 1, 2 ** level
            spot = ((at - first)[:, None] * d * BINS + cell).ravel()
            gs, hs = (np.bincount(spot, np.repeat(v, d), size * d * BINS).reshape(size, d, BINS)
                      for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
            best = gain.reshape(size, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][cut]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[leaf]
        features_.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features_), np.array(thresholds), np.array(values))


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: of all labellings in which everything below a dropped node is
    dropped too and a kept element holds kept text, the one with the greatest sum of log-odds
    of the kept."""
    n = len(nodes)
    good = [0.0] * n  # of a node's children that are worth keeping by themselves
    best: list[tuple[float, int]] = [(-float("inf"), -1)] * n  # the best child, good or not
    for i in range(n - 1, 0, -1):
        worth = float(log_odds[i])
        if nodes[i].tag != "#text":
            worth += good[i] if good[i] > 0 else best[i][0]
        parent = nodes[i].parent
        good[parent] += max(worth, 0.0)
        best[parent] = max(best[parent], (worth, i))
        best[i] = (worth, best[i][1])  # from here on a node's own worth
    kept = [True] * n
    for i in range(1, n):
        worth, parent = best[i][0], nodes[i].parent
        forced = parent > 0 and good[parent] <= 0 and best[parent][1] == i
        kept[i] = kept[parent] and worth > -float("inf") and (worth > 0 or forced)
    return kept


def marked(nodes: list[Node]) -> list[bool] | None:
    """Per node whether it holds main text, by the page's own mark-up: what lies in an article
    or main element and not in page furniture; None for a page without these."""
    good = [False] * len(nodes)
    inside = [False] * len(nodes)
    bad = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.tag in ("article", "main")
        bad[i] = bad[node.parent] or node.tag in ("nav", "header", "footer", "aside", "form") or (
            node.tag not in ("article", "main") and bool(node.names & FURNITURE))
        if node.tag == "#text" and inside[i] and not bad[i]:
            while i >= 0 and not good[i]:
                good[i] = True
                i = nodes[i].parent
    return good if any(inside) else None


def rebuild(blocks: list[str], other: list[str], seed: int) -> list[tuple[str, bool]]:
    """A new layout of a page as (HTML, is main text) chunks, from its text blocks and other
    short texts. Chunks without main text are mark-up, furniture, or both."""
    rng = random.Random(seed)
    esc = html.escape

    def phrase() -> str:
        return esc(rng.choice(other)[:rng.randint(8, 90)])

    def prose() -> str:
        return esc(rng.choice(blocks))

    def links(n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='#'>{phrase()}</a></{tag}>" for _ in range(n))

    def box(words: str, inner: str, tag: str | None = None) -> str:
        tag = tag or rng.choice(["div", "div", "section", "aside"])
        style = rng.choice(["class", "id", "class"])
        return f"<{tag} {style}=\"{rng.choice(words.split())}\">{inner}</{tag}>"

    def furniture() -> str:
        kind = rng.randrange(11)
        if kind == 0:
            return f"<nav>{'<ul>' + links(rng.randint(2, 9)) + '</ul>'}</nav>"
        if kind == 1:
            return box("menu navbar topbar navigation breadcrumb pagination",
                       "<ul>" + links(rng.randint(2, 8)) + "</ul>")
        if kind == 2:
            return box("ad ads advert sponsored banner promo", f"<p>{phrase()}</p>")
        if kind == 3:
            return f"<header><div>{phrase()}</div>{links(rng.randint(0, 4), 'span')}</header>"
        if kind == 4:
            inner = f"&copy; {phrase()} &middot; {phrase()}"
            return rng.choice([f"<footer>{inner}</footer>", box("footer copyright", inner, "div")])
        if kind == 5:
            return box("sidebar related recommended widget trending",
                       f"<h3>{phrase()}</h3><ul>{links(rng.randint(2, 7))}</ul>" + (
                           f"<p>{phrase()}</p>" if rng.random() < .5 else ""))
        if kind == 6:
            return box("cookie consent notice notification alert disclaimer",
                       f"<p>{phrase()} {phrase()}</p>", "div")
        if kind == 7:
            return (f"<form><label>{phrase()}</label><input name='q'><button>{phrase()}</button>"
                    f"<p>{phrase()}</p></form>")
        if kind == 8:
            one = "".join(box("comment reply", f"<p>{phrase()}</p><p>{prose()}</p>", rng.choice(
                ["div", "li", "article"])) for _ in range(rng.randint(1, 6)))
            return box("comments discussion replies respond", f"<h3>{phrase()}</h3>{one}",
                       rng.choice(["div", "section", "aside"]))
        if kind == 9:
            return box("newsletter subscribe share social signup", f"<p>{phrase()}</p>"
                       + links(rng.randint(0, 4), "span"))
        return f"<aside><p>{prose() if rng.random() < .4 else phrase()}</p></aside>"

    def some(most: int) -> list[tuple[str, bool]]:
        return [(furniture(), False) for _ in range(rng.randint(0, most))]

    shell = rng.choice([
        ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
        ("<div class='content'>", "</div>"), ("<div id='main'><div class='post'>", "</div></div>"),
        ("<div>", "</div>"), ("<section>", "</section>"),
        ("<div class='entry-content'>", "</div>"), ("<article class='story'><div>", "</div></article>")])
    out = [("<html><body>", False), *some(4), (shell[0], False)]
    for i, block in enumerate(blocks):
        tag = "h1" if i == 0 and rng.random() < .8 else rng.choice(
            ["p"] * 9 + ["h2", "blockquote", "div", "li", "pre"])
        body = esc(block)
        if rng.random() < .15:
            cut = rng.randint(0, len(block))
            body = f"{esc(block[:cut])}<b>{esc(block[cut:])}</b>"
        chunk = f"<ul><li>{body}</li></ul>" if tag == "li" else f"<{tag}>{body}</{tag}>"
        out.append((chunk, True))
        if rng.random() < .06:
            out.append((furniture(), False))
    return [*out, *some(2), (shell[1], False), *some(4), ("</body></html>", False)]


def lessons(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of a page's nodes and of its rebuilt layouts."""
    xs, ys = [np.zeros((0, len(FEATURES)), np.float32)], [np.zeros(0)]
    nodes = parse(page)
    good = marked(nodes)
    blocks = [n.text for n, g in zip(nodes, good or []) if g and n.tag == "#text"]
    if good and blocks:
        xs.append(features(nodes)[1:])
        ys.append(np.array(good[1:], float))
        other = [n.text for n in nodes if n.tag == "#text" and n.text not in blocks] + [
            " ".join(b.split()[:12]) for b in blocks[:4]]
        for k in range(REBUILT):
            chunks = rebuild(blocks[:40], other, zlib.crc32(page.encode("utf-8", "replace")) + k)
            layout = "".join(chunk for chunk, _ in chunks)
            fresh = parse(layout)
            # Main text is found again by a mark that is put in front of it.
            signed = parse("".join(
                re.sub(r">(?=[^<])", f">{MARK}", c, count=1) if main else c for c, main in chunks))
            label = [n.text.startswith(MARK) for n in signed]
            for i, yes in enumerate(list(label)):
                up = signed[i].parent
                while yes and up >= 0 and not label[up]:
                    label[up] = True
                    up = signed[up].parent
            if len(fresh) == len(signed):
                xs.append(features(fresh)[1:])
                ys.append(np.array(label[1:], float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    if len(x) > NODES:
        pick = np.random.default_rng(len(x)).permutation(len(x))[:NODES]
        x, y = x[pick], y[pick]
    return x, y


def learn(pages: DataFrame) -> Trees:
    """Trees from at most SAMPLE of the pages (page_id, html) that give lessons, the first by a
    hash of their id, and at most NODES nodes of each; both bounds are parameters of the module.
    Pages are tried in the order of the hash, in ranges of it that grow until there are enough
    or no page is left. Without any lesson element names decide, see ``by_names``."""
    able = pages.select("page_id", "html", F.xxhash64("page_id").alias("at")).where(
        F.col("page_id").isNotNull() & F.col("html").rlike(r"(?i)<(?:article|main)[\s/>]"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lessons(t.decode("utf-8", "replace")) for t in texts(batch, "html")]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("at"),
             pa.array([x.astype(np.float32).tobytes() for x, _ in found], pa.binary()),
             pa.array([y.astype(np.float32).tobytes() for _, y in found], pa.binary())],
            ["page_id", "at", "x", "y"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, at bigint, x binary, y binary"
    n = able.select("page_id").distinct().count()
    rows, low, upto, share = [], -1 << 63, -1 << 63, 1.25 * SAMPLE / max(n, 1)
    while n and len(rows) < SAMPLE and upto < 1 << 63:
        upto = 1 << 63 if share >= 1 else min((-1 << 63) + int(share * (1 << 64)), 1 << 63)
        # One row of an id, however often it is repeated.
        tried = able.where(F.col("at").between(low, upto - 1)).groupBy("page_id", "at").agg(
            F.min_by("html", F.xxhash64("html")).alias("html"))
        table = map_batches(tried.select("page_id", "at", "html"), schema, work).where(
            "octet_length(y) > 0").orderBy("at", "page_id").limit(SAMPLE - len(rows)).toArrow()
        rows += zip(*(table.column(c).to_pylist() for c in ("page_id", "x", "y")))
        low, share = upto, 4 * share
    if not rows:
        return by_names()
    rows.sort()
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, len(FEATURES))
    y = np.frombuffer(b"".join(r[2] for r in rows), np.float32).astype(float)
    return boost(x, y, np.ones(len(y)))


def main_text(page: str, trees: Trees) -> str:
    nodes = parse(page)
    kept = decode(nodes, trees.log_odds(features(nodes)))
    return "\n\n".join(n.text for n, k in zip(nodes, kept) if k and n.tag == "#text")


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by an empty line. A null or empty page, and one without main text, gives an empty
    text. Without pages to learn from (none has an article) every block counts as main text but
    those in elements whose names mark furniture (``by_names``). Repeated rows are extracted alike, null ids and urls come back, other columns are ignored,
    an empty table gives no rows.
    """
    trees = trees or learn(pages)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [parse(t.decode("utf-8", "replace")) for t in texts(batch, "html")]
        out = []
        for at in range(0, len(parsed), 200):  # pages scored together
            some = parsed[at:at + 200]
            odds = trees.log_odds(np.concatenate([features(nodes) for nodes in some]))
            head = 0
            for nodes in some:
                kept = decode(nodes, odds[head:head + len(nodes)])
                head += len(nodes)
                out.append("\n\n".join(
                    n.text for n, k in zip(nodes, kept) if k and n.tag == "#text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
             pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_batches(slim, f"{kinds}, text string, n_chars bigint", work)
