"""Packing: ids, gaps, padding, and the plan against trying all cuts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb\n", "one two\nthree. Four!", "x \n y",
    "tab\tx y z", "don't we'll 12,34  5", "é 你好 🙂\n🙂 ok", "a\x1cb c\x85d", "\n a\n",
    "<|endoftext|> x", "w" * 500 + " end"])
def test_ids_like_the_tokenizer(tokenizer, text):
    got = np.frombuffer(packing.tokens_of(PATH).packed(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


MANY = 1_200_000
RUNS = {"between": "a" + " " * MANY + "b", "blanks": " " * MANY, "newlines": "\n" * MANY,
        "lines between": "a.\n" + "\n" * MANY + "b", "mixed": "x" + " \t\u3000\r\n" * (MANY // 5),
        "tab at the end": "é 1" + " " * MANY + "\t's", "not blank": " " * MANY + "\x1c" + " " * 9,
        "two": " a" + "\n" * MANY + "b c" + " " * packing.BLANKS + "d",
        "short of it": "a" + " " * (packing.BLANKS - 1) + "b"}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_of_white_space(tokenizer, name):
    got = np.frombuffer(packing.tokens_of(PATH).packed(RUNS[name]), "<u4").tolist()
    assert got == tokenizer.encode(RUNS[name], add_special_tokens=False).ids


def check(pieces, texts, tokenizer):
    """Every id lies in one piece, sequences are gapless and in order; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            crc = zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            assert crc == (p.ids_crc32 if hasattr(p, "ids_crc32") else zlib.crc32(p.ids))
            at += p.length
        assert at == len(ids)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces = queries.REGISTRY["op6_packing"](spark, folder).collect()
    padding = check(pieces, texts, tokenizer)
    assert padding <= 0.01 * sum(p.length for p in pieces)


def test_blocks_and_order(spark, docs_of, tokenizer, monkeypatch):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choices(["the", "one.", "of\nthat", "zq", "end!"], k=rng.choice(
        [0, 3, 40, 900, 6000]))) for i in range(60)}
    docs = docs_of(list(texts.items())).coalesce(1)
    tokens, out = packing.tokens_of(PATH), []
    packer = packing.Packer(tokens, 0)
    monkeypatch.setattr(packing, "BLOCK", 5000)
    for i, text in texts.items():
        for part in packing.parts_of(i, tokens.packed(text)):
            out += packer.add(part)
    out += packer.flush(open_end=False)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    rows = spark.createDataFrame([(*r[:3], bytes(r[3]), *r[4:]) for r in out], names).collect()
    assert check(rows, texts, tokenizer) <= 0.03 * sum(r.length for r in rows)
    assert [(r.doc_id, r.start) for r in rows] == sorted((r.doc_id, r.start) for r in rows)
    assert check(packing.pack(docs, PATH).collect(), texts, tokenizer) <= 2048


def test_plan_is_cheapest(monkeypatch):
    """Against the best over all sets of cuts, with short sequences."""
    monkeypatch.setattr(packing, "LENGTH", 16)
    for name in ("POWERS", "LONG_POWERS"):
        monkeypatch.setattr(packing, name, [1, 2, 4, 8])
    rng = random.Random(8)
    for _ in range(200):
        places, penalties = [0], [0]
        for _ in range(rng.randint(1, 9)):
            places.append(places[-1] + rng.randint(1, 16))
            penalties.append(rng.choice([0, 1, 8]))
        weight = dict(zip(places, penalties))

        def cost(cuts):
            total = 0
            for a, b in zip([0, *cuts], cuts):
                if b - a > 16:
                    return float("inf")
                total += weight[b] + packing.PENALTY_SEQUENCE
                total += 0 if b - a in (1, 2, 4, 8, 16) else 16 - (b - a)
            return total

        inner = places[1:-1]
        best = min(cost([*(p for k, p in enumerate(inner) if mask >> k & 1), places[-1]])
                   for mask in range(1 << len(inner)))
        assert cost(packing.plan(places, penalties, open_end=False)) == best


def test_long_runs_are_packed(spark, docs_of, tokenizer):
    texts = {1: "one two.", 2: RUNS["between"], 3: RUNS["lines between"], 4: "end"}
    check(packing.pack(docs_of(list(texts.items())), PATH).collect(), texts, tokenizer)


def test_edges(spark, docs_of, tokenizer):
    docs = docs_of([(None, "a b"), (1, None), (2, "")]).selectExpr("*", "1 AS start", "2 AS ids")
    rows = packing.pack(docs, PATH).collect()
    assert check(rows, {None: "a b", 1: None, 2: ""}, tokenizer) >= 0
    twice = packing.pack(docs_of([(1, "a b"), (1, "a b")]), PATH).collect()
    assert sum(r.length for r in twice) == 6 and sum(r.start == 0 for r in twice) == 2
    assert packing.pack(docs_of([]), PATH).collect() == []
