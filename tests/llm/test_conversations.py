"""op13: the streaming repair against a plain Python version of the whole contract."""

import hashlib
import heapq
import re
import zlib

import pytest

from shelfmark.llm import conversations as conv

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LETTERS = "DIKR"


def cheapest(rows):
    """(cost, audit) by a search over whole edit strings in (cost, string) order."""
    n = len(rows)
    heap, done = [(0, "", 0, conv.START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == n and state in conv.ACCEPT:
            return cost, audit
        if (i, state) in done:  # a later path to a node is worse in (cost, string) order
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 5, audit + "I", i, conv._after(state)))
        if i == n:
            continue
        initial, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
        if fault in (conv.BLANK, conv.DUPLICATE):
            continue
        extra = 5 if fault == conv.TRUNCATED else 0
        kept = conv._keep(state, initial)
        if kept >= 0:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept))
        if initial != conv._expected(state):
            heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, conv._after(state)))


def plain(table):
    """The contract, row by row, in Python."""
    out = {}
    for cid in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != cid:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else re.sub(r"[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            rows += [(turn, role, text, k) for k in range(2 if code == 3 else 1)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))
        seen, faults = set(), []
        for turn, role, text, _ in rows:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                faults.append(conv.BLANK)
            elif (role, text) in seen:
                faults.append(conv.DUPLICATE)
            elif not re.search(r"[.!?][\x20\x09-\x0D]*$", text):
                faults.append(conv.TRUNCATED)
            else:
                faults.append(0)
            seen.add((role, text))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(list(zip(initials, faults)))
        lines, it, state = [], iter(rows), conv.START
        for letter in audit:
            if letter == "I":
                lines.append(("assistant" if state == conv.AFTER_U else "user") + ":")
                state = conv._after(state)
                continue
            _, role, text, _ = next(it)
            if letter == "K":
                lines.append(f"{role}:{text}")
                state = conv._keep(state, role[:1])
            elif letter == "R":
                lines.append(("assistant" if state == conv.AFTER_U else "user") + ":" + text)
                state = conv._after(state)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[cid] = (cid, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                    digest, len(rows))
    return out


def run(spark, table, **kw):
    df = conv.repair(spark.createDataFrame(table, SCHEMA), **kw)
    return {r[0]: tuple(r) for r in df.collect()}


def test_cheapest_prefers_keep_and_least_letters():
    u, a, s = "u", "a", "s"
    assert cheapest([(u, 0), (a, 0)]) == (0, "KK")
    assert cheapest([(a, 0)]) == (2, "D")
    assert cheapest([(u, 0), (u, 0), (a, 0), (a, 0)]) == (2, "KRRK")
    assert cheapest([(s, 0), (u, 0), (a, 0)]) == (0, "KKK")
    assert cheapest([(u, conv.BLANK)]) == (2, "D")


def test_streaming_equals_plain_on_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, table, partitions=3) == plain(table)


def test_defined_cases(spark):
    table = [(None, 1, "user", "hi."), (None, None, None, None), (1, 2, "system", "x"),
             (1, 2, "system", "x"), (1, None, "tool", "a long text" * 5000),
             (2, 5, "user", "  \n "), (2, 5, "user", "  \n "), (3, 7, "assistant", "Fine!"),
             (4, 1, "user", ""), (4, 3, "assistant", "same."), (4, 4, "assistant", "same.")]
    assert run(spark, table, partitions=2) == plain(table)
    assert run(spark, [], partitions=2) == {}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    import random
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None]
    texts = ["ok.", "ok", "", " ", "Why?", None, "again!"]
    table = [(rnd.randrange(4), rnd.choice([None, *range(8)]), rnd.choice(roles), rnd.choice(texts))
             for _ in range(60)]
    assert run(spark, table, partitions=3) == plain(table)


def test_a_conversation_that_spills(spark, monkeypatch):
    monkeypatch.setattr(conv, "SPOOL_BYTES", 1 << 10)
    monkeypatch.setattr(conv.Repair, "BLOCK", 4)
    rows = [(9, t, ["user", "assistant", "user"][t % 3], f"text {t}" + ("." if t % 4 else ""))
            for t in range(300)]
    assert run(spark, rows, partitions=1) == plain(rows)
