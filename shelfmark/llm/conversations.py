"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn inside each partition (one shuffle; the
sort spills). A forward dynamic programme over four grammar states carries its state from
one Arrow batch to the next, so a conversation may span any number of batches. Its compact
backpointers (eight bytes a row) and the rows it has to hash again after the traceback go
to a spool that moves to a temporary file of the task once it passes ``SPOOL_BYTES``; a
giant conversation therefore needs bounded memory. The task deletes the file itself.

The grammar of role initials is ``(s?(ua)+)?``. Edits and costs: Keep 0, Rerole to the role
the grammar expects 1 (a row whose role is that role already is kept instead), Delete 2
(the only edit of blank and duplicate rows), Insert an empty user or assistant row 5;
every truncated row that is not deleted costs 5 more. Among the cheapest edit strings the
ASCII-least one is chosen (``D < I < K < R``). It is found in the forward pass: the best
string of each state is a *base* (ending with a row's edit, so that the bases of one row
are prefix-free and ranked) followed by inserts; two candidates compare by the rank of
their bases, then by their own letters. That comparison is exact, with no traceback.

Defined cases: null role or text is one space (also in the damage key); null turns sort
first; rows of one turn sort by role, then text, then copy; a null conv_id is a
conversation of its own; every original conv_id gets a row, also when damage drops all
its rows (zeros, empty audit, the hash of the empty string); an empty table gives no row;
extra columns are not read. Role initials are first characters; a role whose initial is
none of s, u, a can be rerolled or deleted only.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract: damage codes by crc32 % 20, edit costs, the grammar.
DROP, EMPTY, UNPUNCT, REPEAT, TO_USER = 0, 1, 2, 3, 4
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPOOL_BYTES = 64 << 20  # a conversation's spool beyond this goes to a temporary file

INF = 1 << 62
START, AFTER_S, AFTER_U, AFTER_A = 0, 1, 2, 3
ACCEPT = (START, AFTER_A)
LETTERS = "DIKR"  # codes 0..3, in ASCII order


def _keep(state: int, initial: str) -> int:
    """The state after keeping a row with this role initial, or -1."""
    return {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
            (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}.get((state, initial), -1)


def _expected(state: int) -> str:
    return "a" if state == AFTER_U else "u"


def _after(state: int) -> int:
    """The state after a row of the expected role, kept, rerolled or inserted."""
    return AFTER_A if state == AFTER_U else AFTER_U


class Spool:
    """Appended chunks, in memory up to ``limit`` bytes, then in a temporary file of the
    task; read back in order or in reverse."""

    def __init__(self, limit: int = SPOOL_BYTES):
        self.limit, self.held, self.chunks, self.file = limit, 0, [], None

    def add(self, chunk, nbytes: int) -> None:
        self.chunks.append(chunk)
        self.held += nbytes
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for i, c in enumerate(self.chunks):
                if not isinstance(c, int):
                    self.file.seek(0, 2)
                    at = self.file.tell()
                    pickle.dump(c, self.file, protocol=pickle.HIGHEST_PROTOCOL)
                    self.chunks[i] = at
            self.held = 0

    def _load(self, c):
        if isinstance(c, int):
            self.file.seek(c)
            return pickle.load(self.file)
        return c

    def forward(self) -> Iterator:
        for c in self.chunks:
            yield self._load(c)

    def backward(self) -> Iterator:
        for c in reversed(self.chunks):
            yield self._load(c)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.chunks, self.file = [], None


class Repair:
    """The state of one conversation while its rows stream by."""

    BLOCK = 4096  # rows of backpointers in one chunk

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.cost = [0, INF, INF, INF]
        self.base = [0, 0, 0, 0]  # rank of the base string of each state
        self.ins = [0, 0, 0, 0]
        self.rows, self.pointers = Spool(), Spool()
        self.block: list[bytes] = []
        self.texts: list[tuple[str, str]] = []
        self.text_bytes = 0
        self.n = 0
        self.counts = [0, 0, 0, 0]  # -, blank, duplicate, truncated
        self.illegal = 0
        self.last_initial = None
        self.turns = [None, None, 0]  # least, greatest, distinct
        self.last_turn = object()
        self._close()  # position 0: inserts before the first row

    def _close(self) -> None:
        """Inserts at the current position; appends its four closure pointers."""
        cost, base, ins = list(self.cost), list(self.base), list(self.ins)
        origin = [s for s in range(4)]
        for _ in range(4):
            for s in range(4):
                if cost[s] >= INF:
                    continue
                t = _after(s)
                c, key = cost[s] + INSERT_COST, (base[s], ins[s] + 1)
                if c < cost[t] or (c == cost[t] and key < (base[t], ins[t])):
                    cost[t], base[t], ins[t], origin[t] = c, key[0], key[1], origin[s]
        self.cost, self.base, self.ins = cost, base, ins
        self.block.append(bytes((origin[s] << 2) | min(ins[s], 3) for s in range(4)))

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        self.counts[fault] += 1
        if turn is not None and turn != self.last_turn:
            lo, hi, k = self.turns
            self.turns = [turn if lo is None else min(lo, turn), turn if hi is None else max(hi, turn), k + 1]
        self.last_turn = turn
        self.n += 1
        penalty = TRUNCATED_COST if fault == TRUNCATED else 0
        best = [(INF, None, 0, 0)] * 4  # (cost, key, origin, letter) by target state
        for s in range(4):
            if self.cost[s] >= INF:
                continue
            moves = [(s, 0, DELETE_COST)]
            if fault not in (BLANK, DUPLICATE):
                kept = _keep(s, initial)
                if kept >= 0:
                    moves.append((kept, 2, KEEP_COST + penalty))
                if initial != _expected(s):
                    moves.append((_after(s), 3, REROLE_COST + penalty))
            for t, letter, c in moves:
                total = self.cost[s] + c
                key = (self.base[s], "I" * self.ins[s] + LETTERS[letter])
                if total < best[t][0] or (total == best[t][0] and key < best[t][1]):
                    best[t] = (total, key, s, letter)
        order = sorted((b[1], t) for t, b in enumerate(best) if b[0] < INF)
        rank = {t: r for r, (_, t) in enumerate(order)}
        self.cost = [b[0] for b in best]
        self.base = [rank.get(t, 0) for t in range(4)]
        self.ins = [0, 0, 0, 0]
        self.block.append(bytes((b[2] << 2 | b[3]) if b[0] < INF else 0 for b in best))
        self._close()
        self.texts.append((role, text))
        self.text_bytes += len(text) + len(role) + 64
        if self.text_bytes > SPOOL_BYTES // 4:
            self._flush_texts()
        if len(self.block) >= 2 * self.BLOCK:
            self._flush_pointers()

    def _flush_texts(self) -> None:
        self.rows.add(self.texts, self.text_bytes)
        self.texts, self.text_bytes = [], 0

    def _flush_pointers(self) -> None:
        chunk = np.frombuffer(b"".join(self.block), dtype=np.uint8).reshape(-1, 4)
        self.pointers.add(chunk, chunk.nbytes)
        self.block = []

    def _letters(self) -> list[str]:
        """The cheapest, ASCII-least edit string, by traceback over the pointers."""
        end = min((s for s in ACCEPT if self.cost[s] < INF),
                  key=lambda s: (self.cost[s], self.base[s], self.ins[s]))
        self._flush_pointers()
        out: list[str] = []
        state, closing = end, True  # pointers alternate: closure, row, closure, ...
        for chunk in self.pointers.backward():
            for entry in chunk[::-1]:
                code = int(entry[state])
                if closing:
                    out.extend("I" * (code & 3))
                    state = code >> 2
                else:
                    out.append(LETTERS[code & 3])
                    state = code >> 2
                closing = not closing
        out.reverse()
        return out

    def finish(self) -> dict:
        letters = self._letters()
        self._flush_texts()
        digest = hashlib.sha256()
        state, first = START, True
        rows = (row for chunk in self.rows.forward() for row in chunk)

        def emit(role: str, text: str) -> None:
            nonlocal first
            digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8"))
            first = False

        for letter in letters:
            if letter == "I":
                emit("assistant" if state == AFTER_U else "user", "")
                state = _after(state)
                continue
            role, text = next(rows)
            if letter == "K":
                emit(role, text)
                state = _keep(state, role[:1])
            elif letter == "R":
                emit("assistant" if state == AFTER_U else "user", text)
                state = _after(state)
        self.rows.close()
        self.pointers.close()
        lo, hi, k = self.turns
        return {"conv_id": self.conv_id, "gaps": 0 if lo is None else hi - lo + 1 - k,
                "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
                "truncated": self.counts[TRUNCATED], "illegal": self.illegal,
                "cost": min(self.cost[s] for s in ACCEPT), "audit": "".join(letters),
                "repaired_sha256": digest.hexdigest(), "n_rows": self.n}


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string, n_rows long")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a partition sorted by conversation and turn."""
    schema = _schema()
    current, key = None, None
    for batch in batches:
        done = []
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "_fault")]
        for conv, turn, role, text, fault in zip(*columns):
            if (conv,) != key:
                if current is not None:
                    done.append(current.finish())
                current, key = Repair(conv), (conv,)
            current.add(turn, role, text, fault)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.finish()], schema)


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
                      for n in (f.split()[0] for f in RESULT.split(", "))])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, _copy."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role = F.coalesce(F.col("role"), F.lit(" "))
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"), code.alias("_damage"))
    return (rows.where(F.col("_damage") != DROP)
            .withColumn("text", F.when(F.col("_damage") == EMPTY, F.lit(""))
                        .when(F.col("_damage") == UNPUNCT, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("_damage") == TO_USER, F.lit("user")).otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.when(F.col("_damage") == REPEAT, F.array(F.lit(0), F.lit(1)))
                                           .otherwise(F.array(F.lit(0)))))
            .drop("_damage"))


def repair(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 and n_rows (rows after damage). See the module for the rules."""
    spark = conversations.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = damaged(conversations)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
             F.col("role"), F.col("text"), F.col("_copy")]
    # Dealt by conversation once; the window over (conversation, role, text) needs no
    # exchange of its own, since the conversation alone already clusters it.
    dealt = rows.repartition(partitions, "conv_id")
    seen = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(
        F.col("turn").asc_nulls_first(), "_copy")
    fault = (F.when(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(BLANK))
             .when(F.row_number().over(seen) > 1, F.lit(DUPLICATE))
             .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*$"), F.lit(TRUNCATED))
             .otherwise(F.lit(0)))
    judged = dealt.withColumn("_fault", fault).sortWithinPartitions(*order)
    repaired = judged.select("conv_id", "turn", "role", "text", "_fault").mapInArrow(_stream, RESULT)
    originals = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    joined = originals.join(repaired, originals["conv_id"].eqNullSafe(repaired["conv_id"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_rows"]
    return joined.select(
        originals["conv_id"],
        *[F.coalesce(repaired[c], F.lit(0).cast("bigint")).alias(c) for c in longs[:-1]],
        F.coalesce(repaired["audit"], F.lit("")).alias("audit"),
        F.coalesce(repaired["repaired_sha256"], F.lit(empty)).alias("repaired_sha256"),
        F.coalesce(repaired["n_rows"], F.lit(0).cast("bigint")).alias("n_rows"))
