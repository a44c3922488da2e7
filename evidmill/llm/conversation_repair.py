"""Repair of conversation structure by composition of weighted finite-state machines."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidmill.llm.common import table, written

SPACE = " \t\n\x0b\x0c\r"
#: Acceptor of the role initials (s?(ua)+)?: state and initial to state.
START, HEAD, OPEN, DONE = range(4)
GRAMMAR = {(START, "s"): HEAD, (START, "u"): OPEN, (HEAD, "u"): OPEN, (OPEN, "a"): DONE, (DONE, "u"): OPEN}
FINAL = (START, DONE)
#: Costs of the edits, and what an undeleted truncated row costs besides.
COST, TRUNCATED = {"D": 2, "I": 5, "K": 0, "R": 1}, 5
#: Inserts in a row that the transducer counts; a third would come back to a state of the grammar already seen, at a cost.
INSERTS = 2
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = 1, 2, 3


def edits(inserted: int, row: tuple[str, int] | None) -> Iterator[tuple[str, int, str, int]]:
    """Arcs of the edit transducer: label, cost, initial written ('' for none), inserts since the last row.

    ``row`` is (initial, fault) of the row that is read, or None for the arcs that read none.
    """
    if row is None:
        if inserted < INSERTS:
            for x in ROLES:
                yield "I", COST["I"], x, inserted + 1
        return
    initial, fault = row
    yield "D", COST["D"], "", 0
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        yield "K", COST["K"] + more, initial, 0
        for x in ROLES:
            yield "R", COST["R"] + more, x, 0


@lru_cache(maxsize=1024)
def arcs(state: tuple[int, int], row: tuple[str, int] | None) -> tuple[tuple[str, int, tuple[int, int]], ...]:
    """Arcs of transducer and grammar composed, from (inserts, grammar state); made when first asked for.

    The grammar goes on from a state by one of u and a at most, so a state has
    no two arcs of one label.
    """
    inserted, g = state
    found = []
    for label, cost, x, then in edits(inserted, row):
        to = g if not x else GRAMMAR.get((g, x))
        if to is not None:
            found.append((label, cost, (then, to)))
    return tuple(found)


STATES = [(e, g) for e in range(INSERTS, -1, -1) for g in range(4)]
NUMBER = {s: i for i, s in enumerate(STATES)}


def shortest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and labels of the best path that reads all rows (initial, fault) and ends in a final state.

    Weights are (cost, label string), compared in that order.  States of the
    composition are (rows read, inserts, grammar state): arcs lead to more rows
    or more inserts, so they are settled from the last row back.  A string is
    its first label before the string of the state that follows, and the labels
    of a state's arcs differ: cost, then label decides, and the strings need not
    be kept.  Takes 12 bytes a row.
    """
    n, far = len(rows), 1 << 60
    chosen = bytearray(len(STATES) * (n + 1))
    later = [far] * len(STATES)
    for i in range(n, -1, -1):
        row = rows[i] if i < n else None
        now = [far] * len(STATES)
        for k, state in enumerate(STATES):  # more inserts first: they are what fewer lead to
            best = (0, "") if row is None and state[1] in FINAL else (far, "~")
            for label, cost, to in arcs(state, None):
                best = min(best, (cost + now[NUMBER[to]], label))
            for label, cost, to in arcs(state, row) if row is not None else ():
                best = min(best, (cost + later[NUMBER[to]], label))
            now[k] = best[0]
            chosen[i * len(STATES) + k] = ord(best[1] or "\0")
        later = now
    state, i, labels = (0, START), 0, []
    total = later[NUMBER[state]]
    while label := chr(chosen[i * len(STATES) + NUMBER[state]]).strip("\0"):
        state = next(to for x, _, to in arcs(state, None if label == "I" else rows[i]) if x == label)
        labels.append(label)
        i += label != "I"
    return total, "".join(labels)


class Audit:
    """What is known of one conversation while its rows pass in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.seen: set[bytes] = set()
        self.count = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, cut: bool) -> None:
        initial = initial if initial in ("s", "u", "a") else "?"
        fault = BLANK if blank else DUPLICATE if digest in self.seen else CUT if cut else 0
        self.seen.add(digest)
        if fault:
            self.count[fault] += 1
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.rows.append((initial, fault))
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def result(self) -> tuple:
        cost, labels = shortest(self.rows)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.count[BLANK], self.count[DUPLICATE], self.count[CUT], self.illegal, cost, labels


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _plain(turns: DataFrame, key: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """Rows with nulls of role and text as one space, and a digest of both by which equal turns are ordered."""
    filled = turns.select(F.col(key).alias("conv"), F.col(turn).cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))), F.coalesce(present, F.lit(False)).alias("present"))
    return filled.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _runs(batches: Iterator[pa.RecordBatch], first: Callable, each: Callable, last: Callable, out: Callable) -> Iterator[pa.RecordBatch]:
    """Calls first, each and last over the conversations of sorted rows, and hands on what they made, batch by batch."""
    key, state = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or row[0] != key:
                if state is not None:
                    last(key, state)
                key, state = row[0], first()
            each(state, row)
        yield from out()
    if state is not None:
        last(key, state)
    yield from out()


def audits(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit (the cheapest edits).

    Rows go by turn, nulls first; those of one turn by role, then by a digest of
    role and text, so equal rows are neighbours.  Nulls of role and text are one
    space; a null key is a conversation like others.  ``present`` false: the
    row only makes its conversation known; one without other rows gets zeros and
    no edits.  Only initials, faults and digests are shuffled: texts stay where
    they are read.  The rows of a conversation pass one task in order (its
    shortest path is one), which holds some 300 bytes a row and no text.
    Other columns are left out.
    """
    kind = turns.schema[key].dataType
    plain = _plain(turns, key, turn, role, text, F.lit(True) if present is None else present)
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = plain.select("conv", "turn", "role", "digest", "present", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def each(state: Audit, row: tuple) -> None:
            _, at, role, digest, here, blank, cut = row
            if here:
                state.add(at, role[:1], digest, blank, cut)

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*done, strict=True)) or [()] * 8
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(kind)), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], ["conv", *COUNTS, "audit"])

        yield from _runs(batches, Audit, each, lambda k, state: done.append((k, *state.result())), out)

    schema = f"conv {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
    return _by_conversation(narrow, "turn", "role", "digest").mapInArrow(run, schema).withColumnRenamed("conv", key)


class Repair:
    """Applies a conversation's edits to its rows as they pass; yields (label, turn, role, text) of those that stay."""

    def __init__(self) -> None:
        self.audit, self.at, self.made, self.head, self.known = "", 0, 0, 0, None

    def _role(self) -> str:
        return ROLES["ua"[(self.made - self.head) % 2]]

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield "I", None, self._role(), ""
            self.at, self.made = self.at + 1, self.made + 1

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        label = self.audit[self.at]
        self.at += 1
        if label != "D":
            if label == "K" and not self.made and role[:1] == "s":
                self.head = 1
            yield label, turn, role if label == "K" else self._role(), text
            self.made += 1


def _repair(turns: DataFrame, audited: DataFrame, key: str, turn: str, role: str, text: str, present: Column | None, run: Callable, schema: str) -> DataFrame:
    """Rows and audits of a conversation, the audit first, in one sorted stream for ``run``."""
    plain = _plain(turns, key, turn, role, text, F.lit(True) if present is None else present).where("present")
    rows = plain.select("conv", F.lit(1).alias("part"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), *(F.lit(None).cast("bigint").alias(c) for c in COUNTS))
    heads = audited.select(F.col(key).alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit", *COUNTS)
    return _by_conversation(heads.unionByName(rows), "part", "turn", "role", "digest").mapInArrow(run, schema).withColumnRenamed("conv", key)


def repaired(turns: DataFrame, audited: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Rows of the repaired conversations: key, place (from 0), edit, turn (null if inserted), role, text; see audits()."""
    kind = turns.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def each(state: Repair, row: tuple) -> None:
            if row[1] == 0:
                state.audit = row[6]
            else:
                for x in state.row(row[2], row[3], row[5]):
                    done.append((row[0], state.made, *x))

        def last(k: object, state: Repair) -> None:
            for x in state.inserts():
                done.append((k, state.made, *x))

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*done, strict=True)) or [()] * 6
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "edit", "turn", "role", "text"])

        yield from _runs(batches, Repair, each, last, out)

    return _repair(turns, audited, key, turn, role, text, present, run, f"conv {kind.simpleString()}, place bigint, edit string, turn bigint, role string, text string")


def digested(turns: DataFrame, audited: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The audits with repaired_sha256, of the repaired rows as role:text joined by newlines; the text passes, none is gathered."""
    kind = turns.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def first() -> tuple:
            return Repair(), hashlib.sha256()

        def put(state: Repair, h, rows: Iterator[tuple]) -> None:
            for _, _, r, t in rows:
                h.update(f"{chr(10) if state.made else ''}{r}:{t}".encode())

        def each(both: tuple, row: tuple) -> None:
            state, h = both
            if row[1] == 0:
                state.audit, state.known = row[6], row[7:]
            else:
                put(state, h, state.row(row[2], row[3], row[5]))

        def last(k: object, both: tuple) -> None:
            state, h = both
            put(state, h, state.inserts())
            done.append((k, *state.known, state.audit, h.hexdigest()))

        def out() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*done, strict=True)) or [()] * 9
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(kind)), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], ["conv", *COUNTS, "audit", "repaired_sha256"])

        yield from _runs(batches, first, each, last, out)

    schema = f"conv {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _repair(turns, audited, key, turn, role, text, present, run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by the checksum of conv_id:turn; a dropped row stays with present = false."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    hurt = turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    known = written(audits(rows, present=F.col("present")), "audits")
    return digested(rows, known, present=F.col("present"))


def _sql() -> str:
    """The same in SQL: a weight is the cost in nine digits before its labels, so the least string is the best path."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "range(256)"
    for _ in range(8):
        byte = f"list_transform({byte}, lambda c: {step})"
    far = "'999999999'"
    names = ["start", "head", "open", "done"]

    def add(cost: str, label: str, w: str) -> str:
        return f"CASE WHEN {w} >= {far} THEN {far} ELSE lpad(CAST(CAST({w}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{label}' || {w}[10:] END"

    keep = {"start": "CASE i WHEN 's' THEN v.head WHEN 'u' THEN v.open ELSE 'x' END", "head": "CASE i WHEN 'u' THEN v.open ELSE 'x' END", "open": "CASE i WHEN 'a' THEN v.done ELSE 'x' END", "done": "CASE i WHEN 'u' THEN v.open ELSE 'x' END"}
    then = {"start": "open", "head": "open", "open": "done", "done": "open"}
    more = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    read = ", ".join(f"least({add('2', 'D', f'v.{g}')}, CASE WHEN fault IN (1, 2) THEN {far} ELSE {add(more, 'K', f'({keep[g]})')} END, CASE WHEN fault IN (1, 2) THEN {far} ELSE {add(f'1 + {more}', 'R', f'v.{then[g]}')} END) AS {g}" for g in names)
    insert = ", ".join(f"least({g}, {add('5', 'I', then[g])}, {add('10', 'II', then[then[g]])}) AS {g}" for g in names)
    return f"""
WITH RECURSIVE t AS (SELECT {byte} AS bytes),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, bytes[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS kind
  FROM (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations), t),
r0 AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS n, role[1:1] AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM r0),
r AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM r1),
c AS (SELECT conv_id, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v(conv_id, n, start, head, open, done) AS (
  SELECT conv_id, rows, '000000000', '000000010II', '000000005I', '000000000' FROM c
  UNION ALL SELECT conv_id, n, {insert} FROM (SELECT v.conv_id, v.n - 1 AS n, {read} FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.n = v.n)),
best AS (SELECT conv_id, CAST(start[1:9] AS BIGINT) AS cost, start[10:] AS audit FROM v WHERE n = 0),
e0 AS (SELECT conv_id, label, p, sum(CASE WHEN label = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS n, sum(CASE WHEN label = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS made FROM (SELECT conv_id, unnest(string_split(audit, '')) AS label, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> '')),
e AS (SELECT e0.conv_id, p, made, CASE WHEN label = 'K' THEN role END AS own, CASE WHEN label = 'I' THEN '' ELSE text END AS text, max(CASE WHEN made = 1 AND label = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e0.conv_id) AS head FROM e0 JOIN r ON r.conv_id IS NOT DISTINCT FROM e0.conv_id AND r.n = greatest(e0.n, 1) WHERE label <> 'D'),
s AS (SELECT conv_id, string_agg(coalesce(own, CASE WHEN (made - 1 - head) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS body FROM e GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP12_SQL = _sql()
