"""Personal data: expressions propose spans, checksums confirm them, context words adjust their scores.

Everything is a Spark SQL expression.  Places of matches, which SQL functions
don't return, follow from the lengths of the matches and of the gaps between
them.  Quantifiers are possessive and runs begin at their first character, so
no text, however long, makes the matcher go back or recurse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidmill.llm.common import table

#: The base kinds, in order of report, and the kinds this operator adds.
BASE = ["email", "ip", "card", "phone"]
MORE = ["iban", "ssn"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (cheap guard, expression, score before context, context words, score a context word adds)
KINDS: dict[str, tuple[Callable[[Column], Column], str, float, str, float]] = {
    "email": (lambda t: t.contains("@"), rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", 0.1),
    "ip": (lambda t: t.contains("."), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|address|host|server", 0.3),
    "card": (lambda t: t.rlike("[0-9]"), r"[0-9]++(?:[\x20-][0-9]++)*+", 0.7, "card|visa|credit|pay", 0.3),
    "phone": (lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "tel|phone|call|fax|mobile", 0.3),
    "iban": (lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), r"\b[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", 0.8, "iban|account|bank", 0.2),
    "ssn": (lambda t: t.contains("-"), r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.3, "ssn|social|security", 0.4),
}
#: Spans of the added kinds count from this score on, those of the base kinds always.
LEAST = 0.5
#: Code points before a span in which context words are sought.
NEAR = 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the decimal digits pass the Luhn check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, letters and digits only, leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


#: Code points of a text's chunks.
CHUNK = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(t: Column) -> Column:
    """The text in chunks of CHUNK code points, so that a cut needn't begin to read at the text's start."""
    return F.when(F.length(t) > CHUNK, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(t))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """Code points from start (from 0) on."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + length) / CHUNK).cast("int")
    return F.when(length <= 0, "").otherwise(F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length))


def _running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over 0 and all earlier elements, for each element of a bound array of ints.

    In blocks of about the cube root of its size, over which results are
    carried: n ** (4/3) steps instead of the square that growing an array takes.
    """
    fold = lambda a: F.aggregate(a, F.lit(0), op)

    def blocks(n: Column) -> Column:
        b = F.ceil(F.cbrt(F.size(x))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / b).cast("int")), lambda k: fold(F.slice(x, k * n + 1, n)))
        carried = _let(sums, lambda s: F.transform(s, lambda v, k: fold(F.slice(s, F.lit(1), k))))
        return _let(carried, lambda c: F.transform(x, lambda v, i: op(F.get(c, F.floor(i / n).cast("int")), fold(F.slice(x, i - i % n + 1, i % n)))))

    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(_let(F.ceil(F.cbrt(F.size(x))).cast("int"), blocks))


def _placed(t: Column, m: Column, chunks: Column, kind: str) -> Column:
    """Confirmed and scored spans of the matches m of one kind in t."""
    _, pattern, score, near, more = KINDS[kind]
    gaps = F.transform(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(m)), lambda g: F.length(g))

    def at(b: Column) -> Column:
        """From the gaps before the matches and the steps from match to match: the matches with their starts."""
        before = _running(b["step"], lambda x, y: x + y)
        starts = F.zip_with(before, b["gap"], lambda x, gap: x + gap)
        return F.filter(F.zip_with(m, starts, lambda x, s: F.struct(x.alias("m"), s.alias("s"))), lambda x: _confirmed(kind, x["m"]))

    def scored(x: Column) -> Column:
        before = F.lower(_cut(chunks, F.greatest(x["s"] - NEAR, F.lit(0)), F.least(x["s"], F.lit(NEAR))))
        total = F.lit(score) + F.when(before.rlike(rf"\b({near})"), F.lit(more)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), total.alias("score"))

    bound = _let(gaps, lambda g: F.struct(g.alias("gap"), F.zip_with(g, m, lambda gap, x: gap + F.length(x)).alias("step")))
    out = F.transform(_let(bound, at), scored)
    if kind in MORE:
        out = F.filter(out, lambda x: x["score"] >= LEAST)
    return F.when(F.size(m) > 0, out).otherwise(F.array().cast(SPAN))


def spans(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: array of (kind, start, end, score) by kind as listed, then start; code points, end exclusive.

    Null and empty texts have none.  An existing column of that name is replaced.
    """
    df = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__t")
    for kind, (guard, pattern, _, _, _) in KINDS.items():
        df = df.withColumn(f"__m_{kind}", F.when(guard(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    any_ = F.lit(False)
    for kind in KINDS:
        any_ = any_ | F.coalesce(F.size(f"__m_{kind}") > 0, F.lit(False))
    found = _let(_chunks(t), lambda c: F.concat(*[_placed(t, F.col(f"__m_{kind}"), c, kind) for kind in KINDS]))
    return df.withColumn(into, F.when(any_, found).otherwise(F.array().cast(SPAN))).drop("__t", *[f"__m_{k}" for k in KINDS])


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by the kind of its first in angle brackets; null stays null."""
    order = F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))

    def parts(b: Column) -> Column:
        # up to where earlier spans reach, the text is told; a span that begins before that is part of their union
        reach = _running(b["ends"], lambda p, q: F.greatest(p, q))
        told = F.zip_with(b["x"], reach, lambda x, p: F.when(x["s"] >= p, F.concat(_cut(b["c"], p, x["s"] - p), F.lit("<"), F.upper(x["k"]), F.lit(">"))).otherwise(""))
        last = F.array_max(b["ends"])
        return F.concat(F.array_join(told, ""), _cut(b["c"], last, F.length(text) - last))

    bound = _let(order, lambda x: F.struct(x.alias("x"), F.transform(x, lambda y: y["e"]).alias("ends"), _chunks(text).alias("c")))
    return F.when(F.size(found) == 0, text).otherwise(_let(bound, parts))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    df = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kinds: F.filter("pii", lambda x: x["kind"].isin(kinds))
    return df.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(of(BASE)), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def _sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": KINDS["iban"][1],
        "ssn": KINDS["ssn"][1],
    }
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    bare = "replace(x.m, ' ', '')"
    moved = f"({bare}[5:] || {bare}[:4])"
    value = f"CASE WHEN ascii({moved}[i]) >= 65 THEN ascii({moved}[i]) - 55 ELSE ascii({moved}[i]) - 48 END"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[-i] AS INTEGER) WHEN CAST({digits}[-i] AS INTEGER) > 4 THEN 2 * CAST({digits}[-i] AS INTEGER) - 9 ELSE 2 * CAST({digits}[-i] AS INTEGER) END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(1, length({bare}) + 1), lambda i: CAST({value} AS BIGINT)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END, CAST(0 AS BIGINT)) = 1",
        "ssn": rf"NOT regexp_matches(x.m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(t[greatest(x.s - {NEAR}, 0) + 1 : x.s]), '\b({KINDS['ssn'][3]})')",
    }
    cols = []
    for k, re in plain.items():
        start = "coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)"
        cols.append(f"""{k} AS (SELECT rid, coalesce(list_transform(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'm': m[i]}}), lambda x: {valid[k]}), lambda x: '{k}:' || x.s || ':' || (x.s + length(x.m))), []) AS s
  FROM (SELECT rid, t, regexp_extract_all(t, '{re}') AS m, string_split_regex(t, '{re}') AS g FROM d))""")
    base = " || ".join(f"{k}.s" for k in BASE)
    joins = " ".join(f"JOIN {k} USING (rid)" for k in plain)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(cols)}
SELECT doc_id, {", ".join(f"CAST(len({k}.s) AS BIGINT) AS n_{k}" for k in BASE)}, sha256(array_to_string({base}, ',')) AS base_sha256,
       array_to_string({base} || {" || ".join(f"{k}.s" for k in MORE)}, ',') AS spans FROM d {joins}"""


OP9_SQL = _sql()
