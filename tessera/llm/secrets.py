"""Operator 3, secret scans, with DataFrame functions only.

Base rules find assignments, access keys and long hex runs. The method adds candidate strings of mixed letters and
digits whose Shannon entropy, in a window that slides over them, reaches the threshold of their character class (hex,
letters and digits, or base64). The window's symbol counts are updated by the symbol that enters and the one that
leaves, and the sum of c*log2(c) by their two changes: no window is counted afresh. Candidates that match the
allow-list (UUIDs, counting runs, placeholders, paths) are suppressed; base spans stay.

A match's place is found by searching for its text from the end of the match before it. That is exact: were the same
text found earlier, the pattern would have matched there already, since none of the patterns looks around itself.

Edge cases: a null text counts as empty; a row without spans has zero counts and the digest of the empty string;
repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns and the least lengths of what they must find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates of the entropy scan, the window, and the classes with their thresholds in bits, narrowest first.
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[0-9A-Za-z]+$", 3.7), ("", 3.9))
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|dummy|sample|your[_-]",
    "(.)\\1{5,}",
    "0123456789|1234567890|abcdefghijkl|ABCDEFGHIJKL",
    "^(?:/[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*){3,}$",
)


def _placed(text: Column, matches: Column) -> Column:
    """Matches, in order, as structs of start, end (code points from 0) and the text."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        p = F.position(m, text, acc["at"])
        place = F.struct((p - 1).alias("s"), (p - 1 + F.length(m)).alias("e"), m.alias("m"))
        return F.struct((p + F.length(m)).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    return F.aggregate(matches, start, step, lambda acc: acc["out"])


def _windows(m: Column) -> Column:
    """Merged spans (s, e) within a candidate whose windows reach the threshold of its class."""
    threshold = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        threshold = F.when(m.rlike(pattern), bits).otherwise(threshold)
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    enter = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    steps = F.arrays_zip(enter.alias("i"), F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), enter), F.lit(1), F.length(m)).alias("o"))
    start = F.struct(
        F.lit(0).alias("n"),
        F.array_repeat(F.lit(0), len(SYMBOLS)).alias("c"),
        F.lit(0.0).alias("sum"),
        F.array().cast("array<struct<s:int,e:int>>").alias("out"),
        threshold.alias("t"),
    )

    def step(acc: Column, x: Column) -> Column:
        i, o, n = x["i"], x["o"], acc["n"] + 1
        at = lambda k: F.element_at(weigh, k + 1)
        entering = F.element_at(acc["c"], i)
        total = acc["sum"] + at(entering + 1) - at(entering)
        leaving = F.when(o > 0, F.element_at(acc["c"], F.greatest(o, F.lit(1))) + F.when(o == i, 1).otherwise(0))
        total = total + F.when(o > 0, at(leaving - 1) - at(leaving)).otherwise(0.0)
        counts = F.transform(acc["c"], lambda v, j: v + F.when(j + 1 == i, 1).otherwise(0) - F.when(j + 1 == o, 1).otherwise(0))
        return F.struct(n.alias("n"), counts.alias("c"), total.alias("sum"), acc["out"].alias("out"), acc["t"].alias("t"))

    def hits(acc: Column) -> Column:
        entropy = F.lit(math.log2(WINDOW)) - acc["sum"] / WINDOW
        s, e, out = acc["n"] - WINDOW, acc["n"], acc["out"]
        last = F.element_at(out, -1)
        joined = F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["e"] >= s), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), e.alias("e")))))
        grown = F.coalesce(joined, F.concat(out, F.array(F.struct(s.alias("s"), e.alias("e")))))
        return F.when((acc["n"] >= WINDOW) & (entropy >= acc["t"]), grown).otherwise(out)

    def both(acc: Column, x: Column) -> Column:
        # Two lambdas in a row, so that the new state is computed once and read several times.
        moved = F.aggregate(F.array(step(acc, x)), acc, lambda _, new: F.struct(new["n"].alias("n"), new["c"].alias("c"), new["sum"].alias("sum"), hits(new).alias("out"), new["t"].alias("t")))
        return moved

    return F.aggregate(steps, start, both, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        "t",
        F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(0)).alias("a"),
        F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)).alias("k"),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)).alias("h"),
        F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("c"),
    )
    t = F.col("t")
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("|".join(f"(?:{p})" for p in ALLOW))
    placed = found.select(
        "doc_id",
        F.filter(_placed(t, F.col("a")), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        F.filter(_placed(t, F.col("k")), lambda x: F.length(x["m"]) >= ACCESS_LEAST).alias("access"),
        _placed(t, F.col("h")).alias("hex"),
        F.filter(_placed(t, F.col("c")), lambda x: mixed(x["m"])).alias("cand"),
    )
    spans = F.flatten(F.transform("cand", lambda x: F.transform(_windows(x["m"]), lambda w: F.struct((x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e")))))
    placed = placed.withColumn("entropy", spans)

    def line(*kinds: str) -> Column:
        def marked(kind: str) -> Column:
            return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

        each = [marked(k) for k in kinds]
        name = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat(F.element_at(name, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")

    return placed.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(line(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        line(*KINDS).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
