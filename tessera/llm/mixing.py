"""Operator 1, mixing sources to target weights: hierarchical budgeting.

Documents hang in a tree: domain, language, source. The total token budget flows down it. At each node the children
get shares in proportion to their integer weights; a child whose subtree cannot supply its share (tokens times the
epochs allowed) gives what it has, and its shortage goes to its siblings, by weight, until they are full as well. Since
a node never gets more than its subtree can supply, shortages reach an ancestor's other branches only after all
siblings are full. All of this is exact integer arithmetic in windows over the small tree tables.

A leaf with budget b and t tokens takes b div t whole epochs, and from the next one a prefix: its documents in the
order of a hash seeded with seed and epoch, as far as their tokens fit into the rest. The prefix is found by sums over
ranges of the hash, so no task holds a whole leaf, and comes down to one threshold for each leaf: selecting is then a
comparison in the scan, and texts are never shuffled.

Edge cases: null levels are nodes of their own; a null or blank text has no tokens and is selected where its hash lies
in the prefix, or in whole epochs; rows that repeat a doc_id stand or fall together; weights of zero give nothing;
an empty table gives no rows; of other columns, mix_rows returns all, whatever their names, and mix none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, null_key, stored

LEVELS = ("domain", "lang", "source")
#: Largest tree, in leaves, that is sent to all executors.
BROADCAST_LEAVES = 50_000


def domain_of(source: Column) -> Column:
    """The synthetic tables have no domain: sources are dealt to up to 16 by their MD5."""
    return F.when(source.isNull(), F.lit("none")).otherwise(F.concat(F.lit("d"), F.left(F.md5(source.cast("binary")), F.lit(1))))


def _weight(key: Column, weights: dict) -> Column:
    """A weight for each of the names; names that are not listed weigh weights["*"], or 1."""
    return reduce(lambda out, kv: F.when(key == "+" + kv[0], F.lit(int(kv[1]))).otherwise(out), [kv for kv in weights.items() if kv[0] != "*"], F.lit(int(weights.get("*", 1)))).cast("long")


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add share: the parent's budget dealt to its children by weight w, none above its capacity cap."""
    nodes = nodes.withColumn("w", F.greatest("w", F.lit(0))).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
    family = Window.partitionBy(*parents) if parents else Window.partitionBy()
    by_ratio = family.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), name)
    big = lambda c: f"cast({c} as decimal(38,0))"
    nodes = (
        nodes.withColumn("rn", F.row_number().over(by_ratio))
        .withColumn("brem", F.col("budget") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("wrem", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.expr(f"w = 0 or {big('cap')} * wrem <= {big('w')} * brem"))
        .withColumn("first", F.min(F.when(~F.col("full"), F.col("rn"))).over(family))
        .withColumn("full", F.col("first").isNull() | (F.col("rn") < F.col("first")) | (F.col("w") == 0))
        .withColumn("brem", F.max(F.when(F.col("rn") == F.col("first"), F.col("brem"))).over(family))
        .withColumn("wrem", F.max(F.when(F.col("rn") == F.col("first"), F.col("wrem"))).over(family))
        .withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"({big('w')} * brem) div wrem")))
    )
    # What rounding down left over goes, a token each, to the first of those that are not full.
    left = F.col("brem") - F.sum(F.when(~F.col("full"), F.col("share"))).over(family)
    turn = F.row_number().over(Window.partitionBy(*parents, "full").orderBy(name))
    nodes = nodes.withColumn("left", left).withColumn("turn", turn)
    return nodes.withColumn("share", F.col("share") + F.when(~F.col("full") & (F.col("turn") <= F.col("left")), 1).otherwise(0)).drop("rn", "brem", "wrem", "full", "first", "left", "turn", "budget")


def budgets(leaves: DataFrame, weights: dict[str, dict], numerator: int, denominator: int, max_epochs: int) -> DataFrame:
    """leaves (k_domain, k_lang, k_source, tokens) with share: each leaf's token budget."""
    keys = [f"k_{x}" for x in LEVELS]
    weighty = reduce(lambda a, b: a & b, [_weight(F.col(f"k_{x}"), weights.get(x, {})) > 0 for x in LEVELS])
    caps = leaves.withColumn("cap", F.when(weighty, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    whole = caps.agg(F.least(F.expr(f"sum(tokens) * {numerator} div {denominator}"), F.sum("cap")).alias("budget"))
    parent = whole
    for depth in range(1, len(keys) + 1):
        own = keys[:depth]
        nodes = caps.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("w", _weight(F.col(own[-1]), weights.get(LEVELS[depth - 1], {})))
        nodes = nodes.join(parent, own[:-1]) if depth > 1 else nodes.join(F.broadcast(parent))
        filled = _fill(nodes, own[:-1], own[-1])
        parent = filled.select(*own, F.col("share").alias("budget"))
    return filled.select(*keys, "tokens", "share")


def plan(rows: DataFrame, weights: dict[str, dict], numerator: int = 3, denominator: int = 5, max_epochs: int = 4, seed: int = 11) -> DataFrame:
    """For each leaf: tokens, share, whole epochs, and the last hash of the prefix taken from the next epoch.

    rows: doc_id, n_tokens and the keys k_domain, k_lang, k_source.
    """
    keys = [f"k_{x}" for x in LEVELS]
    leaves = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    dealt = stored(budgets(leaves, weights, numerator, denominator, max_epochs), "mix").where("share > 0 and tokens > 0")
    dealt = dealt.withColumn("full", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens"))
    partial = _with_leaf(rows, dealt.where("rest > 0").select(*keys, "full", "rest"), keys).withColumn("h", order_hash(seed, "full"))
    # Rows of one hash stand or fall together, so they are summed first: a repeated doc_id is one row from here on.
    partial = stored(partial.groupBy(*keys, "rest", "h").agg(F.sum("n_tokens").alias("n_tokens")), "hashes")
    partial = partial.withColumn("a", F.left("h", F.lit(2))).withColumn("b", F.left("h", F.lit(3)))
    # Sums of the ranges before, in two steps: 256 ranges of a leaf, then 16 parts of each. They are stored, or the join
    # and the window below would reuse their partitioning by leaf, and a large leaf would be one task.
    fine = stored(partial.groupBy(*keys, "a", "b").agg(F.sum("n_tokens").alias("s")), "sums")
    rough = fine.groupBy(*keys, "a").agg(F.sum("s").alias("s"))
    rough = stored(rough.select(*keys, "a", (F.sum("s").over(Window.partitionBy(*keys).orderBy("a")) - F.col("s")).alias("base")), "sums")
    inner = F.sum("s").over(Window.partitionBy(*keys, "a").orderBy("b")) - F.col("s")
    sums = stored(fine.withColumn("inner", inner).join(rough, [*keys, "a"]).select(*keys, "b", (F.col("base") + F.col("inner")).alias("before")), "sums")
    partial = partial.join(sums, [*keys, "b"])
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*keys, "b").orderBy("h"))
    last = partial.withColumn("upto", upto).where("upto <= rest").groupBy(*keys).agg(F.max("h").alias("last"))
    return dealt.join(last, keys, "left").select(*keys, "tokens", "share", "full", "last")


def order_hash(seed: int, epoch: str) -> Column:
    """Where a document stands in an epoch's order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _with_leaf(rows: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    small = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, keys)


def keyed(docs: DataFrame) -> DataFrame:
    domain = domain_of(F.col("source"))
    return docs.withColumns({"k_domain": null_key(domain), "k_lang": null_key("lang"), "k_source": null_key("source")})


def mix(docs: DataFrame, weights: dict[str, dict], numerator: int = 3, denominator: int = 5, max_epochs: int = 4, seed: int = 11) -> DataFrame:
    """doc_id, lang, source, n_tokens and the leaf's keys of each selected row, once for each epoch that selected it."""
    light = stored(_light(docs), "mix")
    return chosen(light, plan(light, weights, numerator, denominator, max_epochs, seed), seed)


def _light(docs: DataFrame) -> DataFrame:
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return keyed(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "k_domain", "k_lang", "k_source", tokens.alias("n_tokens"))


def mix_rows(docs: DataFrame, weights: dict[str, dict], numerator: int, denominator: int, max_epochs: int, seed: int) -> DataFrame:
    """The selected rows with all their columns, whatever these are called: a row travels as one value."""
    leaves = plan(stored(_light(docs), "mix"), weights, numerator, denominator, max_epochs, seed)
    return chosen(keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "lang", "source")), leaves, seed).select("row.*")


def chosen(rows: DataFrame, leaves: DataFrame, seed: int = 11) -> DataFrame:
    """rows (with their keys) by the plan's epochs and thresholds."""
    keys = [f"k_{x}" for x in LEVELS]
    leaves = stored(leaves, "plan").select(*keys, "full", "last")
    out = _with_leaf(rows, leaves, keys)
    extra = F.when(F.col("last").isNotNull() & (order_hash(seed, "full") <= F.col("last")), 1).otherwise(0)
    out = out.withColumn("__n", (F.col("full") + extra).cast("int")).where("__n > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n", "full", "last")
