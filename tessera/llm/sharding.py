"""Operator 4, sharding: proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; rank r of n gets the fractional rank (2r-1)/2n; all rows are
sorted by it and the sequence is cut into equal runs. Every run holds every source in the proportion of the mixture,
and the sizes of shards differ by one row at most (law "rows").

Both rankings are distributed: rows are dealt into ranges of their sort key (a uniform hash of doc_id, text checksum and
size, then the fractional rank, which is uniform as well), ranked inside a range, and shifted by the counts of the ranges
before. There is a range for each RANGE_ROWS rows, up to MOST_RANGES. No task ever holds a whole source, however large
its share; rows that are equal in all that is hashed may swap places freely, so a range with more than HOT_ROWS of them
is parted by row numbers as well.

Edge cases: a null source is a source of its own; a null text has size 1 and the checksum of an empty one; repeated
rows get slots of their own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, null_key, stored

RANGE_ROWS, MOST_RANGES, HOT_ROWS = 500, 65_536, 65_536


def ranked(df: DataFrame, keys: list[str], bucket: list[str], order: list, name: str) -> DataFrame:
    """Add the 1-based rank within keys by (*bucket, *order), and name_n, the number of rows of the keys."""
    counts = df.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    counts = counts.withColumn("__before", F.sum("__c").over(w.orderBy(*bucket)) - F.col("__c"))
    counts = counts.withColumn(f"{name}_n", F.sum("__c").over(w)).drop("__c")
    # Stored, or the join and the window below would reuse its partitioning by keys alone, and a large key is one task.
    counts = stored(counts, "ranks")
    inside = F.row_number().over(Window.partitionBy(*keys, *bucket).orderBy(*order))
    out = df.withColumn("__in", inside).join(counts, [*keys, *bucket])
    return out.withColumn(name, F.col("__before") + F.col("__in")).drop("__before", "__in")


def parted(rows: DataFrame) -> DataFrame:
    """Add __part, which splits ranges (__key, __hb) of too many rows by the rows' stored numbers; mostly 0."""
    heavy = rows.groupBy("__key", "__hb").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > HOT_ROWS)
    heavy = stored(heavy.select("__key", "__hb", F.expr(f"__c div {HOT_ROWS} + 1").alias("__parts")), "hot")
    if not heavy.limit(1).count():
        return rows.withColumn("__part", F.lit(0))
    # At most a row for each HOT_ROWS rows of the table.
    part = F.coalesce(F.pmod(F.xxhash64("__no"), F.col("__parts")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(heavy) if heavy.limit(1_000_001).count() <= 1_000_000 else heavy, ["__key", "__hb"], "left").withColumn("__part", part).drop("__parts")


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard for each row of docs."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        null_key("source").alias("__key"),
    )
    rows = cut(rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")).withColumn("__no", F.monotonically_increasing_id()))
    ranges = min(MOST_RANGES, max(16, rows.count() // RANGE_ROWS))
    rows = parted(rows.withColumn("__hb", F.pmod("__h", F.lit(ranges)).cast("int")))
    rows = ranked(rows, ["__key"], ["__hb", "__part"], ["__h", "doc_id", "text_crc32", "size"], "__r")
    twice = 2 * F.col("__r") - 1
    rows = rows.withColumn("__f", twice / (2 * F.col("__r_n"))).withColumn("__fb", F.expr(f"int(((2 * __r - 1) * {ranges}) div (2 * __r_n))"))
    rows = ranked(cut(rows), [], ["__fb"], ["__f", "__key", "__r"], "__p")
    return rows.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(f"int(((__p - 1) * {n_shards}) div __p_n)").alias("shard"),
        F.expr(f"__p - 1 - ((((__p - 1) * {n_shards}) div __p_n) * __p_n + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
