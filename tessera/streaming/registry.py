"""Candidates as a stream (T1, T2): a keyed registry in state, or micro-batches through the batch plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "key string, cand_id long, outcome string, first_id long, sources array<string>"
STATE = "first_id long, sources array<string>"


def outcomes(stream: DataFrame) -> DataFrame:
    """A stream of NEW and DUPLICATE outcomes: the first of each key is kept in state, with the sources seen since.

    stream: the schema of candidates. Tiers that need more than one key (vetoes, near names) are the batch plan's.
    """
    none = F.array().cast("array<string>")
    k = F.coalesce(F.filter(F.transform("phone_numbers", lambda p: F.regexp_replace(p["value"], r"\D", "")), lambda d: F.length(d) >= 7), none)
    key = F.coalesce(F.concat(F.lit("d:"), F.when(F.col("domain") != "", F.col("domain"))), F.concat(F.lit("p:"), F.right(F.try_element_at(k, F.lit(1)), F.lit(10))), F.concat(F.lit("i:"), F.col("cand_id").cast("string")))
    rows = stream.select(key.alias("key"), "cand_id", F.coalesce("sources", none).alias("sources"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, seen = state.get if state.exists else (None, [])
        seen = list(seen)
        for b in batches:
            out = []
            for r in b.sort_values("cand_id").itertuples():
                outcome = "DUPLICATE" if first is not None else "NEW"
                first = int(r.cand_id) if first is None else first
                seen += [s for s in r.sources if s not in seen]
                out.append((key[0], int(r.cand_id), outcome, first, list(seen)))
            yield pd.DataFrame(out, columns=["key", "cand_id", "outcome", "first_id", "sources"])
        state.update((first, seen))

    return rows.groupBy("key").applyInPandasWithState(update, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run the batch plan on every micro-batch as it arrives; returns the query."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type with a watermark; the same plan serves a batch."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
