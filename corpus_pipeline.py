"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads
it again for the next stage. All stages but the last return the columns of documents. The last gives each row's place:
doc_id, source, size, text_crc32, law, shard, slot.

What becomes of unusual rows: a null or blank text holds nothing toxic and no benchmark item, is one text with all other
such texts to the near-duplicate stage, has no tokens in the mixture and size 1 in its shard. A row without a doc_id is
never a duplicate and otherwise treated as any other. Rows that repeat a doc_id are judged by their texts for toxicity
and leaks; as duplicates and in the mixture they stand or fall together; each has a slot. Extra columns pass through all
stages but the last, whatever their names. An empty table gives an empty table.

Memory: the stages that hand texts to Python lower the session's bound on an Arrow batch to BATCH_BYTES, since executors
and their Python workers hold a batch several times over. A lower bound that is set already stays. It says how rows are
parted on their way, never which rows go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import stored, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import mix_rows
from tessera.llm.neardup import drop_near_duplicates
from tessera.llm.queries import MIXTURE
from tessera.llm.sharding import interleave
from tessera.llm.toxicity import keep_clean, train

#: The mixture asks for this share of the tokens that are left, from at most two epochs of a leaf.
NUMERATOR, DENOMINATOR, EPOCHS, SEED = 9, 10, 2, 11
#: Bytes of rows that are handed to Python at once, or one row; Spark's default is 64 MB.
BATCH_BYTES, BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: SQL cannot express a chain's marginals or fingerprints.
ORACLE_SQL = None


def in_small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session. It stays so: a stage's result is computed after the stage has returned."""
    now = spark.conf.get(BATCH)
    if now.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_rows(docs, MIXTURE, NUMERATOR, DENOMINATOR, EPOCHS, SEED)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return interleave(docs, n_shards=16, seed=7).drop("grown_shard")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
