"""Helpers shared by the training-data operators: shared storage, lineage cuts, table reading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table written once in the shared folder, which survives lost executors."""
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: a lineage cut that keeps columns prunable."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more: what came of it must be stored itself."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.tessera_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key from which on join_heavy keeps it out of the shuffle, and most keys that it sends to all executors.
HEAVY, BROADCAST_KEYS = 4096, 1_000_000


def join_heavy(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with named, which has each key once and how many rows it has: no task gets all rows of a large key.

    Large keys are joined by a broadcast after their number is checked; beyond it Spark splits skewed partitions.
    """
    large = named.where(F.col(count) > HEAVY)
    if large.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return rows.join(named, key)
    small = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(named.where(F.col(count) <= HEAVY), key)
    return small.unionByName(rows.join(F.broadcast(large), key))


def remove(spark: SparkSession, uris: list[str]) -> None:
    """Delete files of the shared folder that nothing reads any more."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def null_key(column) -> F.Column:
    """A never-null string key, in which null and the empty string differ."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


# ---- files in the shared folder, as executors and the driver see them ----


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under its final name; a retried task replaces it with the same bytes."""
    if uri.startswith("file:") or "://" not in uri:
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def get_bytes(uri: str) -> bytes:
    if uri.startswith("file:") or "://" not in uri:
        with open(local_path(uri), "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def mapped(uri: str):
    """A read-only memory map of a file; one in a remote store is fetched to the task's own temporary folder first."""
    import numpy as np

    if uri.startswith("file:") or "://" not in uri:
        return np.memmap(local_path(uri), dtype=np.uint8, mode="r")
    f = tempfile.TemporaryFile()
    f.write(get_bytes(uri))
    f.flush()
    return np.memmap(f, dtype=np.uint8, mode="r")


def local_path(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
