"""A Python data source for captured pages: spark.read.format("captured").load(folder) gives path and html.

The plug-in point of the sources: a subclass reads other captures. Each file is a partition of its own. On a cluster the
folder must be one that all executors see; spark.read.format("binaryFile") does the same for any store Spark reads.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "path string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", "."), self.options.get("suffix", ".html"))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def partitions(self):
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).rglob(f"*{self.suffix}"))] or [InputPartition(None)]

    def read(self, partition):
        if partition.value:
            yield partition.value, Path(partition.value).read_text(encoding="utf-8", errors="replace")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturedPages)
