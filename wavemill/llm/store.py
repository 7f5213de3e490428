"""Durable intermediate tables.

Lineage is cut by writing a table into the shared folder that the session names in
``spark.checkpoint.dir``.  Every reader goes through Spark, so the folder may be on any
file system.  Only where the setting is absent and Spark runs in this one process (tests) a folder of our
own is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash; an error where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wavemill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Store:
    """Tables of one run of an operator, below one folder with a fresh name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table that was written."""
        path = self.path(name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that ``keep`` returned, or folders of this store, that no later plan reads."""
        for t in tables:
            for path in [t] if isinstance(t, str) else [p for kept, p in self.tables if kept is t]:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            self.tables = [(kept, p) for kept, p in self.tables if kept is not t]
