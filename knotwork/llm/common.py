"""What the operators of this subpackage share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
OWN_DIR = "file:///tmp/checkpoints/knotwork"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where it is unset, one of this machine's
    on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(OWN_DIR)
        named = OWN_DIR
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/knotwork-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Set while a table is written: Spark then drops the write's shuffle files, on all machines, as soon as it is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one run in the shared folder, which leave no shuffle files behind and are deleted as soon
    as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """As ``written``; a tag may come again once its table is deleted."""
        assert tag not in self.paths, tag
        before = self.spark.conf.get(TIDY)
        self.spark.conf.set(TIDY, "true")
        try:
            path = new_path(self.spark, tag)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        self.paths[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, *tags: str) -> None:
        for tag in tags:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, for workers that write or read single files there."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Readies Python workers: bounds their Arrow batches by rows and bytes, as texts may be very long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # workers import this package by name; where it is on the driver's path only, they look there too
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in own:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*own, root] if p)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, null text as empty: other columns, whatever their names, are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(df: DataFrame, part_bytes: int, text: str = "text") -> int:
    """Partitions for the texts of ``df``: as many as the session shuffles to, or more if these would be larger than
    ``part_bytes``."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
