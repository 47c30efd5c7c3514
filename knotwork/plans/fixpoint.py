"""Loops on the driver: written generations in the shared folder instead of growing plans."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
OWN_DIR = "file:///tmp/checkpoints/knotwork-graphs"


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


def workers(spark: SparkSession) -> None:
    """Readies Python workers: bounds their Arrow batches by bytes, and lets them import this package from where it is."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in own:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in [*own, root] if p)


#: Set while a generation is written: Spark then drops the write's shuffle files, on all machines, as soon as it is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Generations:
    """Writes one table after another; a table that is two steps old is deleted, as nothing reads it any more."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []
        self.base = f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as a Parquet table, read again. Lost executors can't lose it."""
        path = f"{self.base}/{len(self.paths)}"
        before = self.spark.conf.get(TIDY)
        self.spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(TIDY, before)
        self.paths.append(path)
        if len(self.paths) > self.keep:
            self._delete(self.paths[-1 - self.keep])
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        old = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def only_last(self) -> None:
        """Deletes all tables but the last, and from now on each as soon as the next is written."""
        for path in self.paths[-1 - self.keep : -1]:
            self._delete(path)
        self.keep = 1


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: an intermediate result that several plans use."""
    return Generations(df.sparkSession).write(df)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, DataFrame], bool], max_iter: int | None = None) -> DataFrame:
    """Applies ``step`` until ``done(before, after)`` or ``max_iter`` rounds; each round's state is written."""
    kept = Generations(state.sparkSession)
    state, n = kept.write(state), 0
    while max_iter is None or n < max_iter:
        after = kept.write(step(state))
        n += 1
        if done(state, after):
            return after
        state = after
    return state
