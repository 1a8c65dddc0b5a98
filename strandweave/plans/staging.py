"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, one of our own, on a single machine only: other machines could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandweave-"))
        held = spark.sparkContext.getCheckpointDir()
    return named or held


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Shuffles go with the query that made them, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    held = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if held is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, held)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: smaller than a checkpoint, and columns can be pruned."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Results of the rounds of a loop, each written to the shared folder; the one before the last is deleted.

    A written table is sized by its files, where a checkpoint keeps the estimate of its plan, which
    grows beyond all bounds over rounds of joins.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, self.name)
        _write(df, path)
        self.paths.append(path)
        self.drop(2)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes all but the last ``keep`` results."""
        while len(self.paths) > keep:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
