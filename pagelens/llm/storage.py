"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by spark.checkpoint.dir; choose one only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint, so a lost executor never recomputes what lies above."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the checkpoint folder: smaller than a checkpoint for many short rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the checkpoint folder, each deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str, batch: int = 1000):
        self.batch = batch
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        # Whole sets and texts are wide rows, so Python gets few of them at once.
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(rows)
        self.spark.conf.set(rows, str(min(int(before), self.batch) if int(before) > 0 else self.batch))
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(rows, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables; whatever was made from them must have been written."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
