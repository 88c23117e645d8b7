"""Tables that several jobs share, written to the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[tuple[str, str, str], str] = {}
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where all tasks run in this process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _TEMPORARY:
        _TEMPORARY[app] = tempfile.mkdtemp(prefix="spark-")
    return _TEMPORARY[app]


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage, survives lost executors, gives the planner true sizes."""
    path = f"{shared_folder(df.sparkSession)}/pagelens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pieces:
    """Tables that one computation writes and reads back, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/pagelens/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables; whatever was made from them must have been written."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def bucketed(build: Callable[[int], DataFrame], spark: SparkSession, name: str, key: str, source: str, buckets: Callable[[], int]) -> DataFrame:
    """A derived table written once per application and source, bucketed by ``key``.

    Joins, windows and aggregations on the key then need no shuffle, and have a task for each bucket, so the number of
    buckets must grow with the table. ``build`` makes the table from that number; partitioned by the key in as many parts,
    it becomes one file a bucket.
    """
    ident = (spark.sparkContext.applicationId, name, source)
    if ident not in _TABLES:
        table, n = f"{name}_{uuid.uuid4().hex}", buckets()
        path = f"{shared_folder(spark)}/pagelens/{table}"
        build(n).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
        _TABLES[ident] = table
    return spark.table(_TABLES[ident])
