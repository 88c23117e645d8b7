"""A manifest store: batches of manifest rows, written any number of times, read once.

Rows lie in ``data/batch=.../part=...``, where part is a hash of the page. A batch is written with dynamic partition
overwrite, so writing it again replaces its own parts and nothing else; then its marker, one row per part with the number
of rows, replaces the one before. Readers see what markers list: a batch without a marker was not finished, and a part
that a later writing of the batch no longer has is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Parts of a batch; fixed for all time, as readers look pages up by them.
PARTS = 64


def part_of(page: str) -> str:
    return f"CAST(pmod(xxhash64(CAST({page} AS BIGINT)), {PARTS}) AS INT)"


def write_batch(rows: DataFrame, folder: str, batch: str, page: str = "page_id") -> None:
    """Write, or replace, one batch. A failure at any point leaves the batch as it was before or without its new marker."""
    spark = rows.sparkSession
    placed = rows.withColumn("batch", F.lit(batch)).withColumn("part", F.expr(part_of(page)))
    # A part is one file, however many tasks made its rows; adaptive execution splits a part that is very large.
    placed.repartition("part").sortWithinPartitions("part", page).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(f"{folder}/data")
    written = spark.read.schema(placed.schema).parquet(f"{folder}/data").filter(F.col("batch") == batch)
    # Parts of an earlier writing lie beside the new ones; the rows just written tell which are current.
    current = placed.select("part").distinct()
    marker = written.groupBy("batch", "part").agg(F.count("*").alias("n")).join(current, "part", "left_semi").select("part", "n", "batch")
    marker.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/markers")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, part, n`` of all finished batches."""
    return spark.read.schema("part int, n bigint, batch string").parquet(f"{folder}/markers")


def read_manifest(spark: SparkSession, folder: str, schema: str, only: list[str] | None = None, page: int | None = None) -> DataFrame:
    """Rows of finished batches, or of some of them, or of one page: the scan opens only their partitions.

    Markers are matched by a semi join on the partition columns, which leaves unfinished and outdated parts out.
    """
    marked = batches(spark, folder)
    rows = spark.read.schema(f"{schema}, batch string, part int").parquet(f"{folder}/data")
    if only is not None:
        marked, rows = (x.filter(F.col("batch").isin(only)) for x in (marked, rows))
    if page is not None:
        here = spark.sql(f"SELECT {part_of(str(int(page)))} AS part").first().part
        marked, rows = (x.filter(F.col("part") == here) for x in (marked, rows))
        rows = rows.filter(F.col("page_id") == page)
    return rows.join(marked.select("batch", "part"), ["batch", "part"], "left_semi").drop("part")
