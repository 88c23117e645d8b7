"""Session for local runs; on a cluster use the session you have and set these properties there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "pagelens", cores: str | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        # A hot key's rows are split even where that costs another shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Parsing is CPU-bound: small partitions are worth a task of their own.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
