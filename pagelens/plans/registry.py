"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import candidates as C, manifest as M
from ..sources import derived as D
from ..sources.shared import bucketed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.crawl_pages(spark, sf_dir)


#: Pages of one task of the extraction and of one bucket of its table, some 30,000 images.
PAGES_PER_BUCKET = 1000


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """As many as there are cores, or as the crawl asks for; the count reads no page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), -(-pages // PAGES_PER_BUCKET))


def man(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest table: extracted once per application, bucketed by page, then queried many times.

    Pages are dealt anew before they are tokenized, and their elements by page after it, so that neither a task's work nor
    its windows grow with the crawl.
    """
    def build(n: int) -> DataFrame:
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(n, "page_id")
        return M.manifest(C.raw_candidates(D.with_images(pages), parts=n))

    return bucketed(build, spark, "manifest", "page_id", sf_dir, lambda: buckets(spark, sf_dir))


def selection(m: DataFrame) -> DataFrame:
    return m.filter(D.SELECTED).select("page_id", "id")


def ids(m: DataFrame, columns: list[str], where: str = "true") -> DataFrame:
    return m.select("id").distinct().filter(where).selectExpr(*columns)
