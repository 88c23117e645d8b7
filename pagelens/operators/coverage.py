"""Coverage of a manifest against a ground-truth image list, and comparison of two scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sqltext import extract


def without_beacons(truth: DataFrame) -> DataFrame:
    """Drop tracking beacons: images under three pixels on a side."""
    return truth.filter("coalesce(w, 3) >= 3 AND coalesce(h, 3) >= 3")


def classify_truth(truth: DataFrame, m: DataFrame) -> DataFrame:
    """``match`` per truth image: exact URL, variant (same origin and path) or miss."""
    place = lambda c: extract(c, r"^([^?#]*)")
    seen = m.selectExpr("page_id", "url", f"{place('url')} AS place")
    exact = seen.select("page_id", "url").distinct().withColumn("x", F.lit(True))
    variant = seen.select("page_id", "place").distinct().withColumn("v", F.lit(True))
    rows = truth.selectExpr("*", f"{place('url')} AS place")
    rows = rows.join(exact, ["page_id", "url"], "left").join(variant, ["page_id", "place"], "left")
    return rows.selectExpr(
        *[f"`{c}`" for c in truth.columns],
        "CASE WHEN x THEN 'exact' WHEN v THEN 'variant' ELSE 'miss' END AS match",
    )


def coverage_pct(classified: DataFrame, *keys: str) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.count("*").alias("n_truth"),
        F.expr("100D * count_if(match = 'exact') / count(*)").alias("exact_pct"),
        F.expr("100D * count_if(match <> 'miss') / count(*)").alias("logical_pct"),
    )


def compare_vantage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scans' image counts ``(page_id, n)`` side by side with a verdict."""
    left, right = a.withColumnRenamed("n", "n_a"), b.withColumnRenamed("n", "n_b")
    rows = left.join(right, "page_id", "full_outer").selectExpr(
        "page_id", "coalesce(n_a, 0L) AS n_a", "coalesce(n_b, 0L) AS n_b"
    )
    return rows.selectExpr(
        "*", "n_a - n_b AS diff",
        "CASE WHEN n_a = n_b THEN 'match' WHEN n_a = 0 OR n_b = 0 THEN 'one-side-empty' ELSE 'churn' END AS verdict",
    )
