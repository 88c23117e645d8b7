"""Raw candidates to the image manifest: resolve, first-wins dedupe, unit cap, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from ..functions.image_id import image_id
from ..functions.urls import with_resolved

MANIFEST = [
    "page_id", "id", "url", "filename", "ext", "source", "width", "height", "dimension_source",
    "variant_group", "doc_order",
]


def resolved_candidates(cands: DataFrame, max_data_uri: int | None = None) -> DataFrame:
    """``image_url`` = normalized absolute URL or accepted data URI; NULL when rejected."""
    return with_resolved(cands, "raw", "base", "image_url", max_data_uri=max_data_uri)


def admitted_candidates(cands: DataFrame, max_units: int | None = None, max_data_uri: int | None = None) -> DataFrame:
    """First occurrence of every URL per page, with its logical unit's rank and admission.

    De-duplication comes before the cap: a URL first seen in a rejected unit stays out even when an
    admitted unit repeats it later. All windows share the ``page_id`` partitioning of the input.
    """
    rows = resolved_candidates(cands, max_data_uri)
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY page_id, image_url ORDER BY seq) AS copy_no")
    rows = rows.filter("image_url IS NULL OR copy_no = 1")
    unit = "CASE WHEN image_url IS NOT NULL THEN coalesce(concat('g:', variant_group), concat('u:', image_url)) END"
    rows = rows.selectExpr("*", f"{unit} AS unit")
    rows = rows.selectExpr("*", "min(seq) OVER (PARTITION BY page_id, unit) AS unit_seq")
    unit_no = "dense_rank() OVER (PARTITION BY page_id, image_url IS NOT NULL ORDER BY unit_seq)"
    rows = rows.selectExpr("*", f"{unit_no} AS unit_no")
    return rows.selectExpr("*", f"image_url IS NOT NULL{'' if max_units is None else f' AND unit_no <= {max_units}'} AS admitted")


def manifest(cands: DataFrame, max_units: int | None = None, max_data_uri: int | None = None) -> DataFrame:
    """The manifest rows of every page, in ``doc_order``."""
    return manifest_rows(admitted_candidates(cands.filter(F.col("raw").isNotNull()), max_units, max_data_uri))


def manifest_rows(rows: DataFrame) -> DataFrame:
    rows = rows.filter("admitted").selectExpr(
        "page_id", "seq", "image_url", "source", "width", "height", "variant_group",
        f"{V.ext_of_url('image_url')} AS ext",
        "startswith(image_url, 'data:') AS inline",
    )
    page = "OVER (PARTITION BY page_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.selectExpr(
        "*", f"sum(CAST(inline AS INT)) {page} AS inline_no", f"CAST(row_number() {page} AS BIGINT) AS doc_order"
    )
    inline_name = f"concat('inline-', CAST(inline_no AS STRING), {V.ext_suffix('ext')})"
    rows = rows.selectExpr(
        "*", f"CASE WHEN inline THEN {inline_name} ELSE {V.base_filename('image_url', 'ext')} END AS name"
    )
    rows = rows.selectExpr("*", "row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY seq) AS name_no")
    # The id is the last column computed, so that it is pruned where nothing asks for it.
    rows = rows.selectExpr(
        "page_id",
        "image_url AS url",
        f"{V.numbered_filename('name', 'name_no')} AS filename",
        "ext",
        "source",
        "width",
        "height",
        "CASE WHEN width IS NOT NULL OR height IS NOT NULL THEN 'declared' END AS dimension_source",
        "variant_group",
        "doc_order",
    )
    return rows.withColumn("id", image_id("url")).select(*MANIFEST)


def page_scan(rows: DataFrame) -> DataFrame:
    """One row per page: image count, cap flags and the truncation reason (size beats images)."""
    scan = rows.groupBy("page_id").agg(
        F.count_if("admitted").alias("n_images"),
        F.coalesce(F.bool_or("size_cap_hit"), F.lit(False)).alias("size_cap_hit"),
        F.coalesce(
            F.bool_or(F.col("hit_raw_cap") | (F.col("image_url").isNotNull() & ~F.col("admitted"))), F.lit(False)
        ).alias("image_cap_hit"),
    )
    return scan.withColumn(
        "truncated",
        F.when(F.col("size_cap_hit"), F.lit("size-cap")).when(F.col("image_cap_hit"), F.lit("image-cap")),
    )
