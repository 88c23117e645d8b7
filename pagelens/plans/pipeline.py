"""Whole plans: pages to manifest, with policy applied before any page text is tokenized."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from ..functions.sqltext import q
from ..functions.urls import split_absolute, with_resolved
from ..operators import candidates as C, manifest as M, policy as P, tokens as T, view as VW
from ..operators.skew import join_dimension
from ..sources.shared import persist


def admitted_pages(
    pages: DataFrame, robots: DataFrame | None = None, blocklist: DataFrame | None = None, agent: str = "pagelens"
) -> DataFrame:
    """Pages that may be scanned. The checks read ``url`` only and run before the markup is touched."""
    rows = P.admit(pages).filter("ok").drop("ok", "reason", "detail", "host")
    if blocklist is not None:
        rows = P.without_blocked(rows, P.blocklist_entries(blocklist))
    if robots is not None:
        rows = P.robots_verdicts(rows, P.robots_rules(robots, agent)).filter("robots_allowed")
        rows = rows.drop("robots_allowed", "origin")
    return rows


def sheet_images(sheets: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``sheet_url, urls``: images of each style sheet, resolved against the sheet's own URL.

    Done once per sheet, so the join with pages moves short URL lists and no CSS text.
    """
    text = "css" if max_bytes is None else (
        f"CASE WHEN octet_length(css) > {max_bytes} THEN "
        f"make_valid_utf8(CAST(substring(CAST(css AS BINARY), 1, {max_bytes}) AS STRING)) ELSE css END"
    )
    rows = sheets.filter("status BETWEEN 200 AND 299").selectExpr(
        "sheet_url", f"{split_absolute('final_url')} AS base", f"posexplode({V.css_urls(text)}) AS (i, raw)"
    )
    rows = with_resolved(rows, "raw", "base", "image", sort=False).filter("image IS NOT NULL")
    return rows.groupBy("sheet_url").agg(
        F.expr("transform(array_sort(collect_list(struct(i, image))), x -> x.image) AS urls")
    )


def stylesheet_candidates(els: DataFrame, sheets: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates from the linked sheets of each page; a missing or failed sheet yields none."""
    links = C.stylesheet_links(els, limit)
    links = P.admit(links, "sheet_url").filter("ok").select("page_id", "sheet_no", "sheet_url")
    # Many pages share a sheet; the sheet side is one short row per sheet.
    joined = join_dimension(links, sheet_images(sheets), ["sheet_url"], how="inner")
    return joined.selectExpr("page_id", "sheet_no", "posexplode(urls) AS (i, raw)")


def candidates_with_sheets(
    pages: DataFrame, sheets: DataFrame | None, raw_cap: int | None = None, keep_all_pages: bool = False,
    max_sheets: int | None = None, **budgets,
) -> DataFrame:
    """Raw candidates of the document followed by those of its style sheets."""
    if sheets is None:
        return C.raw_candidates(pages, raw_cap, keep_all_pages, **budgets)
    # Links are found in the same pass as the candidates and turned into their sheets' images where they stand.
    rows = C.raw_candidates(pages, raw_cap, keep_all_pages, links=True, **budgets)
    is_link = f"coalesce(source = {q(C.LINK)}, false)"
    if max_sheets is not None:
        rows = rows.filter(f"NOT {is_link} OR seq <= {max_sheets}")
    rows = with_resolved(rows.selectExpr("*", f"CASE WHEN {is_link} THEN raw ELSE '' END AS _href"), "_href", "base", "sheet_url", sort=False).drop("_href")
    rows = P.admit(rows, "sheet_url")
    # Other rows get keys of their own, so that they are spread as by page.
    rows = rows.selectExpr("*", f"CASE WHEN {is_link} AND ok THEN sheet_url ELSE concat('page ', page_id) END AS _key")
    rows = join_dimension(rows, sheet_images(sheets).withColumnRenamed("sheet_url", "_key"), ["_key"])
    image = "named_struct('i', CAST(NULL AS INT), 'image', CAST(NULL AS STRING))"
    rows = rows.filter(f"NOT {is_link} OR urls IS NOT NULL" if not keep_all_pages else "true").selectExpr(
        "*", f"inline(CASE WHEN {is_link} AND urls IS NOT NULL THEN transform(urls, (u_, i_) -> named_struct('i', i_, 'image', u_)) ELSE array({image}) END)"
    )
    # A link without images only marks its page. Sheet URLs are absolute already; they follow all document candidates, in sheet order.
    return rows.selectExpr(
        "page_id", "size_cap_hit", "base", f"CASE WHEN {is_link} THEN 1000000000000L + seq * 100000000L + coalesce(i, 0) ELSE seq END AS seq",
        f"CASE WHEN {is_link} THEN image ELSE raw END AS raw", f"CASE WHEN {is_link} THEN {q('stylesheet')} ELSE source END AS source",
        "width", "height", "variant_group", "hit_raw_cap",
    )


def extract_manifest(
    pages: DataFrame, sheets: DataFrame | None = None, robots: DataFrame | None = None,
    blocklist: DataFrame | None = None, agent: str = "pagelens", raw_cap: int | None = None,
    max_units: int | None = None, max_sheets: int | None = None, max_data_uri: int | None = None, **budgets,
) -> DataFrame:
    """The image manifest of a crawl: ``pages(page_id, url, html)`` in, one row per image out.

    Nothing is cut unless a limit is given: ``raw_cap``, ``max_units``, ``max_sheets``, ``max_data_uri``, ``style_budget``,
    ``noscript_budget``. ``scan_pages`` with the same limits flags the pages they cut.
    """
    if robots is not None or blocklist is not None:
        pages = admitted_pages(pages, robots, blocklist, agent)
    cands = candidates_with_sheets(pages, sheets, raw_cap, max_sheets=max_sheets, max_data_uri=max_data_uri, **budgets)
    return M.manifest(cands, max_units, max_data_uri)


def scan_pages(
    pages: DataFrame, raw_cap: int | None = None, max_units: int | None = None, sheets: DataFrame | None = None,
    max_bytes: int | None = None, max_sheets: int | None = None, max_data_uri: int | None = None, **budgets,
) -> DataFrame:
    """One row per page, empty ones included: images (style sheets' too, if given) and whether they were cut.

    Takes the limits of ``extract_manifest`` and ``max_bytes`` of a page. A cut page (``size-cap``) and cut images
    (``image-cap``) are flagged; the other limits leave candidates out without a flag.
    """
    rows = candidates_with_sheets(T.cap_pages(pages, max_bytes), sheets, raw_cap, keep_all_pages=True, max_sheets=max_sheets, max_data_uri=max_data_uri, **budgets)
    return M.page_scan(M.admitted_candidates(rows, max_units, max_data_uri))


def scan_status(
    pages: DataFrame, robots: DataFrame | None = None, blocklist: DataFrame | None = None, agent: str = "pagelens", **options
) -> DataFrame:
    """``page_id, n_images, truncated, status`` of every page, policy first.

    Verdicts come from ``url`` alone; only admitted pages that robots allow are joined with their text and tokenized.
    The others have no images and the status ``error`` or ``robots-blocked``. ``options`` go to ``scan_pages``.
    """
    verdicts = P.admit(pages.select("page_id", "url")).selectExpr("page_id", "url", "reason AS error_code")
    if blocklist is not None:
        passed = P.without_blocked(verdicts, P.blocklist_entries(blocklist)).select("page_id", F.lit(True).alias("passed"))
        verdicts = verdicts.join(passed, "page_id", "left").selectExpr("page_id", "url", "coalesce(error_code, CASE WHEN passed IS NULL THEN 'domain-blocked' END) AS error_code")
    verdicts = verdicts.withColumn("robots_allowed", F.lit(True)) if robots is None else P.robots_verdicts(verdicts, P.robots_rules(robots, agent))
    verdicts = persist(verdicts.select("page_id", "error_code", "robots_allowed"), "verdicts")
    allowed = verdicts.filter("error_code IS NULL AND robots_allowed").select("page_id")
    scan = scan_pages(pages.join(allowed, "page_id", "left_semi"), **options).select("page_id", "n_images", "truncated")
    rows = verdicts.join(scan, "page_id", "left").withColumn("n_images", F.expr("coalesce(n_images, 0L)"))
    return VW.page_status(rows).select("page_id", "n_images", "truncated", "status")
