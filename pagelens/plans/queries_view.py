"""Registered queries over the manifest: filters, facets, tiles, sorts, selections, sizes, bundles, coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import SAVED_FILTERS, SKIP_FOOTNOTES
from ..functions import values as V
from ..functions.urls import url_host
from ..operators import bundle as B, coverage as K, enrich as E, policy as P, view as VW
from ..sources import derived as D
from ..sources.image_files import image_prefixes, write_image_archives
from ..sources.shared import shared_folder
from . import oracle_base as O, pipeline as PL
from .queries_extract import MAN, SHEET_CANDS_SQL, sheets
from .queries_policy import AGENT, VERDICT_SQL, robots
from .registry import add, crawl, ids, man, selection

KEY = ["page_id", "id", "doc_order"]
FMT, GRP, QUERY = ["webp", "png"], ["page"], "hero"
G = O.GROUPS


def audited_pages(s, d):
    """The crawl, with some pages at an address that admission rejects."""
    return crawl(s, d).withColumn("url", F.expr("CASE WHEN page_id % 23 = 9 THEN 'http://10.0.0.' || page_id % 200 || '/' ELSE url END"))


def listing(name, fn, where):
    add(name, lambda s, d: fn(man(s, d)).select("page_id", "doc_order", "url"), MAN + f"SELECT page_id, doc_order, url FROM man WHERE {where}")


# -- filters -----------------------------------------------------------------------------------
HERO = "(lower(filename) LIKE '%hero%' OR lower(url) LIKE '%hero%')"
listing("filter_query", lambda m: VW.filter_images(m, QUERY), HERO)
listing("filter_formats", lambda m: VW.filter_images(m, formats=FMT), "ext IN ('webp', 'png')")
listing("filter_groups", lambda m: VW.filter_images(m, groups=GRP), f"{G} = 'page'")
listing("filter_combined", lambda m: VW.filter_images(m, "p", FMT, GRP), f"(lower(filename) LIKE '%p%' OR lower(url) LIKE '%p%') AND ext IN ('webp', 'png') AND {G} = 'page'")
listing("filter_params", lambda m: VW.filter_images(m, formats=VW.parse_format_param("JPG, webp,bogus"), groups=VW.parse_source_param("nope")), "ext IN ('jpeg', 'webp')")
listing("filter_remote", VW.remote_only, "regexp_matches(url, '^https?://')")
listing("filter_icons", VW.icons_only, "source IN ('favicon', 'inline-svg')")
PRESETS = ", ".join(f"('{k}', {f or '[]::VARCHAR[]'}, {g or '[]::VARCHAR[]'})" for k, (f, g) in SAVED_FILTERS.items())


add("saved_filters",
    lambda s, d: VW.saved_filter_matches(man(s, d), SAVED_FILTERS).groupBy("preset").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages")),
    MAN + f""", presets(preset, formats, groups) AS (VALUES {PRESETS})
    SELECT preset, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT *, {G} AS grp FROM man) m JOIN presets p
      ON (len(formats) = 0 OR list_contains(formats, ext)) AND (len(groups) = 0 OR list_contains(groups, grp)) GROUP BY preset""")

# -- derived side tables -----------------------------------------------------------------------
SIDE = f"""ids AS (SELECT DISTINCT id FROM man),
measured AS (SELECT {', '.join(D.MEASURED)} FROM ids WHERE {D.MEASURED_WHERE}),
sizes AS (SELECT {', '.join(D.SIZES)} FROM ids WHERE {D.SIZES_WHERE}),
pending AS (SELECT id FROM ids WHERE {D.PENDING_WHERE}),
sel AS (SELECT page_id, id FROM man WHERE {D.SELECTED}),
filt AS (SELECT page_id, id FROM man WHERE ext IN ('webp', 'png'))"""
S = MAN + ", " + SIDE + " "
measured = lambda m: ids(m, D.MEASURED, D.MEASURED_WHERE)
sizes = lambda m: ids(m, D.SIZES, D.SIZES_WHERE)
filtered = lambda m: VW.filter_images(m, formats=FMT)
pending = lambda m: ids(m, ["id"], D.PENDING_WHERE)


def over(name, fn, sql):
    add(name, lambda s, d: fn(man(s, d)), S + sql)


# -- joins -------------------------------------------------------------------------------------
over("join_source_group", lambda m: VW.with_source_group(m).groupBy("source", "source_group").agg(F.count("*").alias("n")),
     f"SELECT source, {G} AS source_group, count(*) AS n FROM man GROUP BY ALL")
KNOWN = """known AS (SELECT m.* EXCLUDE (width, height, dimension_source), CASE WHEN d.id IS NULL THEN width ELSE d.w END AS width,
  CASE WHEN d.id IS NULL THEN height ELSE d.h END AS height,
  CASE WHEN d.id IS NULL THEN dimension_source ELSE 'measured' END AS dimension_source FROM man m LEFT JOIN measured d USING (id))"""
add("join_measured", lambda s, d: VW.with_known_dims(man(s, d), measured(man(s, d))).select(*KEY, "width", "height", "dimension_source"),
    MAN + f", {SIDE}, {KNOWN} SELECT page_id, id, doc_order, width, height, dimension_source FROM known")
INLINE = """CASE WHEN url LIKE 'data:%;base64,%' THEN octet_length(from_base64(split_part(url, ',', 2)))
  WHEN url LIKE 'data:%' THEN strlen(url_decode(substring(url, strpos(url, ',') + 1))) END"""
SIZED = f"sized AS (SELECT m.*, size_state, CAST(coalesce(bytes, {INLINE}) AS BIGINT) AS bytes FROM man m LEFT JOIN sizes USING (id))"
add("join_sizes", lambda s, d: E.with_sizes(man(s, d), sizes(man(s, d))).select(*KEY, "size_state", "bytes", "weight"),
    MAN + f", {SIDE}, {SIZED} SELECT page_id, id, doc_order, size_state, bytes, coalesce(bytes, 16000000) AS weight FROM sized")
over("join_selected", lambda m: VW.selected_images(m, selection(m)).select(*KEY),
     "SELECT page_id, id, doc_order FROM man SEMI JOIN sel USING (page_id, id)")
over("sink_url_list", lambda m: VW.url_lists(m, selection(m)),
     "SELECT page_id, string_agg(url, chr(10) ORDER BY doc_order) AS urls FROM man SEMI JOIN sel USING (page_id, id) GROUP BY page_id")

# -- facets ------------------------------------------------------------------------------------
over("facet_format", lambda m: VW.facet_format(m, groups=GRP), f"SELECT page_id, ext, count(*) AS n FROM man WHERE {G} = 'page' GROUP BY ALL")
over("facet_format_collapsed", lambda m: VW.facet_format(m, groups=GRP, collapse=True),
     f"SELECT page_id, ext, count(DISTINCT coalesce(variant_group, id)) AS n FROM man WHERE {G} = 'page' GROUP BY ALL")
over("facet_format_all", lambda m: VW.facet_format_all(m, QUERY, collapse=True),
     f"SELECT page_id, count(DISTINCT coalesce(variant_group, id)) AS n FROM man WHERE {HERO} GROUP BY ALL")
over("facet_group", lambda m: VW.facet_group(m, formats=FMT), f"SELECT page_id, {G} AS source_group, count(*) AS n FROM man WHERE ext IN ('webp', 'png') GROUP BY ALL")
add("facet_zero_fill",
    lambda s, d: VW.facet_zero_fill(VW.facet_format(man(s, d)), D.read_pages(s, d).select("page_id")).withColumn("rank", F.col("rank").cast("bigint")),
    MAN + """, f(rank, ext) AS (VALUES (0, 'png'), (1, 'jpeg'), (2, 'svg'), (3, 'gif'), (4, 'webp'), (5, 'avif'), (6, 'ico'), (7, 'unknown'))
    SELECT p.page_id, rank, f.ext, CASE f.ext WHEN 'jpeg' THEN 'JPG' ELSE upper(f.ext) END AS label, count(m.url) AS n
    FROM pages p CROSS JOIN f LEFT JOIN man m ON m.page_id = p.page_id AND m.ext = f.ext GROUP BY ALL""")
over("facet_corpus", VW.facet_corpus,
     f"SELECT grp AS source_group, ext, count(*) AS n, grouping(grp, ext) AS level FROM (SELECT {G} AS grp, ext FROM man) GROUP BY ROLLUP (grp, ext)")
over("total_units", lambda m: m.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct(F.expr(VW.UNIT)).alias("n_units")),
     "SELECT page_id, count(*) AS n, count(DISTINCT coalesce(variant_group, id)) AS n_units FROM man GROUP BY page_id")

# -- tiles -------------------------------------------------------------------------------------
TILES = """tiles AS (SELECT *, coalesce(variant_group, id) AS unit, row_number() OVER (PARTITION BY page_id, coalesce(variant_group, id)
    ORDER BY width * height DESC NULLS LAST, width DESC NULLS LAST, source = 'img' DESC, doc_order) AS pick,
  count(*) OVER u AS n_members, min(doc_order) OVER u AS tile_order FROM man WINDOW u AS (PARTITION BY page_id, coalesce(variant_group, id)))"""
flat_tile = ["page_id", "unit", "rep.id AS rep_id", "rep.w AS w", "rep.h AS h", "n_members", "tile_order"]
add("collapse_variants", lambda s, d: VW.collapse_variants(man(s, d)).selectExpr(*flat_tile),
    MAN + f", {TILES} SELECT page_id, unit, id AS rep_id, width AS w, height AS h, n_members, tile_order FROM tiles WHERE pick = 1")
over("single_tiles", lambda m: VW.single_tiles(m).selectExpr(*flat_tile),
     "SELECT page_id, id AS unit, id AS rep_id, width AS w, height AS h, 1 AS n_members, doc_order AS tile_order FROM man")
STATES = f"""{TILES}, states AS (SELECT page_id, unit, max(CASE WHEN pick = 1 THEN id END) AS rep_id, max(n_members) AS n_members,
    count(*) FILTER (doc_order % 3 = 0) AS selected_count, bool_or(pick = 1 AND doc_order % 3 = 0) AS checked FROM tiles GROUP BY page_id, unit)"""
add("tile_selection",
    lambda s, d: VW.tile_selection(VW.collapse_variants(man(s, d)), selection(man(s, d))).select(
        "page_id", "unit", "rep_id", "n_members", "checked", "selected_count", "partial"),
    MAN + f", {STATES} SELECT *, NOT checked AND selected_count > 0 AS partial FROM states")
add("selection_note", lambda s, d: VW.selection_note(VW.tile_selection(VW.collapse_variants(man(s, d)), selection(man(s, d)))),
    MAN + f", {STATES} SELECT page_id, bool_or(n_members > 1 AND checked) AS note FROM states GROUP BY page_id")


def tiles_sorted(s, d):
    reps = VW.collapse_variants(man(s, d)).selectExpr("page_id", "rep.id AS id", "rep.w AS width", "rep.h AS height", "tile_order AS doc_order")
    return VW.ranked(reps, "imagesize").select("page_id", "id", "rank")


add("sort_tiles", tiles_sorted,
    MAN + f""", {TILES} SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC NULLS LAST, tile_order) AS rank
    FROM tiles WHERE pick = 1""")

# Unicode collation puts the punctuation of these names before digits, in this order.
UNICODE = "translate(lower(filename), '_-.', '!\"#')"

# -- sorts -------------------------------------------------------------------------------------
for key, order, spark_key, direction in [
    ("sort_document", "doc_order", "document", "largest"),
    ("sort_name", f"{UNICODE}, doc_order", "name", "largest"),
    ("sort_type", f"ext, {UNICODE}, doc_order", "type", "largest"),
    ("sort_width", "width DESC NULLS LAST, doc_order", "width", "largest"),
    ("sort_height", "height ASC NULLS LAST, doc_order", "height", "smallest"),
    ("sort_area", "width * height DESC NULLS LAST, doc_order", "imagesize", "largest"),
]:
    fn = lambda m, k=spark_key, dr=direction: VW.ranked(m, k, dr).select("page_id", "doc_order", "rank")
    over(key, fn, f"SELECT page_id, doc_order, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rank FROM man")
AREA = "row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC NULLS LAST, doc_order)"
over("topk_images", lambda m: VW.top_images(m, 3).select("page_id", "doc_order", "rank"),
     f"SELECT page_id, doc_order, {AREA} AS rank FROM man QUALIFY rank <= 3")
over("w_reveal", lambda m: VW.reveal_batches(m, "imagesize", batch=5).select("page_id", "doc_order", "rank", "batch"),
     f"SELECT page_id, doc_order, rank, (rank - 1) // 5 AS batch FROM (SELECT *, {AREA} AS rank FROM man)")


def ranges(m):
    ends = m.filter("doc_order IN (3, 7)").groupBy("page_id").agg(
        F.expr("max(CASE WHEN doc_order = 7 THEN id END)").alias("anchor_id"),
        F.expr("max(CASE WHEN doc_order = 3 THEN id END)").alias("target_id"))
    return VW.select_range(VW.ranked(m, "imagesize"), ends)


RANGE = f"""placed AS (SELECT *, {AREA} AS rank FROM man),
ends AS (SELECT page_id, max(rank) FILTER (doc_order = 7) AS a, max(rank) FILTER (doc_order = 3) AS b FROM placed GROUP BY page_id),
picked AS (SELECT p.page_id, p.id, p.rank, coalesce(abs(a - b) + 1, 1) AS span FROM placed p JOIN ends USING (page_id)
  WHERE CASE WHEN a IS NULL OR b IS NULL THEN doc_order = 3 ELSE rank BETWEEN least(a, b) AND greatest(a, b) END)"""
add("w_select_range", lambda s, d: ranges(man(s, d)).select("page_id", "id", "rank", "span"),
    MAN + f", {RANGE} SELECT page_id, id, rank, span FROM picked")
add("w_auto_probe", lambda s, d: VW.auto_probe(ranges(man(s, d)), 12).select("page_id", "id", "rank", "span"),
    MAN + f", {RANGE} SELECT page_id, id, rank, span FROM picked WHERE span <= 12")

# -- selections --------------------------------------------------------------------------------
over("set_select_all", lambda m: VW.select_all(selection(m), filtered(m)), "SELECT * FROM sel UNION SELECT * FROM filt")
over("set_invert", lambda m: VW.invert_within(selection(m), filtered(m)),
     "(SELECT * FROM sel EXCEPT SELECT * FROM filt) UNION (SELECT * FROM filt EXCEPT SELECT * FROM sel)")
over("set_toggle", lambda m: VW.toggle(selection(m), m.filter("doc_order % 2 = 0").select("page_id", "id")),
     """, dl AS (SELECT page_id, id FROM man WHERE doc_order % 2 = 0)
     (SELECT * FROM sel EXCEPT SELECT * FROM dl) UNION (SELECT * FROM dl EXCEPT SELECT * FROM sel)""")
over("set_hidden_selected", lambda m: VW.hidden_selected(selection(m), filtered(m)), "SELECT * FROM sel EXCEPT SELECT * FROM filt")

# -- dimensions --------------------------------------------------------------------------------
over("dims_known", lambda m: VW.dims_known(m, "page_id"),
     """SELECT page_id, count(*) AS n, count(width) AS n_width, count(height) AS n_height,
     count(*) FILTER (width IS NOT NULL AND height IS NOT NULL) AS n_both FROM man GROUP BY page_id""")
over("dims_coverage_by_source",
     lambda m: VW.dims_known(m, "source").selectExpr("source", "n", "100D * n_width / n AS width_pct", "100D * n_both / n AS both_pct"),
     """SELECT source, count(*) AS n, 100.0::DOUBLE * count(width) / count(*) AS width_pct,
     100.0::DOUBLE * count(*) FILTER (width IS NOT NULL AND height IS NOT NULL) / count(*) AS both_pct FROM man GROUP BY source""")
over("filter_measure_todo", lambda m: VW.measure_todo(m, measured(m), "imagesize").select(*KEY),
     "SELECT page_id, id, doc_order FROM man ANTI JOIN measured USING (id) WHERE width IS NULL OR height IS NULL")
over("measure_plan", lambda m: VW.measure_plan(VW.measure_todo(m, measured(m), "width"), warn_at=10),
     "SELECT page_id, count(*) AS n_todo, count(*) >= 10 AS warn FROM man ANTI JOIN measured USING (id) WHERE width IS NULL GROUP BY page_id")


CAP = 24
SCAN_SQL = f"""{O.CANDIDATES}, {SHEET_CANDS_SQL.replace('WHERE sheet_no <= 3', 'WHERE true')}, all_cands AS (SELECT page_id, seq, raw, source, width, height, variant_group FROM cands
    UNION ALL SELECT page_id, 1000000 + sheet_no * 1000 + ix, raw, 'stylesheet', NULL, NULL, NULL FROM sheet_cands), {O.manifest_cte('all_cands', max_units=CAP, with_id=False)},
per AS (SELECT page_id, n_images, CASE WHEN units > {CAP} THEN 'image-cap' END AS truncated FROM (SELECT c.page_id, (SELECT count(*) FROM man m WHERE m.page_id = c.page_id) AS n_images,
    (SELECT max(uno) FROM ranked r WHERE r.page_id = c.page_id) AS units FROM crawl c))"""
# Scans count images of pages and their style sheets, and cut them at a number of units.
add("page_status",
    lambda s, d: PL.scan_status(audited_pages(s, d), robots(s, d), agent=AGENT, sheets=sheets(s, d), max_units=CAP),
    f"""WITH {SCAN_SQL}, {VERDICT_SQL}
    SELECT page_id, CASE WHEN robots_allowed AND page_id % 23 <> 9 THEN n_images ELSE 0 END AS n_images, CASE WHEN robots_allowed AND page_id % 23 <> 9 THEN truncated END AS truncated,
      CASE WHEN page_id % 23 = 9 THEN 'error' WHEN NOT robots_allowed THEN 'robots-blocked' WHEN n_images = 0 THEN 'empty' ELSE 'results' END AS status FROM per JOIN judged USING (page_id)""")
add("page_scan", lambda s, d: PL.scan_pages(crawl(s, d), sheets=sheets(s, d), max_units=CAP).select("page_id", "n_images", "truncated"),
    f"WITH {SCAN_SQL} SELECT page_id, n_images, truncated FROM per")


def corpus_units(s, d):
    """Distinct images and pages by format: sketches per site, united for the corpus, beside the exact counts."""
    m = man(s, d).join(D.read_pages(s, d).selectExpr("page_id", f"{url_host('url')} AS site"), "page_id")
    told = VW.united_sketches(VW.unit_sketches(m, ["site", "ext"]), ["ext"])
    exact = m.groupBy("ext").agg(F.count_distinct("id").alias("images"), F.count_distinct("page_id").alias("pages"))
    near = lambda c: f"abs(approx_{c} - {c}) <= {VW.SKETCH_ERROR} * {c} AS {c}_near"
    return told.join(exact, "ext").selectExpr("ext", "images", "pages", near("images"), near("pages"))


add("facet_corpus_sketches", corpus_units,
    MAN + "SELECT ext, count(DISTINCT id) AS images, count(DISTINCT page_id) AS pages, true AS images_near, true AS pages_near FROM man GROUP BY ext")
add("zero_result_sites",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", f"{url_host('url')} AS host").join(
        man(s, d).groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").groupBy("host").agg(
        F.count("*").alias("n_pages"), F.expr("count_if(n IS NULL)").alias("n_empty")).filter("n_empty > 0"),
    MAN + f""", per AS (SELECT page_id, count(*) AS n FROM man GROUP BY page_id)
    SELECT {D.HOST} AS host, count(*) AS n_pages, count(*) FILTER (n IS NULL) AS n_empty FROM pages LEFT JOIN per USING (page_id)
    GROUP BY host HAVING n_empty > 0""")

# -- enrichment --------------------------------------------------------------------------------
PREFIX_SQL = f"prefixes AS (SELECT {', '.join(D.PREFIXES)} FROM man)"
_FILES: dict[tuple[str, str], str] = {}


def image_folder(s, d):
    """One file per image of the manifest, its header followed by up to 10,000 bytes, in archives; written once per application."""
    key = (s.sparkContext.applicationId, d)
    if key not in _FILES:
        folder = f"{shared_folder(s)}/pagelens/images-{uuid.uuid4().hex}"
        rows = man(s, d).selectExpr(*D.PREFIXES).selectExpr(
            "concat(page_id, '-', doc_order) AS name", f"CAST(concat(content, CAST(repeat(' ', {D.FILE_TAIL}) AS BINARY)) AS BINARY) AS content")
        write_image_archives(rows, folder)
        _FILES[key] = folder
    return _FILES[key]


def scanned_files(s, d):
    rows = image_prefixes(s, image_folder(s, d), 4096, archives=True)
    name = "regexp_extract(path, '([0-9]+)-([0-9]+)$', {})"
    rows = rows.selectExpr(f"CAST({name.format(1)} AS BIGINT) AS page_id", f"CAST({name.format(2)} AS BIGINT) AS doc_order", "length", "content")
    return E.measure_prefixes(rows).selectExpr(
        "page_id", "doc_order", "length", "CAST(octet_length(content) AS BIGINT) AS n_bytes", "dims.state AS state", "dims.w AS w", "dims.h AS h")


DIMS_SQL = """CASE WHEN doc_order % 10 IN (7, 9) THEN 'failed' WHEN doc_order % 10 = 8 THEN 'no-intrinsic' ELSE 'known' END AS state,
      CASE doc_order % 10 WHEN 0 THEN b + 256 WHEN 1 THEN b + 256 WHEN 2 THEN b + 769 WHEN 3 THEN b + 512 WHEN 4 THEN CASE WHEN b * 32 > 256 THEN b ELSE 16 END
        WHEN 5 THEN b + 256 WHEN 6 THEN doc_order + 10 END AS w,
      CASE doc_order % 10 WHEN 0 THEN b + 512 WHEN 1 THEN b + 512 WHEN 2 THEN b + 1025 WHEN 3 THEN b + 256 WHEN 4 THEN CASE WHEN b * 32 > 256 THEN 32 ELSE 16 END
        WHEN 5 THEN b + 768 WHEN 6 THEN 21 END AS h"""
add("scan_image_prefixes", scanned_files,
    MAN + f""", {PREFIX_SQL}, sized AS (SELECT page_id, doc_order, octet_length(content) + {D.FILE_TAIL} AS length, doc_order % 256 AS b, doc_order % 10 = 9 AND {D.FILE_TAIL} >= 14 AS long FROM prefixes)
    SELECT page_id, doc_order, length, least(4096, length) AS n_bytes, CASE WHEN long THEN 'known' ELSE state END AS state, CASE WHEN long THEN 538976288 ELSE w END AS w,
      CASE WHEN long THEN 538976288 ELSE h END AS h FROM (SELECT page_id, doc_order, length, long, {DIMS_SQL} FROM sized)""")
add("enrich_dims",
    lambda s, d: E.measure_prefixes(man(s, d).selectExpr(*D.PREFIXES)).selectExpr(
        "page_id", "doc_order", "dims.state AS state", "dims.w AS w", "dims.h AS h"),
    MAN + f"""SELECT page_id, doc_order, {DIMS_SQL} FROM (SELECT *, doc_order % 256 AS b FROM man)""")
add("enrich_data_uri_dims",
    lambda s, d: E.measure_prefixes(E.data_uri_prefixes(man(s, d))).selectExpr(
        "page_id", "doc_order", "dims.state AS state", "dims.w AS w", "dims.h AS h"),
    MAN + """SELECT page_id, doc_order, CASE WHEN url LIKE 'data:image/gif%' THEN 'known' ELSE 'no-intrinsic' END AS state,
      CASE WHEN url LIKE 'data:image/gif%' THEN 3 END AS w, CASE WHEN url LIKE 'data:image/gif%' THEN 2 END AS h FROM man WHERE url LIKE 'data:%'""")
RESP = f"resp AS (SELECT {', '.join(D.RESPONSES)} FROM man)"
responses = lambda m: m.selectExpr(*D.RESPONSES)
add("enrich_probe", lambda s, d: E.probe(responses(man(s, d))).selectExpr("page_id", "doc_order", "size_state", "CAST(bytes AS BIGINT) AS bytes"),
    MAN + f""", {RESP} SELECT page_id, doc_order, CASE doc_order % 8 WHEN 2 THEN 'failed' WHEN 4 THEN 'failed' WHEN 6 THEN 'unknown-length' ELSE 'known' END AS size_state,
      CAST(CASE WHEN status = 206 THEN CAST(split_part(content_range, '/', 2) AS BIGINT) WHEN status = 200 THEN content_length END AS BIGINT) AS bytes FROM resp""")
add("classify_fetch", lambda s, d: E.classify(responses(man(s, d))).groupBy("outcome").agg(F.count("*").alias("n")),
    MAN + """SELECT CASE doc_order % 8 WHEN 2 THEN 'upstream-error' WHEN 4 THEN 'upstream-error' WHEN 3 THEN 'not-an-image'
      WHEN 5 THEN 'size-limit' WHEN 6 THEN 'size-limit' ELSE 'ok' END AS outcome, count(*) AS n FROM man GROUP BY outcome""")
SUMMARY = f"""{SIDE}, {SIZED}, st AS (SELECT s.page_id, bytes, CASE WHEN bytes IS NOT NULL THEN 'known' WHEN size_state IS NOT NULL THEN 'unknown'
    WHEN s.id IN (SELECT id FROM pending) THEN 'pending' ELSE 'unprobed' END AS st FROM sized s WHERE doc_order % 3 = 0)"""
add("size_summary",
    lambda s, d: E.size_summary(VW.selected_images(E.with_sizes(man(s, d), sizes(man(s, d))), selection(man(s, d))), pending(man(s, d))),
    MAN + f", {SUMMARY} SELECT page_id, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS known_bytes, "
    + ", ".join(f"count(*) FILTER (st = '{x}') AS {x}_count" for x in ("known", "unknown", "pending", "unprobed"))
    + " FROM st GROUP BY page_id")

add("f_format_bytes",
    lambda s, d: E.size_summary(VW.selected_images(E.with_sizes(man(s, d), sizes(man(s, d))), selection(man(s, d))), pending(man(s, d))).selectExpr(
        "page_id", "known_bytes", f"{V.format_bytes('known_bytes')} AS size"),
    MAN + f""", {SUMMARY}, totals AS (SELECT page_id, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS n FROM st GROUP BY page_id)
    SELECT page_id, n AS known_bytes, CASE WHEN n < 1000 THEN n || ' B' ELSE regexp_replace(printf('%.1f', n / u + CASE WHEN n / u * 4 % 4 = 1 THEN 0.05 ELSE 0 END), '[.]0$', '') ||
        CASE u WHEN 1e9 THEN ' GB' WHEN 1e6 THEN ' MB' ELSE ' KB' END END AS size
    FROM (SELECT page_id, n, CASE WHEN n >= 1e9 THEN 1e9::DOUBLE WHEN n >= 1e6 THEN 1e6::DOUBLE ELSE 1e3::DOUBLE END AS u FROM totals)""")

# -- bundles -----------------------------------------------------------------------------------
results = lambda m: B.outcomes(E.classify(responses(m)))
RESULT = f"""{RESP}, res AS (SELECT *, CASE WHEN canceled THEN 'canceled' WHEN url LIKE 'data:%' THEN 'written' ELSE CASE doc_order % 8 WHEN 2 THEN 'http-403'
    WHEN 3 THEN 'http-415' WHEN 4 THEN 'rate-limit' WHEN 5 THEN 'truncated' WHEN 6 THEN 'truncated' WHEN 7 THEN 'truncated' ELSE 'written' END END AS result FROM resp)"""
add("bundle_outcomes", lambda s, d: results(man(s, d)).select("page_id", "doc_order", "result"), MAN + f", {RESULT} SELECT page_id, doc_order, result FROM res")
add("bundle_stats", lambda s, d: B.stats(results(man(s, d))),
    MAN + f""", {RESULT} SELECT page_id, count(*) AS requested, count(*) FILTER (result = 'written') AS written,
      count(*) FILTER (result NOT IN ('written', 'canceled')) AS skipped FROM res GROUP BY page_id""")
NOTES = " || ".join(
    "CASE WHEN n{0} > 0 THEN chr(10) || ".format(k) + (
        "'{}' || CASE WHEN n{} = 1 THEN 'this image is' ELSE 'these ' || n{} || ' images are' END || '{}'".format(
            t.split("{these}")[0].replace("'", "''"), k, k, t.split("{these}")[1].replace("'", "''"))
        if "{these}" in t else "'" + t.replace("'", "''") + "'") + " ELSE '' END"
    for k, (_, t) in enumerate(SKIP_FOOTNOTES))
add("bundle_skip_report", lambda s, d: B.skip_report(results(man(s, d))).select("page_id", "skipped", "total", "report"),
    MAN + f""", {RESULT}, agg AS (SELECT page_id, count(*) AS total, count(*) FILTER (result NOT IN ('written', 'canceled')) AS skipped,
      string_agg(filename || chr(9) || result || chr(9) || url, chr(10) ORDER BY doc_order) FILTER (result NOT IN ('written', 'canceled')) AS lines,
      {', '.join(f"count(*) FILTER (result = '{r}') AS n{k}" for k, (r, _) in enumerate(SKIP_FOOTNOTES))} FROM res GROUP BY page_id)
    SELECT page_id, skipped, total, 'skipped ' || skipped || ' of ' || total || chr(10) || chr(10) || lines || chr(10) ||
      {NOTES} || CASE WHEN n0 + n1 + n2 + n3 > 0 THEN chr(10) ELSE '' END AS report FROM agg WHERE skipped > 0""")
add("bundle_skip_counts", lambda s, d: B.skip_counts(results(man(s, d))).selectExpr("reason", "n", "CAST(footnote_rank AS BIGINT) AS footnote_rank"),
    MAN + f""", {RESULT} SELECT result AS reason, count(*) AS n, CASE result WHEN 'rate-limit' THEN 1 WHEN 'http-415' THEN 2 WHEN 'http-403' THEN 3
      WHEN 'truncated' THEN 4 END AS footnote_rank FROM res WHERE result NOT IN ('written', 'canceled') GROUP BY result""")
over("bundle_cap", lambda m: B.over_cap(VW.selected_images(m, selection(m)), 10),
     "SELECT page_id, count(*) AS n_selected, count(*) > 10 AS blocked FROM sel GROUP BY page_id")
add("w_bundle_shards",
    lambda s, d: B.shards(VW.selected_images(E.with_sizes(man(s, d), sizes(man(s, d))), selection(man(s, d))), 4, 20_000_000).select(
        "page_id", "doc_order", "shard"),
    MAN.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {SIDE}, {SIZED}, items AS (SELECT page_id, doc_order, coalesce(bytes, 16000000) AS wt,
      row_number() OVER (PARTITION BY page_id ORDER BY doc_order) AS k FROM sized WHERE doc_order % 3 = 0),
    fold AS (SELECT page_id, doc_order, k, 1 AS shard, 1 AS n, wt AS total FROM items WHERE k = 1
      UNION ALL SELECT i.page_id, i.doc_order, i.k, CASE WHEN f.n >= 4 OR f.total + i.wt > 20000000 THEN f.shard + 1 ELSE f.shard END,
        CASE WHEN f.n >= 4 OR f.total + i.wt > 20000000 THEN 1 ELSE f.n + 1 END,
        CASE WHEN f.n >= 4 OR f.total + i.wt > 20000000 THEN i.wt ELSE f.total + i.wt END
      FROM fold f JOIN items i ON i.page_id = f.page_id AND i.k = f.k + 1)
    SELECT page_id, doc_order, CAST(shard AS BIGINT) AS shard FROM fold""")

# -- coverage ----------------------------------------------------------------------------------
truth = lambda m: K.without_beacons(m.filter(D.TRUTH_WHERE).selectExpr(*D.TRUTH))
PLACE = "regexp_extract({}, '^([^?#]*)', 1)"
MATCH = f"""truth AS (SELECT {', '.join(D.TRUTH)} FROM man WHERE {D.TRUTH_WHERE}),
matched AS (SELECT t.page_id, t.url, CASE WHEN EXISTS (SELECT 1 FROM man m WHERE m.page_id = t.page_id AND m.url = t.url) THEN 'exact'
  WHEN EXISTS (SELECT 1 FROM man m WHERE m.page_id = t.page_id AND {PLACE.format('m.url')} = {PLACE.format('t.url')}) THEN 'variant' ELSE 'miss' END AS match
  FROM truth t WHERE w >= 3 AND h >= 3)"""
add("join_coverage", lambda s, d: K.classify_truth(truth(man(s, d)), man(s, d)).select("page_id", "url", "match"),
    MAN + f", {MATCH} SELECT page_id, url, match FROM matched")
add("coverage_pct", lambda s, d: K.coverage_pct(K.classify_truth(truth(man(s, d)), man(s, d)), "page_id"),
    MAN + f""", {MATCH} SELECT page_id, count(*) AS n_truth, 100.0::DOUBLE * count(*) FILTER (match = 'exact') / count(*) AS exact_pct,
      100.0::DOUBLE * count(*) FILTER (match <> 'miss') / count(*) AS logical_pct FROM matched GROUP BY page_id""")
add("join_vantage",
    lambda s, d: K.compare_vantage(
        man(s, d).filter("page_id % 9 <> 4").groupBy("page_id").agg(F.count("*").alias("n")),
        man(s, d).filter("page_id % 8 <> 5 OR doc_order > 1").groupBy("page_id").agg(F.count("*").alias("n"))),
    MAN + """SELECT page_id, n_a, n_b, n_a - n_b AS diff, CASE WHEN n_a = n_b THEN 'match' WHEN n_a = 0 OR n_b = 0 THEN 'one-side-empty' ELSE 'churn' END AS verdict
    FROM (SELECT page_id, count(*) FILTER (page_id % 9 <> 4) AS n_a, count(*) FILTER (page_id % 8 <> 5 OR doc_order > 1) AS n_b FROM man GROUP BY page_id)""")
