"""Registered queries: sources, tokens, collectors, windows of the manifest, scalar rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import html as H, values as V
from ..functions.sqltext import rlike
from ..functions.urls import split_absolute, url_host, with_resolved
from ..operators import candidates as C, manifest as M, tokens as T
from ..sources import derived as D
from ..sources.manifest_store import read_manifest, write_batch
from ..sources.shared import shared_folder
from . import oracle_base as O, pipeline as P
from .registry import add, crawl, man

PLAIN = f"WITH {O.TOKENS} "
ELS = f"WITH {O.ELEMENTS} "
CANDS = f"WITH {O.CANDIDATES} "
MAN = f"WITH {O.MANIFEST} "
COLS = "page_id, id, url, filename, ext, source, width, height, dimension_source, variant_group, doc_order"
CAND_COLS = ["page_id", "seq", "raw", "source", "width", "height", "variant_group"]

# -- sources -----------------------------------------------------------------------------------
add("scan_pages", lambda s, d: crawl(s, d).selectExpr("page_id", "url", "CAST(length(html) AS BIGINT) AS n_chars", "md5(html) AS digest"),
    f"WITH {O.CRAWL} SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM crawl")
add("scan_pages_capped",
    lambda s, d: T.cap_pages(crawl(s, d), 4000).selectExpr(
        "page_id", "size_cap_hit", "CAST(length(html) AS BIGINT) AS kept_chars"),
    f"""WITH {O.CRAWL}, ch AS (SELECT page_id, i, sum(strlen(c)) OVER (PARTITION BY page_id ORDER BY i) AS upto, strlen(c) AS n FROM (
      SELECT page_id, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i FROM crawl))
    SELECT c.page_id, strlen(html) > 4000 AS size_cap_hit,
      CAST(count(*) FILTER (upto <= 4000) + max(CASE WHEN upto > 4000 AND upto - n < 4000 THEN 1 ELSE 0 END) AS BIGINT) AS kept_chars
    FROM crawl c JOIN ch USING (page_id) GROUP BY ALL""")

SHEETS_SQL = (
    f"sheets AS (SELECT {', '.join(D.SHEETS)} FROM (SELECT DISTINCT {D.SHEET_ORIGIN} AS origin, page_id % 7 AS m FROM pages))"
)
LINKS_SQL = f"""links AS (SELECT t.page_id, row_number() OVER (PARTITION BY t.page_id ORDER BY t.frag, t.pos) AS sheet_no,
    {O.resolve(O.at('href'), 'd.base')} AS sheet_url FROM els t JOIN docs d USING (page_id)
  WHERE tag = 'link' AND list_contains(string_split({O.at('rel')}, ' '), 'stylesheet'))"""


def sheets(s, d):
    pairs = D.read_pages(s, d).selectExpr(f"{D.SHEET_ORIGIN} AS origin", "page_id % 7 AS m").distinct()
    return pairs.selectExpr(*D.SHEETS)


add("scan_stylesheets",
    lambda s, d: C.stylesheet_links(C.page_elements(crawl(s, d)), 3).join(sheets(s, d), "sheet_url", "left").selectExpr(
        "page_id", "CAST(sheet_no AS BIGINT) AS sheet_no", "sheet_url",
        "coalesce(status BETWEEN 200 AND 299, false) AS usable"),
    ELS + f""", {SHEETS_SQL}, {LINKS_SQL} SELECT page_id, sheet_no, sheet_url, coalesce(status BETWEEN 200 AND 299, false) AS usable
    FROM links LEFT JOIN sheets USING (sheet_url) WHERE sheet_no <= 3""")

# -- tokens ------------------------------------------------------------------------------------
add("tokens",
    lambda s, d: T.page_tokens(crawl(s, d)).groupBy("page_id", "kind", "tag").agg(
        F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars"), F.sum("pos").cast("bigint").alias("pos_sum"),
        F.count_if("self_closing").alias("n_self_closing")),
    PLAIN + """SELECT page_id, CASE WHEN regexp_matches(tok, '^<(?i:script|style|noscript|title)[ >]') THEN 'raw'
        WHEN tok LIKE '</%' THEN 'end' WHEN tok LIKE '<_%' THEN 'start' ELSE 'text' END AS kind,
      lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag, count(*) AS n, CAST(sum(length(tok)) AS BIGINT) AS chars,
      CAST(sum(pos) AS BIGINT) AS pos_sum, count(*) FILTER (tok LIKE '%/>' AND tok NOT LIKE '</%') AS n_self_closing
    FROM tok0 WHERE tok NOT LIKE '<!%' GROUP BY ALL""")
add("token_attrs",
    lambda s, d: T.token_attributes(crawl(s, d)).groupBy("page_id", "tag", "name").agg(
        F.count("*").alias("n"), F.sum(F.length("value")).cast("bigint").alias("chars"), F.max("value").alias("top")),
    PLAIN + r"""SELECT page_id, tag, name, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars, max(value) AS top FROM (
      SELECT page_id, tag, lower(unnest(regexp_extract_all(inner_text, '([a-zA-Z:-]+)="([^"]*)"', 1))) AS name,
        unnest(regexp_extract_all(inner_text, '([a-zA-Z:-]+)="([^"]*)"', 2)) AS value
      FROM (SELECT page_id, lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) AS tag,
          regexp_extract(tok, '^<[a-zA-Z0-9]+((?:\s+[a-zA-Z:-]+="[^"]*")*)', 1) AS inner_text FROM tok0 WHERE regexp_matches(tok, '^<[a-zA-Z]')))
    GROUP BY ALL""")
add("x_base",
    lambda s, d: T.page_marks(crawl(s, d), keep_all_pages=True).select("page_id", "base_href").distinct(),
    ELS + "SELECT c.page_id, base_href FROM crawl c LEFT JOIN bases USING (page_id)")


# -- collectors --------------------------------------------------------------------------------
def collector(name: str, source: str, extra: str = "true"):
    def run(s, d):
        rows = C.html_candidates(C.page_elements(crawl(s, d))).filter(F.col("source") == source).filter(extra)
        return rows.selectExpr("page_id", "CAST(frag AS BIGINT) AS frag", "raw", "width", "height", "variant_group")

    add(name, run, CANDS + f"""SELECT page_id, frag, raw, width, height, CASE WHEN grp IS NOT NULL THEN
      CASE WHEN frag > 0 THEN 'n' || (frag - 1) || '-' ELSE '' END || 'vg-' || grp END AS variant_group
    FROM (SELECT page_id, frag, trim(raw) AS raw, width, height, grp, source FROM cand0)
    WHERE source = '{source}' AND raw <> '' AND {extra}""")


for key, source in [
    ("x_img", "img"), ("x_srcset", "srcset"), ("x_picture", "picture"), ("x_poster", "poster"), ("x_object", "object"),
    ("x_embed", "embed"), ("x_favicon", "favicon"), ("x_meta", "meta"), ("x_style_attr", "style-attr"),
    ("x_style_block", "style-block"), ("x_json_ld", "json-ld"), ("x_inline_svg", "inline-svg"), ("x_lazy", "lazy"),
]:
    collector(key, source)
collector("x_meta_dims", "meta", "width IS NOT NULL")
add("x_stylesheet_links",
    lambda s, d: C.stylesheet_links(C.page_elements(crawl(s, d)), limit=3).selectExpr(
        "page_id", "CAST(sheet_no AS BIGINT) AS sheet_no", "sheet_url"),
    ELS + f", {LINKS_SQL} SELECT page_id, sheet_no, sheet_url FROM links WHERE sheet_no <= 3")
add("x_noscript",
    lambda s, d: C.html_candidates(C.page_elements(crawl(s, d))).filter("frag > 0").selectExpr(
        "page_id", "CAST(frag AS BIGINT) AS frag", "raw", "source", "variant_group"),
    CANDS + """SELECT page_id, frag, trim(raw) AS raw, source, 'n' || (frag - 1) || '-vg-' || grp AS variant_group
    FROM cand0 WHERE frag > 0 AND trim(raw) <> ''""")
SHEET_CANDS_SQL = f"""{SHEETS_SQL}, {LINKS_SQL},
sheet_urls AS (SELECT sheet_url, 1 AS ix, {O.resolve("regexp_extract(css, 'url[(]([^)]*)[)]', 1)", 'final_url')} AS raw FROM sheets WHERE status = 200
  UNION ALL SELECT sheet_url, 2, {O.resolve("regexp_extract(css, 'image-set[(].([^ ]*). 1x', 1)", 'final_url')} FROM sheets WHERE status = 200),
sheet_cands AS (SELECT l.page_id, l.sheet_no, u.ix, u.raw FROM links l JOIN sheet_urls u USING (sheet_url) WHERE sheet_no <= 3)"""
add("x_stylesheet",
    lambda s, d: P.stylesheet_candidates(C.page_elements(crawl(s, d)), sheets(s, d), 3).selectExpr(
        "page_id", "CAST(sheet_no AS BIGINT) AS sheet_no", "CAST(i + 1 AS BIGINT) AS ix", "raw"),
    ELS + f", {SHEET_CANDS_SQL} SELECT page_id, sheet_no, CAST(ix AS BIGINT) AS ix, raw FROM sheet_cands")
add("join_sheets",
    lambda s, d: P.stylesheet_candidates(C.page_elements(crawl(s, d)), sheets(s, d), 3).groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_distinct("sheet_no").alias("n_sheets")),
    ELS + f", {SHEET_CANDS_SQL} SELECT page_id, count(*) AS n, count(DISTINCT sheet_no) AS n_sheets FROM sheet_cands GROUP BY page_id")
add("raw_candidates", lambda s, d: C.raw_candidates(crawl(s, d)).select(*CAND_COLS),
    CANDS + f"SELECT {', '.join(CAND_COLS)} FROM cands")
add("limit_candidates",
    lambda s, d: C.raw_candidates(crawl(s, d), raw_cap=30).groupBy("page_id").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.bool_or("hit_raw_cap").alias("hit_raw_cap")),
    CANDS + """SELECT page_id, least(count(*), 30) AS n, least(max(seq), 30) AS last_seq, count(*) > 30 AS hit_raw_cap
    FROM cands GROUP BY page_id""")
add("set_union_sources",
    lambda s, d: C.html_candidates(C.page_elements(crawl(s, d))).groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages")),
    CANDS + "SELECT source, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM cands GROUP BY source")

# -- manifest ----------------------------------------------------------------------------------
add("manifest", lambda s, d: P.extract_manifest(crawl(s, d)), MAN + f"SELECT {COLS} FROM man")
add("manifest_with_sheets",
    lambda s, d: P.extract_manifest(crawl(s, d), sheets(s, d), max_sheets=3).drop("id"),
    CANDS + f""", {SHEET_CANDS_SQL}, all_cands AS (SELECT page_id, seq, raw, source, width, height, variant_group FROM cands
      UNION ALL SELECT page_id, 1000000 + sheet_no * 1000 + ix, raw, 'stylesheet', NULL, NULL, NULL FROM sheet_cands),
    {O.manifest_cte('all_cands', with_id=False)} SELECT {COLS.replace('id, url', 'url', 1) if False else COLS.replace(' id,', '')} FROM man""")
add("f_image_id", lambda s, d: man(s, d).select("url", "id").distinct(),
    MAN + "SELECT DISTINCT url, id FROM man")


def element_scope(s, d):
    els = C.page_elements(crawl(s, d))
    els = els.filter("picture_start OR picture_end OR takes_group OR exists(cands, c -> c.source = 'img')")
    return els.groupBy("page_id", F.col("frag").cast("bigint").alias("frag")).agg(
        F.count_if("inside").alias("n_inside"), F.count_if("picture_start").alias("n_pictures"),
        F.max("picture_no").cast("bigint").alias("last_picture"))


add("w_picture_scope", element_scope,
    ELS + """SELECT page_id, frag, count(*) FILTER (inside = 1 AND (tag IN ('picture', 'img', 'source'))) AS n_inside,
      count(*) FILTER (tag = 'picture') AS n_pictures, CAST(max(pno) AS BIGINT) AS last_picture
    FROM els GROUP BY page_id, frag HAVING count(*) FILTER (tag IN ('picture', 'img', 'source')) > 0""")
add("w_variant_group",
    lambda s, d: C.html_candidates(C.page_elements(crawl(s, d))).filter("variant_group IS NOT NULL").groupBy("page_id", "variant_group").agg(
        F.count("*").alias("n"), F.min("raw").alias("first_raw"), F.max("raw").alias("last_raw")),
    CANDS + """SELECT page_id, variant_group, count(*) AS n, min(raw) AS first_raw, max(raw) AS last_raw FROM cands
    WHERE variant_group IS NOT NULL GROUP BY ALL""")
add("w_dedupe",
    lambda s, d: M.admitted_candidates(C.raw_candidates(crawl(s, d))).filter("image_url IS NOT NULL").selectExpr(
        "page_id", "seq", "image_url", "source", "width", "height"),
    MAN + "SELECT page_id, seq, url AS image_url, source, width, height FROM firsts")
add("w_unit_cap",
    lambda s, d: M.manifest(C.raw_candidates(crawl(s, d)), max_units=8).drop("id"),
    CANDS + f", {O.manifest_cte(max_units=8, with_id=False)} SELECT {COLS.replace(' id,', '')} FROM man")
add("w_unique_filename", lambda s, d: man(s, d).select("page_id", "doc_order", "filename"),
    MAN + "SELECT page_id, doc_order, filename FROM man")
add("w_inline_counter",
    lambda s, d: man(s, d).filter("startswith(url, 'data:')").select("page_id", "doc_order", "filename", "ext"),
    MAN + "SELECT page_id, doc_order, filename, ext FROM man WHERE url LIKE 'data:%'")
add("w_doc_order",
    lambda s, d: man(s, d).groupBy("page_id").agg(
        F.count("*").alias("n"), F.max("doc_order").alias("last"), F.expr("min_by(url, doc_order)").alias("first_url"),
        F.expr("max_by(url, doc_order)").alias("last_url")),
    MAN + """SELECT page_id, count(*) AS n, max(doc_order) AS last, arg_min(url, doc_order) AS first_url,
      arg_max(url, doc_order) AS last_url FROM man GROUP BY page_id""")
add("filter_scheme",
    lambda s, d: M.resolved_candidates(C.raw_candidates(crawl(s, d))).groupBy("page_id").agg(
        F.count("image_url").alias("kept"), F.count_if(F.col("image_url").isNull()).alias("dropped")),
    MAN + """SELECT page_id, count(url) AS kept, count(*) FILTER (url IS NULL) AS dropped FROM resolved GROUP BY page_id""")
IMAGES_JSON = "to_json(transform(array_sort(collect_list(struct(doc_order, url, ext, source))), x -> named_struct('url', x.url, 'ext', x.ext, 'source', x.source)))"


def sunk(s, d):
    """Two batches of pages, one of them written twice (first with all pages), read back."""
    folder = f"{shared_folder(s)}/pagelens/store-{uuid.uuid4().hex}"
    rows = man(s, d).groupBy("page_id").agg(F.expr(IMAGES_JSON).alias("images"))
    for batch, pages in (("b1", "page_id % 2 = 0"), ("b2", "true"), ("b2", "page_id % 2 = 1")):
        write_batch(rows.filter(pages), folder, batch)
    return read_manifest(s, folder, "page_id bigint, images string").select("batch", "page_id", "images")


add("sink_manifest", sunk,
    MAN + """SELECT CASE page_id % 2 WHEN 0 THEN 'b1' ELSE 'b2' END AS batch, page_id, CAST(to_json(list({'url': url, 'ext': ext, 'source': source} ORDER BY doc_order)) AS VARCHAR) AS images
    FROM man GROUP BY page_id""")

# -- scalar rules as corpus jobs ---------------------------------------------------------------
HREFS = f"""hrefs AS (SELECT page_id, {O.at('href')} AS raw FROM els WHERE tag IN ('a', 'link', 'base') AND frag = 0 AND {O.at('href')} IS NOT NULL
  UNION ALL SELECT page_id, url FROM pages)"""


def links(s, d):
    """Each page's own URL and all references of its links, resolved; one scan."""
    hrefs = f"transform(filter(toks, t_ -> {H.starts_tag('t_', 'a', 'link', 'base')}), t_ -> {H.attr(H.attributes('t_', ['href']), 'href')})"
    rows = crawl(s, d).selectExpr("url", f"{split_absolute('url')} AS base", f"{H.tokenize('html')} AS toks")
    rows = rows.selectExpr("base", f"explode(concat(array(url), filter({hrefs}, h_ -> h_ <> ''))) AS raw")
    return with_resolved(rows, "raw", "base", "u")


add("f_resolve_url",
    lambda s, d: links(s, d).selectExpr(f"{url_host('u')} AS host", "u").groupBy("host").agg(
        F.count_distinct("u").alias("n_urls"), F.count("*").alias("n"), F.min("u").alias("first_url"), F.max("u").alias("last_url")),
    ELS + f""", {HREFS}, res AS (SELECT {O.encoded(O.sort_params('u0'))} AS u FROM (
      SELECT {O.resolve('h.raw', 'p.url')} AS u0 FROM hrefs h JOIN pages p USING (page_id)))
    SELECT regexp_extract(u, '^[a-z]+://([^/?#]+)', 1) AS host, count(DISTINCT u) AS n_urls, count(*) AS n, min(u) AS first_url, max(u) AS last_url
    FROM res GROUP BY host""")
add("f_document_base",
    lambda s, d: T.page_marks(crawl(s, d), keep_all_pages=True).selectExpr(
        "page_id", "concat(base.scheme, '://', base.authority, base.path) AS base").distinct(),
    ELS + "SELECT page_id, regexp_replace(base, '[?#].*$', '') AS base FROM docs")
add("f_parse_srcset",
    lambda s, d: C.html_candidates(C.page_elements(crawl(s, d))).filter("source IN ('srcset', 'picture', 'lazy')").groupBy("source", "width").agg(
        F.count("*").alias("n")),
    CANDS + "SELECT source, width, count(*) AS n FROM cands WHERE source IN ('srcset', 'picture', 'lazy') GROUP BY ALL")
add("f_css_urls",
    lambda s, d: sheets(s, d).selectExpr("sheet_url", f"inline(transform({V.css_urls('css')}, (u, i) -> struct(CAST(i AS BIGINT) AS ix, u AS raw)))"),
    f"""WITH {SHEETS_SQL} SELECT sheet_url, 0 AS ix, regexp_extract(css, 'url[(]([^)]*)[)]', 1) AS raw FROM sheets
    UNION ALL SELECT sheet_url, 1, regexp_extract(css, 'image-set[(].([^ ]*). 1x', 1) FROM sheets""")
# Widths and heights of all elements as written, table cells' odd ones included.
SIDES_SQL = PLAIN + r""", attrs AS (SELECT tag, lower(unnest(regexp_extract_all(inner_text, '([a-zA-Z:-]+)="([^"]*)"', 1))) AS name,
        unnest(regexp_extract_all(inner_text, '([a-zA-Z:-]+)="([^"]*)"', 2)) AS value
      FROM (SELECT lower(regexp_extract(tok, '^<([a-zA-Z0-9]+)', 1)) AS tag,
          regexp_extract(tok, '^<[a-zA-Z0-9]+((?:\s+[a-zA-Z:-]+="[^"]*")*)', 1) AS inner_text FROM tok0 WHERE regexp_matches(tok, '^<[a-zA-Z]'))),
sides AS (SELECT tag, value, count(*) AS n FROM attrs WHERE name IN ('width', 'height') GROUP BY ALL)"""


def sides(s, d):
    attrs = T.token_attributes(crawl(s, d)).filter("name IN ('width', 'height')")
    return attrs.groupBy("tag", "value").agg(F.count("*").alias("n"))


add("f_coerce_dim", lambda s, d: sides(s, d).selectExpr("tag", "value", "n", f"{V.leading_int('value')} AS dim"),
    SIDES_SQL + " SELECT tag, value, n, nullif(TRY_CAST(nullif(regexp_extract(value, '^\\s*([0-9]+)', 1), '') AS BIGINT), 0) AS dim FROM sides")
add("f_int_attr", lambda s, d: sides(s, d).selectExpr("tag", "value", "n", f"{V.int_attr('value')} AS dim"),
    SIDES_SQL + " SELECT tag, value, n, CASE WHEN regexp_matches(value, '^[0-9]+$') THEN nullif(CAST(value AS BIGINT), 0) END AS dim FROM sides")
add("f_ext_path",
    lambda s, d: man(s, d).filter("NOT startswith(url, 'data:')").groupBy(F.expr(url_host("url")).alias("host"), "ext").agg(F.count("*").alias("n")),
    MAN + "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, ext, count(*) AS n FROM man WHERE url NOT LIKE 'data:%' GROUP BY ALL")
add("f_ext_data",
    lambda s, d: man(s, d).filter("startswith(url, 'data:')").groupBy("source", "ext").agg(F.count("*").alias("n")),
    MAN + "SELECT source, ext, count(*) AS n FROM man WHERE url LIKE 'data:%' GROUP BY ALL")
add("f_filename",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", f"{V.base_filename('url', V.ext_of_url('url'))} AS filename"),
    "SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS filename FROM pages")
_NAME = "CASE page_id % 4 WHEN 0 THEN '..a/b' || page_id || chr(9) || '.png' WHEN 1 THEN repeat('x', 90) || page_id || '.jpeg' WHEN 2 THEN repeat('y', 85) || '.' || repeat('z', 20) ELSE url END"
add("f_sanitize_filename",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", f"{_NAME} AS v").selectExpr("page_id", f"{V.sanitize_filename('v')} AS filename"),
    f"""SELECT page_id, CASE WHEN length(c) <= 80 THEN c WHEN strpos(reverse(c), '.') BETWEEN 1 AND 10 THEN
        left(c, 80 - strpos(reverse(c), '.')) || right(c, strpos(reverse(c), '.')) ELSE left(c, 80) END AS filename
    FROM (SELECT page_id, regexp_replace(regexp_replace(replace(replace(v, '/', '-'), chr(92), '-'), '[\\x00-\\x1f\\x7f]', '', 'g'), '^[.]+', '') AS c
      FROM (SELECT page_id, {_NAME} AS v FROM pages))""")
add("f_variant_unit",
    lambda s, d: man(s, d).groupBy("page_id", F.expr("coalesce(variant_group, id)").alias("unit")).agg(F.count("*").alias("n")),
    MAN + "SELECT page_id, coalesce(variant_group, id) AS unit, count(*) AS n FROM man GROUP BY ALL")
add("f_data_uri_bytes",
    lambda s, d: man(s, d).filter("startswith(url, 'data:')").selectExpr("page_id", "doc_order", f"{V.data_uri_bytes('url')} AS bytes"),
    MAN + """SELECT page_id, doc_order, CASE WHEN url LIKE '%;base64,%' THEN CAST(octet_length(from_base64(split_part(url, ',', 2))) AS BIGINT)
      ELSE strlen(url_decode(substring(url, strpos(url, ',') + 1))) END AS bytes FROM man WHERE url LIKE 'data:%'""")
add("f_format_label",
    lambda s, d: man(s, d).groupBy("ext", F.expr(V.format_label("ext")).alias("label")).agg(F.count("*").alias("n")),
    MAN + "SELECT ext, CASE ext WHEN 'jpeg' THEN 'JPG' ELSE upper(ext) END AS label, count(*) AS n FROM man GROUP BY ALL")
_CT = "CASE page_id % 4 WHEN 0 THEN 'image/PNG; q=1' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'text/html' ELSE 'image/svg+xml' END"
add("f_download_name",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", "url", f"{_CT} AS ct").selectExpr("page_id", f"{V.download_filename('url', 'ct')} AS name"),
    f"""SELECT page_id, CASE WHEN regexp_matches(n, '[.][a-zA-Z0-9]{{1,10}}$') OR page_id % 4 = 2 THEN n
      ELSE n || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.svg' END END AS name
    FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS n FROM pages)""")
