"""Tokens to raw image candidates.

Each token is turned into its candidates by one array expression that covers every kind of markup,
so a page is scanned once instead of once per kind. Only then do the rows shuffle by ``page_id``
for the few rules that look across tokens: picture scope, variant-group numbering, social-image
sizes, the style budget and the raw cap. The windows see one page, and a page is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import (
    ICON_RELS, LAZY_ATTRS,
    META_IMAGE_KEYS,
)
from ..functions import html as H, values as V
from ..functions.json_ld import json_ld_images
from ..functions.sqltext import extract, in_list, q, rlike
from ..functions.urls import js_trim, with_resolved
from .tokens import ATTRIBUTES, page_marks

# Collection order within one element (fixed values).
RANK = {
    "img": 1, "source": 2, "video": 3, "object": 4, "embed": 5, "link": 6, "meta": 7,
    "style-attr": 8, "style": 9, "script": 10, "svg": 11, "lazy": 12,
}
NO_GROUP, OWN_GROUP, LAZY_GROUP = 0, 1, 2


def _cand(rank: int, source: str, raw: str, idx="0", width="NULL", height="NULL", grp=NO_GROUP) -> str:
    return (
        f"struct({rank} AS rank, CAST({idx} AS INT) AS idx, {raw} AS raw, {q(source)} AS source, "
        f"CAST({width} AS BIGINT) AS width, CAST({height} AS BIGINT) AS height, {grp} AS grp)"
    )


def _when(cond: str, cands: str) -> str:
    return f"CASE WHEN {cond} THEN {cands} ELSE array() END"


def element_candidates(marks: DataFrame) -> DataFrame:
    """Add each token's own candidates and the facts that the page-level rules need."""
    passed = [c for c in marks.columns if c not in ("tok", "uri")]
    has_body = rlike("tok", rf"^<(?:(?i:style)[{H.WS}/>]|(?i:script)[{H.WS}/][^>]*(?i:ld\+json))")
    parsed = marks.selectExpr(
        *passed, "uri",
        f"CASE WHEN NOT startswith(tok, '</') THEN {H.tag_name('tok')} ELSE '' END AS tag",
        f"coalesce({rlike('tok', rf'^</(?i:picture)[{H.WS}/>]')}, false) AS picture_end",
        f"CASE WHEN {has_body} THEN {H.raw_body('tok')} END AS body",
        f"{H.attributes('tok', ATTRIBUTES)} AS attrs",
    )
    # One pass over the short attribute array per name; absent attributes are NULL.
    flat = parsed.selectExpr(
        *passed, "uri", "coalesce(tag, '') AS tag", "picture_end", "body",
        *[f"{H.attr('attrs', n)} AS `@{n}`" for n in ATTRIBUTES],
    )
    g = {n: f"`@{n}`" for n in ATTRIBUTES}
    flat = flat.selectExpr(
        "*",
        f"{V.int_attr(g['width'])} AS w",
        f"{V.int_attr(g['height'])} AS h",
        f"split(lower(coalesce({g['rel']}, '')), {q(chr(92) + 's+')}) AS rel",
        f"lower(coalesce({g['property']}, {g['name']}, '')) AS key",
        f"CASE WHEN tag = 'script' AND contains(lower({g['type']}), 'ld+json') THEN body END AS ld_text",
    )
    ld = flat.select("*", json_ld_images(F.col("ld_text")).alias("ld"))

    def listed(urls: str, rank: int, source: str) -> str:
        return f"transform({urls}, (u_, i_) -> {_cand(rank, source, 'u_', 'i_')})"

    def set_members(v: str, rank: int, source: str, grp: int, scale: bool) -> str:
        height = V.scaled_height("x_.width", "w", "h") if scale else "NULL"
        return (
            f"transform({V.parse_srcset(v)}, (x_, i_) -> "
            f"{_cand(rank, source, 'x_.url', 'i_', 'x_.width', height, grp)})"
        )

    def single(tag: str, name: str, source: str) -> str:
        return _when(f"tag = '{tag}' AND {g[name]} <> ''", f"array({_cand(RANK[tag], source, g[name])})")

    is_sheet = "array_contains(rel, 'stylesheet')"
    is_icon = f"NOT {is_sheet} AND arrays_overlap(rel, array({', '.join(q(r) for r in ICON_RELS)}))"
    icon_dim = lambda k: f"TRY_CAST(nullif({extract(g['sizes'], '([0-9]+)[xX]([0-9]+)', k)}, '') AS BIGINT)"
    is_meta_image = f"(tag = 'meta' AND {in_list('key', META_IMAGE_KEYS)})"
    style = g["style"]
    arrays = [
        _when(f"tag = 'img' AND {g['src']} <> ''",
              f"array({_cand(RANK['img'], 'img', g['src'], '-1', 'w', 'h', OWN_GROUP)})"),
        _when(f"tag = 'img' AND {g['srcset']} <> ''", set_members(g["srcset"], RANK["img"], "srcset", OWN_GROUP, True)),
        _when(f"tag = 'source' AND {g['srcset']} <> ''",
              set_members(g["srcset"], RANK["source"], "picture", OWN_GROUP, False)),
        single("video", "poster", "poster"),
        single("object", "data", "object"),
        single("embed", "src", "embed"),
        _when(f"tag = 'link' AND {g['href']} <> '' AND {is_icon}",
              f"array({_cand(RANK['link'], 'favicon', g['href'], '0', icon_dim(1), icon_dim(2))})"),
        _when(f"{is_meta_image} AND {g['content']} <> ''", f"array({_cand(RANK['meta'], 'meta', g['content'])})"),
        _when(f"contains({style}, 'url(') OR contains({style}, 'image-set(')",
              listed(V.css_urls(style), RANK["style-attr"], "style-attr")),
        _when("tag = 'style'", listed(V.css_urls("body"), RANK["style"], "style-block")),
        _when("ld IS NOT NULL",
              f"transform(ld, (x_, i_) -> {_cand(RANK['script'], 'json-ld', 'x_.url', 'i_', 'x_.width', 'x_.height')})"),
        _when("uri IS NOT NULL", f"array({_cand(RANK['svg'], 'inline-svg', 'uri')})"),
    ]
    for k, name in enumerate(LAZY_ATTRS):
        v, rank = g[name], RANK["lazy"] + k
        if name == "data-srcset":
            arrays.append(_when(f"{v} <> ''", set_members(v, rank, "lazy", LAZY_GROUP, True)))
        else:
            arrays.append(
                f"CASE WHEN contains({v}, 'url(') THEN {listed(V.css_urls(v), rank, 'lazy')} "
                f"WHEN {v} <> '' THEN array({_cand(rank, 'lazy', v)}) ELSE array() END"
            )
    fields = ", ".join(f"c_.{f} AS {f}" for f in ("rank", "idx", "source", "width", "height", "grp"))
    every = f"transform(concat({', '.join(arrays)}), c_ -> struct({js_trim('c_.raw')} AS raw, {fields}))"
    content_dim = V.leading_int(g["content"])
    return ld.selectExpr(
        *passed,
        "tag = 'picture' AS picture_start",
        "picture_end",
        f"coalesce(tag IN ('img', 'source') AND {g['srcset']} <> '', false) AS takes_group",
        f"coalesce({g['data-srcset']} <> '', false) AS takes_lazy_group",
        f"{is_meta_image} AS meta_image",
        f"coalesce({is_meta_image} AND startswith(key, 'og:image') AND {js_trim(g['content'])} <> '', false) "
        "AS sized_meta",
        f"CASE WHEN tag = 'meta' AND key = 'og:image:width' THEN {content_dim} END AS meta_w",
        f"CASE WHEN tag = 'meta' AND key = 'og:image:height' THEN {content_dim} END AS meta_h",
        "CASE WHEN tag = 'style' THEN length(body) ELSE 0 END AS style_chars",
        f"CASE WHEN tag = 'link' AND {is_sheet} AND {g['href']} <> '' THEN {g['href']} END AS sheet_href",
        f"filter({every}, c_ -> c_.raw <> '') AS cands",
    )


def page_elements(
    pages: DataFrame, noscript_budget: int | None = None, style_budget: int | None = None, keep_all_pages: bool = False,
    max_data_uri: int | None = None, parts: int | None = None,
) -> DataFrame:
    """Elements with every cross-token rule applied; one shuffle, by ``page_id``, into ``parts`` if given."""
    els = element_candidates(page_marks(pages, noscript_budget, keep_all_pages, max_data_uri))
    els = els.repartition(*([] if parts is None else [parts]), "page_id")
    sofar = "OVER (PARTITION BY page_id, frag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = sofar.replace("CURRENT ROW", "1 PRECEDING")
    # Inside a <picture>? The last start or end tag decides.
    inside = f"last(CASE WHEN picture_start THEN true WHEN picture_end THEN false END, true) {sofar}"
    els = els.selectExpr(
        "*",
        f"coalesce({inside}, false) AS inside",
        f"sum(CAST(meta_image AS INT)) {sofar} AS meta_session",
        # Without a budget too: the window keeps the optimizer from copying the element expressions into later steps.
        f"coalesce(sum(style_chars) {before}, 0) < {2**62 if style_budget is None else style_budget}L AS style_open",
    )
    els = els.selectExpr(
        "*",
        "takes_group AND NOT inside AS own",
        "CAST(takes_lazy_group AND NOT inside AS INT) AS lazy",
        f"sum(CAST(picture_start AS INT) + CAST(takes_group AND NOT inside AS INT) + "
        f"CAST(takes_lazy_group AND NOT inside AS INT)) {sofar} AS group_no",
    )
    # Sizes follow their image: the last value before the next social image wins.
    session = "OVER (PARTITION BY page_id, frag, meta_session)"
    els = els.selectExpr("*", f"last(CASE WHEN picture_start THEN group_no END, true) {sofar} AS picture_no")
    els = els.selectExpr(
        "*",
        f"max_by(meta_w, CASE WHEN meta_w IS NOT NULL THEN pos END) {session} AS session_w",
        f"max_by(meta_h, CASE WHEN meta_h IS NOT NULL THEN pos END) {session} AS session_h",
    )
    return els.selectExpr(
        "*",
        "CASE WHEN inside THEN picture_no WHEN own THEN group_no - lazy END AS own_no",
        "CASE WHEN inside THEN picture_no WHEN lazy = 1 THEN group_no END AS lazy_no",
    )


#: Source of rows that are no candidates but links to style sheets.
LINK = "#sheet"


def html_candidates(els: DataFrame, keep_all_pages: bool = False, links: bool = False) -> DataFrame:
    """Candidates of all elements, with groups and social-image sizes filled in; with ``links`` also style sheet links."""
    cands = "cands"
    if links:
        link = (
            f"struct(sheet_href AS raw, 0 AS rank, 0 AS idx, {q(LINK)} AS source, CAST(NULL AS BIGINT) AS width, "
            f"CAST(NULL AS BIGINT) AS height, {NO_GROUP} AS grp)"
        )
        cands = f"concat(cands, CASE WHEN sheet_href IS NOT NULL THEN array({link}) ELSE array() END)"
    rows = els.selectExpr(
        "page_id", "size_cap_hit", "base", "frag", "pos", "own_no", "lazy_no", "sized_meta", "session_w",
        "session_h", "style_open", f"{'inline_outer' if keep_all_pages else 'inline'}({cands})",
    )
    rows = rows.filter("source IS NULL OR source <> 'style-block' OR style_open")
    number = f"CASE grp WHEN {OWN_GROUP} THEN own_no WHEN {LAZY_GROUP} THEN lazy_no END"
    prefix = "CASE WHEN frag > 0 THEN concat('n', CAST(frag - 1 AS STRING), '-') ELSE '' END"
    sized = "sized_meta AND source = 'meta'"
    return rows.selectExpr(
        "page_id", "size_cap_hit", "base", "frag", "pos", "rank", "idx", "raw", "source",
        f"CASE WHEN {sized} THEN session_w ELSE width END AS width",
        f"CASE WHEN {sized} THEN session_h ELSE height END AS height",
        f"concat({prefix}, 'vg-', CAST({number} AS STRING)) AS variant_group",
    )


def raw_candidates(
    pages: DataFrame, raw_cap: int | None = None, keep_all_pages: bool = False, links: bool = False, **budgets
) -> DataFrame:
    """Candidates in document order with ``seq``; with a ``raw_cap`` only the first ones of a page are kept.

    ``hit_raw_cap`` tells whether the page had more. ``base`` is the resolved document base. With ``links`` the page's
    style sheet links follow as rows with the source ``LINK``, numbered from 1.
    """
    els = page_elements(pages, keep_all_pages=keep_all_pages, **budgets)
    rows = html_candidates(els, keep_all_pages, links)
    # Rows without a candidate only mark their page: they sort last and one of them stays.
    kind = f"CASE WHEN raw IS NULL THEN 2 WHEN source = {q(LINK)} THEN 1 ELSE 0 END"
    rows = rows.selectExpr("*", f"{kind} AS kind")
    rows = rows.selectExpr("*", "CAST(row_number() OVER (PARTITION BY page_id, kind ORDER BY frag, pos, rank, idx) AS BIGINT) AS seq")
    rows = rows.selectExpr("*", "max(CASE WHEN kind = 0 THEN seq ELSE 0L END) OVER (PARTITION BY page_id) AS n_raw")
    rows = rows.filter(f"CASE kind WHEN 2 THEN seq = 1 WHEN 1 THEN true ELSE {'true' if raw_cap is None else f'seq <= {raw_cap}'} END")
    return rows.selectExpr(
        "page_id", "size_cap_hit", "base", "seq", "raw", "source", "width", "height", "variant_group",
        "false AS hit_raw_cap" if raw_cap is None else f"n_raw > {raw_cap} AS hit_raw_cap",
    )


def stylesheet_links(els: DataFrame, limit: int | None = None) -> DataFrame:
    """Linked style sheets per page (the first ``limit``, if given), document first, resolved to absolute URLs."""
    rows = els.filter(F.col("sheet_href").isNotNull()).select(
        "page_id", "base", "frag", "pos", "sheet_href"
    )
    order = W.partitionBy("page_id").orderBy("frag", "pos")
    rows = rows.withColumn("sheet_no", F.row_number().over(order))
    if limit is not None:
        rows = rows.filter(F.col("sheet_no") <= limit)
    rows = with_resolved(rows, "sheet_href", "base", "sheet_url", sort=False)
    return rows.select("page_id", "sheet_no", "sheet_href", "sheet_url")
