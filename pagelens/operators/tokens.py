"""Pages to tokens: the only step that reads ``html``; it needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import LAZY_ATTRS
from ..functions import html as H
from ..functions.sqltext import rlike
from ..functions.urls import split_absolute, with_resolved

# Attributes that any collector reads.
ATTRIBUTES = [
    "src", "srcset", "width", "height", "poster", "data", "href", "rel", "sizes", "property",
    "name", "content", "style", "type", *LAZY_ATTRS,
]
# Tokens that can yield a candidate or change another one's meaning. A superset decided on the tag
# text alone, so that nothing else leaves the page's row.
# One leading anchor: with an anchor per branch the regex engine would try every offset of the text.
_RELEVANT = "^<(?:%s)" % "|".join(
    [
        rf"(?i:/?picture|img|source|video|object|embed|style)[{H.WS}/>]",
        rf"(?i:meta)[{H.WS}/](?s:.*)(?i:image)",
        rf"(?i:link)[{H.WS}/](?s:.*)(?i:icon|stylesheet)",
        rf"(?i:script)[{H.WS}/][^>]*(?i:ld\+json)",
        rf"[a-zA-Z](?s:.*)(?i:{'|'.join(LAZY_ATTRS)})[{H.WS}]*=",
        r"[a-zA-Z](?s:.*)(?i:style)(?s:.*)(?:url|image-set)\(",
    ]
)


def cap_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Cut bodies at ``max_bytes``, if given (a character cut in half becomes U+FFFD), and flag the cut."""
    if max_bytes is None:
        return pages.withColumn("size_cap_hit", F.lit(False))
    over = f"octet_length(html) > {max_bytes}"
    cut = f"make_valid_utf8(CAST(substring(CAST(html AS BINARY), 1, {max_bytes}) AS STRING))"
    rest = [f"`{c}`" for c in pages.columns if c != "html"]
    return pages.selectExpr(
        *rest, f"CASE WHEN {over} THEN {cut} ELSE html END AS html", f"coalesce({over}, false) AS size_cap_hit"
    )


def page_tokens(pages: DataFrame, relevant_only: bool = False) -> DataFrame:
    """One row per token: page_id, pos, kind, tag, tok, self_closing."""
    toks = pages.selectExpr("page_id", f"{H.tokenize('html')} AS toks")
    toks = toks.selectExpr("page_id", f"{H.drop_cut_tag('toks')} AS toks")
    # Outer form: see page_marks.
    rows = toks.select("page_id", F.posexplode_outer("toks").alias("pos", "tok"))
    rows = rows.filter(f"tok IS NOT NULL AND NOT {rlike('tok', r'^<(?:[!?]|/[^a-zA-Z])')}")
    if relevant_only:
        rows = rows.filter(rlike("tok", _RELEVANT))
    kind = (
        f"CASE WHEN {H.is_raw('tok')} THEN 'raw' WHEN {rlike('tok', '^<[a-zA-Z]')} THEN 'start' "
        f"WHEN {rlike('tok', '^</[a-zA-Z]')} THEN 'end' ELSE 'text' END"
    )
    rows = rows.selectExpr("page_id", "pos", f"{kind} AS kind", f"{H.tag_name('tok')} AS tag", "tok")
    closed = f"kind IN ('start', 'raw') AND {H.self_closing(H.open_tag('tok'))}"
    return rows.selectExpr("*", f"{closed} AS self_closing")


def token_attributes(pages: DataFrame) -> DataFrame:
    """One row per attribute of every start tag; of duplicates in a tag only the first is kept."""
    toks = page_tokens(pages).filter("kind IN ('start', 'raw')")
    first = "filter(attrs, (a_, i_) -> NOT exists(slice(attrs, 1, i_), b_ -> b_.name = a_.name))"
    rows = toks.selectExpr("page_id", "pos", "tag", f"{H.attributes('tok')} AS attrs")
    rows = rows.selectExpr("page_id", "pos", "tag", f"inline_outer({first})")
    return rows.filter("name IS NOT NULL")


def with_document_base(pages: DataFrame) -> DataFrame:
    """Add the ``base`` struct: the page's <base href> if it resolves, else the page URL."""
    rows = pages.selectExpr("*", "coalesce(base_href, '') AS _b")
    rows = with_resolved(rows, "_b", "page", "_bu", sort=False).drop("_b")
    resolved = f"CASE WHEN base_href IS NOT NULL THEN {split_absolute('_bu')} END"
    return rows.selectExpr("*", f"coalesce({resolved}, page) AS base").drop("_bu")


def _marks(toks: str, frag: str, max_data_uri: int | None) -> str:
    """Relevant tokens and finished inline drawings of one token array."""
    kind = "array<struct<frag:int,pos:int,tok:string,uri:string>>"
    null = "CAST(NULL AS STRING)"
    tokens = (
        f"filter(transform({toks}, (t_, i_) -> struct(CAST({frag} AS INT) AS frag, i_ AS pos, t_ AS tok, "
        f"{null} AS uri)), m_ -> {rlike('m_.tok', _RELEVANT)})"
    )
    drawings = (
        f"transform({H.svg_islands(toks, max_data_uri)}, d_ -> struct(CAST({frag} AS INT) AS frag, d_.pos AS pos, "
        f"{null} AS tok, d_.uri AS uri))"
    )
    return f"concat(CAST({tokens} AS {kind}), CAST({drawings} AS {kind}))"


def page_marks(
    pages: DataFrame, noscript_budget: int | None = None, keep_all_pages: bool = False, max_data_uri: int | None = None
) -> DataFrame:
    """One row per token that can yield a candidate, noscript fragments included.

    Fragment 0 is the document; fragment k > 0 is its k-th non-blank noscript body, tokenized
    again. Each page is handled within its own row, so the job so far is a pure map: what reaches
    the first shuffle is only the small set of image-bearing tokens, never the page text.
    Expects ``page_id``, ``url``, ``html`` and (optionally) ``size_cap_hit`` columns.
    """
    if "size_cap_hit" not in pages.columns:
        pages = cap_pages(pages)
    keep = ["page_id", "size_cap_hit", "page"]
    s = pages.selectExpr(
        "page_id", "size_cap_hit", f"{split_absolute('url')} AS page", f"{H.tokenize('html')} AS toks"
    )
    s = s.selectExpr(*keep, f"{H.drop_cut_tag('toks')} AS toks")
    hrefs = (
        f"transform(filter(toks, t_ -> {H.starts_tag('t_', 'base')}), "
        f"t_ -> {H.attr(H.attributes('t_', ['href']), 'href')})"
    )
    s = s.selectExpr(
        *keep, "toks",
        f"get(filter({hrefs}, h_ -> h_ <> ''), 0) AS base_href",
        f"{H.noscript_bodies('toks', noscript_budget)} AS bodies",
    )
    s = s.selectExpr(
        *keep, "toks", "base_href", f"transform(bodies, b_ -> {H.tokenize('b_')}) AS fragments"
    )
    s = s.selectExpr(
        *keep, "toks", "base_href", f"transform(fragments, f_ -> {H.drop_cut_tag('f_')}) AS fragments"
    )
    s = s.selectExpr(
        *keep, "base_href",
        f"concat({_marks('toks', '0', max_data_uri)}, flatten(transform(fragments, (f_, k_) -> {_marks('f_', 'k_ + 1', max_data_uri)}))) AS marks",
    )
    s = with_document_base(s)
    # The outer form, also where empty pages are dropped: the optimizer would infer a size filter for
    # the inner form and push it below the projections, tokenizing every page twice.
    rows = s.select("page_id", "size_cap_hit", "base_href", "base", F.inline_outer("marks"))
    return rows if keep_all_pages else rows.filter(F.col("frag").isNotNull())
