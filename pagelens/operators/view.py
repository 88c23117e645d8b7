"""The manifest's view: filters, facets, variant tiles, sorts, selections. DataFrame in and out.

Selections are tables of ``(page_id, id)``; dimension callbacks are plain columns ``w`` and ``h``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    AUTO_PROBE_LIMIT, FORMAT_ALIASES, FORMATS, ICON_SOURCES, MEASURE_WARN_AT, REVEAL_BATCH, SOURCE_GROUPS,
)
from ..functions import values as V
from ..functions.sqltext import in_list, q
from .skew import join_dimension

UNIT = "coalesce(variant_group, id)"


# Filters: OR within a list, AND across lists, an empty list is no constraint.

def parse_param(raw: str | None, allowed: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """A query parameter's list: trimmed, lower-cased, aliased, unknown values dropped, distinct."""
    words = [w.strip().lower() for w in (raw or "").split(",")]
    return list(dict.fromkeys(v for v in ((aliases or {}).get(w, w) for w in words) if v in allowed))


def parse_format_param(raw: str | None) -> list[str]:
    return parse_param(raw, FORMATS, FORMAT_ALIASES)


def parse_source_param(raw: str | None) -> list[str]:
    return parse_param(raw, list(SOURCE_GROUPS))


def filter_images(m: DataFrame, query: str = "", formats=(), groups=()) -> DataFrame:
    """Rows that pass all constraints; constraints become plain predicates that reach the scan."""
    if query:
        text = query.lower()
        m = m.filter(F.lower("filename").contains(text) | F.lower("url").contains(text))
    if formats:
        m = m.filter(F.col("ext").isin(list(formats)))
    if groups:
        m = m.filter(F.col("source").isin([s for g in groups for s in SOURCE_GROUPS[g]]))
    return m


def remote_only(m: DataFrame) -> DataFrame:
    return m.filter(F.col("url").startswith("https://") | F.col("url").startswith("http://"))


def icons_only(m: DataFrame) -> DataFrame:
    return m.filter(F.col("source").isin(ICON_SOURCES))


def saved_filter_matches(m: DataFrame, presets: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Every preset ``name -> (formats, groups)`` applied to every image, one row per match.

    The presets are configuration, so they become a literal in the projection: no join, no shuffle.
    """
    words = lambda ws: f"CAST(array({', '.join(q(w) for w in ws)}) AS array<string>)"
    literal = ", ".join(
        f"struct({q(n)} AS preset, {words(f)} AS formats, {words(g)} AS groups)" for n, (f, g) in presets.items()
    )
    match = (
        "(size(p.formats) = 0 OR array_contains(p.formats, ext)) "
        "AND (size(p.groups) = 0 OR array_contains(p.groups, source_group))"
    )
    rows = with_source_group(m)
    return rows.selectExpr("*", f"explode(transform(filter(array({literal}), p -> {match}), p -> p.preset)) AS preset")


def with_source_group(m: DataFrame) -> DataFrame:
    """Add the user-facing group; the mapping is total, so no row is lost."""
    return m.withColumn("source_group", F.expr(V.source_group("source")))


# Facets: counts of one list with that list's own selection left out.

def _count(collapse: bool) -> Column:
    return (F.count_distinct(F.expr(UNIT)) if collapse else F.count("*")).alias("n")


def facet_format(m: DataFrame, query="", groups=(), collapse=False, by_page=True) -> DataFrame:
    keys = (["page_id"] if by_page else []) + ["ext"]
    return filter_images(m, query, groups=groups).groupBy(*keys).agg(_count(collapse))


def facet_format_all(m: DataFrame, query="", groups=(), collapse=False) -> DataFrame:
    return filter_images(m, query, groups=groups).groupBy("page_id").agg(_count(collapse))


def facet_group(m: DataFrame, query="", formats=(), collapse=False) -> DataFrame:
    rows = with_source_group(filter_images(m, query, formats=formats))
    return rows.groupBy("page_id", "source_group").agg(_count(collapse))


def facet_zero_fill(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """All formats in display order for each page, absent ones as 0."""
    formats = ", ".join(f"struct({k} AS rank, {q(f)} AS ext, {q(V_LABELS[f])} AS label)" for k, f in enumerate(FORMATS))
    full = pages.selectExpr("page_id", f"inline(array({formats}))")
    return full.join(counts, ["page_id", "ext"], "left").selectExpr(
        "page_id", "rank", "ext", "label", "coalesce(n, 0L) AS n"
    )


V_LABELS = {f: {"jpeg": "JPG"}.get(f, f.upper()) for f in FORMATS}


def facet_corpus(m: DataFrame) -> DataFrame:
    """Group and format counts over all pages with subtotals, in one pass."""
    rows = with_source_group(m)
    return rows.rollup("source_group", "ext").agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )


#: Sketches have 2^12 slots: a relative standard error of 1.6 %, and no estimate of a million is off by more than this.
SKETCH_BITS, SKETCH_ERROR = 12, 0.065


def unit_sketches(m: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable distinct-count sketches of images and pages per group: a few KiB each, however many rows a group has.

    To be written once per site and day; dashboards over sites, formats or days unite them and read no manifest rows.
    """
    return m.groupBy(*by).agg(F.hll_sketch_agg("id", SKETCH_BITS).alias("images"), F.hll_sketch_agg("page_id", SKETCH_BITS).alias("pages"))


def united_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct images and pages of coarser groups; the same as from one pass over all rows."""
    union = sketches.groupBy(*by).agg(F.hll_union_agg("images").alias("i"), F.hll_union_agg("pages").alias("p"))
    return union.select(*by, F.hll_sketch_estimate("i").alias("approx_images"), F.hll_sketch_estimate("p").alias("approx_pages"))


# Tiles: one per logical image.

def collapse_variants(m: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    """One row per unit: representative, member ids in document order, first position.

    Representative: largest area, then largest width, then the ``img`` member, then the earliest;
    known beats unknown. A total order, so one ``max_by`` aggregation does it without a sort per unit.
    """
    rank = F.expr(
        f"struct(coalesce({V.area(w, h)}, -1D) AS area, coalesce(CAST({w} AS BIGINT), -1L) AS w, source = 'img' AS img, "
        "-doc_order AS o)"
    )
    rep = F.struct("id", "url", "filename", "ext", "source", F.col(w).alias("w"), F.col(h).alias("h"), "doc_order")
    return (
        m.groupBy("page_id", F.expr(UNIT).alias("unit"))
        .agg(
            F.max_by(rep, rank).alias("rep"),
            F.expr("array_sort(collect_list(struct(doc_order, id)))").alias("members"),
            F.min("doc_order").alias("tile_order"),
        )
        .withColumn("n_members", F.size("members").cast("bigint"))
    )


def single_tiles(m: DataFrame) -> DataFrame:
    """Every image as its own tile, in the same shape; no shuffle."""
    rep = F.struct("id", "url", "filename", "ext", "source", F.col("width").alias("w"), F.col("height").alias("h"), "doc_order")
    return m.select(
        "page_id", F.col("id").alias("unit"), rep.alias("rep"),
        F.array(F.struct("doc_order", "id")).alias("members"),
        F.col("doc_order").alias("tile_order"), F.lit(1).cast("bigint").alias("n_members"),
    )


def tile_selection(tiles: DataFrame, selection: DataFrame) -> DataFrame:
    """Per tile: is the representative selected, are only others, how many are."""
    members = tiles.selectExpr("page_id", "unit", "rep.id AS rep_id", "n_members", "explode(members.id) AS id")
    marked = members.join(selection.withColumn("sel", F.lit(True)), ["page_id", "id"], "left")
    agg = marked.groupBy("page_id", "unit", "rep_id", "n_members").agg(
        F.expr("coalesce(bool_or(sel AND id = rep_id), false)").alias("checked"),
        F.expr("count_if(sel)").alias("selected_count"),
    )
    return agg.withColumn("partial", F.expr("NOT checked AND selected_count > 0"))


def selection_note(tile_states: DataFrame) -> DataFrame:
    """Pages on which a checked tile stands for several versions."""
    return tile_states.groupBy("page_id").agg(F.expr("bool_or(n_members > 1 AND checked)").alias("note"))


# Sorts, per page, ties in document order, unknown metrics last in both directions.

def sort_key(key: str, direction: str = "largest") -> list[Column]:
    doc = F.col("doc_order").asc()
    name = F.expr("collate(lower(filename), 'UNICODE')").asc()
    if key == "document":
        return [doc]
    if key == "name":
        return [name, doc]
    if key == "type":
        return [F.col("ext").asc(), name, doc]
    metric = F.expr({"width": "width", "height": "height", "imagesize": V.area("width", "height")}[key])
    return [metric.desc_nulls_last() if direction == "largest" else metric.asc_nulls_last(), doc]


def ranked(m: DataFrame, key: str, direction: str = "largest") -> DataFrame:
    """Add ``rank``, the 1-based place of the image in its page under a sort."""
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("page_id").orderBy(*sort_key(key, direction)))
    return m.withColumn("rank", order.cast("bigint"))


def reveal_batches(m: DataFrame, key="document", direction="largest", batch: int = REVEAL_BATCH) -> DataFrame:
    return ranked(m, key, direction).withColumn("batch", F.expr(f"(rank - 1) div {batch}"))


def top_images(m: DataFrame, k: int, key="imagesize") -> DataFrame:
    """The k largest per page; the rank filter is pushed below the shuffle by the planner."""
    return ranked(m, key).filter(F.col("rank") <= k)


# Selections.

def select_all(selection: DataFrame, filtered: DataFrame) -> DataFrame:
    keys = ["page_id", "id"]
    return selection.select(*keys).union(filtered.select(*keys)).distinct()


def invert_within(selection: DataFrame, filtered: DataFrame) -> DataFrame:
    """Symmetric difference with the filtered set, in one aggregation."""
    keys = ["page_id", "id"]
    both = selection.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("f")).union(
        filtered.select(*keys, F.lit(0), F.lit(1))
    )
    agg = both.groupBy(*keys).agg(F.max("s").alias("s"), F.max("f").alias("f"))
    return agg.filter("s + f = 1").select(*keys)


def toggle(selection: DataFrame, delta: DataFrame) -> DataFrame:
    """Each id of ``delta`` flips its state."""
    return invert_within(selection, delta)


def hidden_selected(selection: DataFrame, filtered: DataFrame) -> DataFrame:
    """Selected images that a filter hides; they stay selected."""
    return selection.join(filtered.select("page_id", "id"), ["page_id", "id"], "left_anti")


def select_range(order: DataFrame, anchors: DataFrame) -> DataFrame:
    """Images between anchor and target, inclusive, in the order given by ``rank``.

    ``anchors`` is ``(page_id, anchor_id, target_id)``. A missing anchor or target selects the target
    alone. Adds ``span``, the range's length.
    """
    places = (
        order.join(anchors, "page_id")
        .groupBy("page_id", "anchor_id", "target_id")
        .agg(
            F.expr("max(CASE WHEN id = anchor_id THEN rank END)").alias("a"),
            F.expr("max(CASE WHEN id = target_id THEN rank END)").alias("b"),
        )
    )
    hit = order.join(places, "page_id").filter(
        "CASE WHEN a IS NULL OR b IS NULL THEN id = target_id ELSE rank BETWEEN least(a, b) AND greatest(a, b) END"
    )
    return hit.withColumn("span", F.expr("coalesce(abs(a - b) + 1, 1L)")).drop("a", "b", "anchor_id", "target_id")


def auto_probe(selected_range: DataFrame, limit: int = AUTO_PROBE_LIMIT) -> DataFrame:
    """Ranges small enough to be measured without asking."""
    return selected_range.filter(F.col("span") <= limit)


def selected_images(m: DataFrame, selection: DataFrame) -> DataFrame:
    return m.join(selection.select("page_id", "id"), ["page_id", "id"], "left_semi")


def url_lists(m: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected URLs of each page in document order, one per line."""
    rows = selected_images(m, selection)
    lines = "array_join(transform(array_sort(collect_list(struct(doc_order, url))), x -> x.url), '\n')"
    return rows.groupBy("page_id").agg(F.expr(lines).alias("urls"))


# Dimensions.

def with_known_dims(m: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured dimensions win over declared ones as a pair, never mixed. ``measured(id, w, h)``.

    One image may sit on a large share of all pages; such an image's rows are split by size.
    """
    rows = join_dimension(m, measured.selectExpr("id", "struct(w, h) AS md"), ["id"])
    return rows.selectExpr(
        *[c for c in m.columns if c not in ("width", "height", "dimension_source")],
        "CASE WHEN md IS NOT NULL THEN md.w ELSE width END AS width",
        "CASE WHEN md IS NOT NULL THEN md.h ELSE height END AS height",
        "CASE WHEN md IS NOT NULL THEN 'measured' ELSE dimension_source END AS dimension_source",
    )


def dims_known(m: DataFrame, *keys: str) -> DataFrame:
    return m.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("width").alias("n_width"),
        F.count("height").alias("n_height"),
        F.expr("count_if(width IS NOT NULL AND height IS NOT NULL)").alias("n_both"),
    )


def measure_todo(m: DataFrame, probed: DataFrame, key: str) -> DataFrame:
    """Images whose active metric is unknown and that were not probed yet. ``probed(id)``."""
    unknown = {"width": "width IS NULL", "height": "height IS NULL"}.get(key, "width IS NULL OR height IS NULL")
    rows = m.filter(unknown)
    done = probed.select("id").distinct().selectExpr("id", "true AS _done")
    return join_dimension(rows, done, ["id"]).filter("_done IS NULL").drop("_done")


def measure_plan(todo: DataFrame, warn_at: int = MEASURE_WARN_AT) -> DataFrame:
    plan = todo.groupBy("page_id").agg(F.count("*").alias("n_todo"))
    return plan.withColumn("warn", F.col("n_todo") >= warn_at)


def page_status(scan: DataFrame) -> DataFrame:
    """results, empty, robots-blocked or error. ``scan`` has n_images, robots_allowed, error_code."""
    status = (
        "CASE WHEN error_code IS NOT NULL THEN 'error' WHEN NOT robots_allowed THEN 'robots-blocked' "
        "WHEN n_images = 0 THEN 'empty' ELSE 'results' END"
    )
    return scan.withColumn("status", F.expr(status))
