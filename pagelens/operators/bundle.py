"""Bundling selected images: member outcomes, skip reports, shard plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import BUNDLE_BYTES, BUNDLE_MEMBERS, SKIP_FOOTNOTES
from ..functions.sqltext import q


def outcomes(members: DataFrame) -> DataFrame:
    """Outcome of each member: written, canceled, rate-limit, http-N or truncated.

    ``members`` has url, status, outcome (see ``enrich.classify``), complete and canceled flags.
    """
    inline = "startswith(url, 'data:')"
    return members.selectExpr(
        "*",
        f"CASE WHEN canceled THEN 'canceled' WHEN {inline} THEN 'written' WHEN status = 429 THEN 'rate-limit' "
        "WHEN outcome = 'not-an-image' THEN 'http-415' "
        "WHEN NOT (status BETWEEN 200 AND 299) THEN concat('http-', CAST(status AS STRING)) "
        "WHEN outcome = 'size-limit' OR NOT complete THEN 'truncated' ELSE 'written' END AS result",
    )


def stats(results: DataFrame) -> DataFrame:
    return results.groupBy("page_id").agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("result") == "written").alias("written"),
        F.count_if(~F.col("result").isin("written", "canceled")).alias("skipped"),
    )


def skip_report(results: DataFrame) -> DataFrame:
    """Text of each bundle's skip report; a page's members are bounded by the candidate caps."""
    lines = (
        "array_join(transform(array_sort(collect_list(CASE WHEN result NOT IN ('written', 'canceled') THEN "
        "struct(doc_order, concat(filename, '\t', result, '\t', url) AS line) END)), x -> x.line), '\n')"
    )
    counts = [F.expr(f"count_if(result = {q(r)})").alias(f"n{k}") for k, (r, _) in enumerate(SKIP_FOOTNOTES)]
    agg = results.groupBy("page_id").agg(
        F.count("*").alias("total"),
        F.expr("count_if(result NOT IN ('written', 'canceled'))").alias("skipped"),
        F.expr(lines).alias("lines"),
        *counts,
    )
    notes = []
    for k, (_, text) in enumerate(SKIP_FOOTNOTES):
        before, _, after = text.partition("{these}")
        these = f"CASE WHEN n{k} = 1 THEN 'this image is' ELSE concat('these ', n{k}, ' images are') END"
        body = f"concat({q(before)}, {these}, {q(after)})" if after else q(text)
        notes.append(f"CASE WHEN n{k} > 0 THEN {body} END")
    footer = f"array_compact(array({', '.join(notes)}))"
    report = (
        "concat('skipped ', skipped, ' of ', total, '\n\n', lines, '\n', "
        f"CASE WHEN size({footer}) > 0 THEN concat('\n', array_join({footer}, '\n'), '\n') ELSE '' END)"
    )
    return agg.filter("skipped > 0").selectExpr("page_id", "skipped", "total", f"{report} AS report")


def skip_counts(results: DataFrame) -> DataFrame:
    """Skips by reason over the corpus, with the report's footnote rank."""
    rank = "CASE result " + " ".join(f"WHEN {q(r)} THEN {k + 1}" for k, (r, _) in enumerate(SKIP_FOOTNOTES)) + " END"
    rows = results.filter("result NOT IN ('written', 'canceled')")
    return rows.groupBy(F.col("result").alias("reason")).agg(F.count("*").alias("n")).selectExpr(
        "reason", "n", f"{rank.replace('result', 'reason', 1)} AS footnote_rank"
    )


def over_cap(selected: DataFrame, cap: int = BUNDLE_MEMBERS) -> DataFrame:
    """Selections larger than a bundle may be are blocked whole, never truncated."""
    return selected.groupBy("page_id").agg(F.count("*").alias("n_selected")).withColumn(
        "blocked", F.col("n_selected") > cap
    )


def shards(selected: DataFrame, max_members: int = BUNDLE_MEMBERS, max_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Add ``shard``: members in document order, next-fit under both caps, a too-big item alone.

    The fold runs inside one row per page; a page's members are bounded by the candidate caps.
    """
    members = "array_sort(collect_list(struct(doc_order, id, weight)))"
    pages = selected.groupBy("page_id").agg(F.expr(members).alias("members"))
    opens = f"(acc.n >= {max_members} OR (acc.n > 0 AND acc.bytes + x.weight > {max_bytes}))"
    step = (
        f"struct(CASE WHEN {opens} THEN acc.shard + 1 ELSE acc.shard END AS shard, "
        f"CASE WHEN {opens} THEN 1L ELSE acc.n + 1 END AS n, "
        f"CASE WHEN {opens} THEN x.weight ELSE acc.bytes + x.weight END AS bytes, "
        f"concat(acc.out, array(CASE WHEN {opens} THEN acc.shard + 1 ELSE acc.shard END)) AS out)"
    )
    zero = "struct(1L AS shard, 0L AS n, 0L AS bytes, CAST(array() AS array<bigint>) AS out)"
    folded = pages.selectExpr("page_id", "members", f"aggregate(members, {zero}, (acc, x) -> {step}).out AS shard_of")
    rows = folded.selectExpr("page_id", "inline(arrays_zip(members, shard_of))")
    return rows.selectExpr("page_id", "members.doc_order", "members.id", "members.weight", "shard_of AS shard")
