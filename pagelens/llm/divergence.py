"""Divergence audit: how far each source's vocabulary departs from other sources and from its language.

Terms are runs of letters (ASCII letters and all non-ASCII characters, A-Z lower-cased). A language keeps the terms that
occur in enough of its documents. Each group (language, source) and each language gives a kept term the smoothed share
``p = 1 + floor(10^9 (n + 1) / (N + V))`` with n its occurrences, N those of all kept terms there, V the kept terms; the
divergence of a term is ``floor((p - q)^2 / q)``. All arithmetic is in whole numbers.

Most divergent terms of a group: the value grows with the term's count in the group and falls with its count in the
language, and ties go by UTF-8. So a term that k others dominate (count in the group as high or higher, in the language as
low or lower, earlier in UTF-8) is not among the first k. Each partition keeps its terms dominated by fewer than k others
(a k-skyband); skybands are merged by group in two steps, each kept a skyband, and only what is left is ranked.

Divergence between sources: kept terms are dealt into blocks by hash, sources of a language into tiles of about
``TILE``. A task holds the dense counts of one block for two tiles, adds up all pairs of their sources and returns one
partial sum for each pair; terms that occur in neither tile are one product. So neither the terms of a language nor the
sources of a term are ever in one task, and pairs of sources are only made as rows of the result.

Nulls, ties and odd input: null text, language and source are read as empty strings, which are groups like others; texts
without terms still make their group. Each row is a document, repeated rows and repeated or null ids included. A language
without kept terms has values of 0 between sources and no terms. An empty table gives no rows. Other columns are ignored.
Counts must stay below 2^62 / 1000 and 10^9 + V below 2^31.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import written
from .textscan import scan

#: Bytes of a term in lower case: [^\x00-\x40\x5B-\x60\x7B-\x7F]+
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE = 1_000_000_000
#: Sources of a tile, about; a task holds counts of two tiles.
TILE = 128
#: Counts of a task's dense matrix, about.
MATRIX = 1 << 21
#: Text bytes counted together before rows leave Python.
SLICE = 4 << 20
#: Rows a partition holds before it thins them to their skybands.
HELD = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per group and term of each slice of texts, and one row without a term for each group."""
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        pair = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
        groups, group = np.unique(pair, return_inverse=True)
        names = [lang.dictionary.take(pa.array(groups // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(groups % max(1, len(source.dictionary))))]
        zero = pa.array(np.zeros(len(groups), np.int64))
        yield pa.RecordBatch.from_arrays([*names, pa.nulls(len(groups), pa.string()), zero, zero], ["lang", "source", "term", "n", "docs"])
        for s in scan(batch.column("text"), LETTER, SLICE):
            if not len(s.starts):
                continue
            at = np.zeros(len(s.starts) + 1, np.int64)
            np.cumsum(s.ends - s.starts, out=at[1:])
            words = pa.LargeStringArray.from_buffers(len(s.starts), pa.py_buffer(at), pa.py_buffer(s.data[LETTER[s.data]])).dictionary_encode()
            size, text = len(words.dictionary), np.repeat(np.arange(s.texts), np.diff(s.word_at))
            key, n = np.unique(text * size + np.asarray(words.indices), return_counts=True)
            key, inverse, docs = np.unique(group[s.first + key // size] * size + key % size, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, n, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [names[0].take(pa.array(key // size)), names[1].take(pa.array(key // size)), words.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(total), pa.array(docs.astype(np.int64))],
                ["lang", "source", "term", "n", "docs"],
            )


def dominated_by_fewer(count: np.ndarray, base: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which items are dominated by fewer than k others: higher or equal count, lower or equal base, lower place."""
    order = np.lexsort((place, base, -count))
    c, b, p = count[order], base[order], place[order]
    # Of equal counts and bases all but the first k places are dominated by these.
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])]) if len(c) else np.empty(0, np.int64)
    nth = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
    at = np.flatnonzero(nth < k)
    b, p = b[at], p[at]
    # Whoever dominates comes before in this order; among these those kept so far are enough, as domination is transitive.
    keep_b, keep_p, kept, step = np.empty(0, b.dtype), np.empty(0, p.dtype), [], 512
    for lo in range(0, len(at), step):
        bs, ps = b[lo : lo + step], p[lo : lo + step]
        by = ((keep_b[:, None] <= bs) & (keep_p[:, None] < ps)).sum(axis=0)
        by += np.triu((bs[:, None] <= bs) & (ps[:, None] < ps), 1).sum(axis=0)
        ok = by < k
        keep_b, keep_p = np.concatenate([keep_b, bs[ok]]), np.concatenate([keep_p, ps[ok]])
        kept.append(at[lo : lo + step][ok])
    out = np.zeros(len(order), dtype=bool)
    if kept:
        out[order[np.concatenate(kept)]] = True
    return out


def _thinned(table: pa.Table, k: int) -> pa.Table:
    """The skyband of each group in the table."""
    table = table.combine_chunks()
    keep = np.zeros(len(table), dtype=bool)
    code = pd.MultiIndex.from_arrays([table.column("lang").to_pandas(), table.column("source").to_pandas()]).factorize()[0]
    place = np.empty(len(table), np.int64)
    place[np.asarray(pc.sort_indices(table.column("term").cast(pa.binary())))] = np.arange(len(table))
    count, base = table.column("n").to_numpy(), table.column("n_lang").to_numpy()
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        keep[rows] = True if len(rows) <= k else dominated_by_fewer(count[rows], base[rows], place[rows], k)
    return table.filter(pa.array(keep))


def skybands(terms: DataFrame, k: int) -> DataFrame:
    """Rows ``(lang, source, term, n, n_lang, ...)`` of each partition that fewer than k of the same group and partition dominate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, HELD
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > most:
                table = _thinned(pa.Table.from_batches(held), k)
                held, size = table.to_batches(), len(table)
                most = max(HELD, 2 * size)
        if held:
            yield from _thinned(pa.Table.from_batches(held), k).to_batches(max_chunksize=10_000)

    return terms.mapInArrow(run, terms.schema)


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exact for any counts."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * cast({n} + 1 AS decimal(19,0))) div cast({total} + {kept} AS decimal(19,0))")


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same by long division, three digits at a time, as 64-bit products of large counts would overflow."""
    out, rest = np.divmod(n + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the block's terms for each ordered pair of sources of the unit's two tiles."""
    names, schema = right.column("source").to_pylist(), pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("seen", pa.int64())])
    if not len(left) or not len(right):
        return schema.empty_table()
    index = {s: i for i, s in enumerate(names)}
    terms = left.column("term").combine_chunks().dictionary_encode()
    sources = left.column("source").combine_chunks().dictionary_encode()
    row = np.array([index[s] for s in sources.dictionary.to_pylist()])[np.asarray(sources.indices)]
    counts = np.zeros((len(names), len(terms.dictionary)), np.int64)
    counts[row, np.asarray(terms.indices)] = left.column("n").to_numpy()
    p = _shares(counts, (right.column("total").to_numpy() + right.column("kept").to_numpy())[:, None]).astype(np.uint64)
    # A pair of tiles holds the pairs across them, a tile with itself all its pairs.
    tile, same = right.column("tile").to_numpy(), right.column("a")[0].as_py() == right.column("b")[0].as_py()
    a, b, value = [], [], []
    for i in range(len(names)):
        others = np.flatnonzero(tile != tile[i]) if not same else np.delete(np.arange(len(names)), i)
        if not len(others):
            continue
        total = np.zeros(len(others), np.uint64)
        for lo in range(0, p.shape[1], 1 << 13):
            q, own = p[others, lo : lo + (1 << 13)], p[i, lo : lo + (1 << 13)]
            apart = np.where(own > q, own - q, q - own)
            total += (apart * apart // q).sum(axis=1, dtype=np.uint64)
        a.append(np.full(len(others), i))
        b.append(others)
        value.append(total.astype(np.int64))
    if not a:
        return schema.empty_table()
    a, b = np.concatenate(a), np.concatenate(b)
    column = pa.array(names, pa.string())
    lang = pa.array([right.column("lang")[0].as_py()] * len(a), pa.string())
    seen = pa.array(np.full(len(a), counts.shape[1], np.int64))
    return pa.Table.from_arrays([lang, column.take(pa.array(a)), column.take(pa.array(b)), pa.array(np.concatenate(value)), seen], schema=schema)


def source_divergence(docs: DataFrame, least_docs: int = 3, ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part `pair` has the other sources of the language, part `term` the first ``ranks`` terms."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    cells = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    groups, cells = cells.filter("term IS NULL").select("lang", "source"), cells.filter("term IS NOT NULL")
    per = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "n_lang")
    placed = written(cells.select("lang", "source", "term", "n").join(per, ["lang", "term"]), "divergence-kept")

    # Sums of a language's counts come from its groups; kept terms are counted by the rows of one of their sources.
    kept = placed.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("kept"))
    totals = placed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    tiles = stats.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    stats = stats.join(tiles, "lang").withColumn("tiles", F.expr(f"cast(ceil(sources / {TILE}) AS int)"))
    stats = stats.withColumn("blocks", F.expr(f"cast(greatest(1, ceil(kept * least(sources, {2 * TILE}) / {MATRIX})) AS int)")).withColumn("tile", F.expr("cast(pmod(xxhash64(source), tiles) AS int)"))
    stats = written(stats, "divergence-groups")

    # The first terms of each group.
    known = placed.join(stats.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    known = known.withColumn("p", share("n", "total", "kept")).withColumn("q", share("n_lang", "lang_total", "kept")).filter("p > q")
    known = skybands(known.select("lang", "source", "term", "n", "n_lang", F.expr("(p - q) * (p - q) div q").alias("value")), ranks)
    known = skybands(known.repartition("lang", "source", F.expr("pmod(xxhash64(term), 16)")), ranks)
    known = skybands(known.repartition("lang", "source"), ranks)
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = known.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # Partial sums of each pair of sources over blocks of terms.
    unit = ["lang", "block", "a", "b"]
    place = F.expr("explode(transform(sequence(0, tiles - 1), t -> struct(least(t, tile) AS a, greatest(t, tile) AS b)))").alias("unit")
    of = stats.select("lang", "source", "tile", "tiles", "blocks")
    dealt = placed.join(of, ["lang", "source"]).select("lang", "source", "term", "n", F.expr("cast(pmod(xxhash64(term), blocks) AS int)").alias("block"), place)
    dealt = dealt.select("lang", "block", "unit.a", "unit.b", "source", "term", "n")
    sides = stats.select("lang", "source", "total", "kept", "tile", F.expr("explode(sequence(0, blocks - 1))").alias("block"), "tiles").select("lang", "block", place, "source", "total", "kept", "tile")
    sides = sides.select("lang", "block", "unit.a", "unit.b", "source", "total", "kept", "tile")
    sums = dealt.groupBy(*unit).cogroup(sides.groupBy(*unit)).applyInArrow(_pair_sums, "lang string, source string, item string, value bigint, seen bigint")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = stats.select("lang", "source", "total", "kept")
    other = stats.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = one.join(other, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    zero = F.lit(0).cast("bigint")
    pairs = pairs.withColumn("p", F.when(F.col("kept") > 0, share("0", "total", "kept")).otherwise(1)).withColumn("q", F.when(F.col("kept") > 0, share("0", "item_total", "kept")).otherwise(1))
    pairs = pairs.withColumn("value", F.coalesce("value", zero) + (F.col("kept") - F.coalesce("seen", zero)) * F.expr("(p - q) * (p - q) div q"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT lang, source, doc, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v))::BIGINT AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
