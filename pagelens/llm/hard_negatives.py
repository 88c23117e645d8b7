"""Hard negatives for contrastive training: rows of another label that score just below an anchor's positives.

Scores are inner products of whole numbers (each component x becomes floor(256 x)). An anchor's positives are its first
rows of the same label; for each of them the first rows of other labels are wanted whose score lies in a window set by the
positive's score. Both searches are threshold joins: all rows that reach an anchor's threshold are found exactly, and the
thresholds of anchors whose positives or windows are not full yet are lowered for the next round, down to the window's
lower end or, for positives, to none.

A threshold join works on one chunk of rows at a time. The chunk gets an inverted index over its dimensions in which each
row leaves out the last dimensions that cannot reach the threshold by themselves: the norm of its own suffix times the
longest suffix of the anchors is below it. Partial scores are accumulated along the postings, block by block; rows of
which no anchor's partial score plus the product of the remaining norms reaches its threshold go. What is left is scored
exactly in whole numbers. A row stands in the postings of a prefix of its dimensions, so with rows in the order of their
indexed lengths a posting list is a range and accumulating is a matrix product.

Rows are dealt into chunks of a label by hashes of ids, so a frequent label is many chunks. Each partition holds its
chunks one after another and streams the anchors past, and returns only the few best rows for each window and chunk.

Nulls, ties and odd input: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
part, nor do integer vectors with a norm of 2^31 or more, whose scores may not fit 64 bits. Of rows with one id the one
with the smallest (label, vector) stands for all, so repeated rows count once. Rows whose vectors have other lengths than
the anchor's are not compared. Ties go by id. Anchors without positives or with empty windows give no rows. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import settled

#: Rows of a chunk, about, and anchors compared with it at once.
CHUNK = 2048
ANCHORS = 256
#: Dimensions accumulated between two looks at the bounds.
STEP = 8
#: Shares of the largest possible score that positives have to reach, round by round; the last round has no threshold.
POSITIVE_ROUNDS = (0.8, 0.35)
#: How far down its window a threshold goes, round by round.
NEGATIVE_ROUNDS = (0.25, 0.6, 1.0)
_NONE = -(1 << 62)


def _tails(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Norms of what follows each border."""
    square = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([square, np.zeros((len(x), 1))], axis=1)[:, borders])


def reaching(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (anchor, row, score) whose score is at least the anchor's threshold."""
    d = rows.shape[1]
    q, x = anchors.astype(np.float64), rows.astype(np.float64)
    borders = np.r_[np.arange(0, d, STEP), d]
    q_tail, x_tail = _tails(q, borders), _tails(x, borders)
    # Half a point for whole scores, and the rounding of sums and norms.
    slack = 0.5 + 1e-9 * q_tail[:, :1] * x_tail[:, 0].max(initial=0)
    bound = least[:, None] - slack
    # A row's suffix that can't reach the smallest threshold with any anchor is not indexed.
    covered = q_tail.max(axis=0, initial=0)[None] * x_tail < bound.min(initial=np.inf)
    stop = np.where(covered.any(axis=1), covered.argmax(axis=1), len(borders) - 1)
    at = np.argsort(-stop, kind="stable")
    stop, x, x_tail = stop[at], x[at], x_tail[at]
    partial = np.zeros((len(q), len(at)))
    for b in range(len(borders) - 1):
        n = int(np.searchsorted(-stop, -b, "left"))  # rows with a posting here
        if not n:
            break
        partial[:, :n] += q[:, borders[b] : borders[b + 1]] @ x[:n, borders[b] : borders[b + 1]].T
        alive = np.ones(len(at), dtype=bool)
        alive[:n] = (partial[:, :n] + q_tail[:, b + 1 : b + 2] * x_tail[:n, b + 1] >= bound).any(axis=0)
        if alive.sum() < 0.8 * len(at):
            at, stop, x, x_tail, partial = at[alive], stop[alive], x[alive], x_tail[alive], partial[:, alive]
    i, j = np.nonzero(partial + q_tail[:, stop] * x_tail[np.arange(len(at)), stop][None] >= bound)
    j = at[j]
    score = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 15):
        score[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", anchors[i[lo : lo + (1 << 15)]], rows[j[lo : lo + (1 << 15)]])
    hit = score >= least[i]
    return i[hit], j[hit], score[hit]


def _first(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each window the k best entries, ties by id."""
    order = np.lexsort((ids, -score, window))
    w = window[order]
    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
    return order[np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)])) < k]


def _against(anchors: pa.RecordBatch, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of the chunk in each window of each anchor."""
    q = np.asarray(anchors.column("v").flatten()).reshape(len(anchors), -1)
    own, windows = np.asarray(anchors.column("id")), anchors.column("windows")
    at, items = np.asarray(windows.offsets).astype(np.int64) - windows.offsets[0].as_py(), windows.flatten()
    keys, least, most = (np.asarray(items.field(f)) for f in ("key", "least", "most"))
    per = np.diff(at)
    i, j, score = reaching(q, np.minimum.reduceat(least, at[:-1]), rows)
    other = ids[j] != own[i]
    i, j, score = i[other], j[other], score[other]
    # Every pair once for each window of its anchor.
    pair = np.repeat(np.arange(len(i)), per[i])
    window = np.repeat(at[i], per[i]) + np.arange(len(pair)) - np.repeat(np.cumsum(per[i]) - per[i], per[i])
    inside = (score[pair] >= least[window]) & (score[pair] <= most[window])
    pair, window = pair[inside], window[inside]
    best = _first(window, score[pair], ids[j[pair]], k)
    pair, window = pair[best], window[best]
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(own[i[pair]]), pa.array(keys[window]), pa.array(ids[j[pair]]), pa.array(score[pair])], ["anchor", "key", "row", "score"])


def _streamed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunk after chunk: first its rows, which are held, then anchors, which pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, matrix = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "d", "part", "is_anchor"))))
            border = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
            for lo, hi in zip(border[:-1], border[1:]):
                run_of, (*own, is_anchor) = batch.slice(lo, hi - lo), keys[lo]
                if own != chunk:
                    chunk, held, matrix = own, [], None
                if not is_anchor:
                    held.append(run_of)
                    continue
                if matrix is None:
                    d = own[1]
                    ids = np.concatenate([np.asarray(h.column("id")) for h in held]) if held else np.empty(0, np.int64)
                    matrix = ids, np.concatenate([np.asarray(h.column("v").flatten()).reshape(len(h), d) for h in held]) if held else np.empty((0, d), np.int64)
                    held = []
                if len(matrix[0]):
                    for at in range(0, len(run_of), ANCHORS):
                        yield from _against(run_of.slice(at, ANCHORS), *matrix, k)

    return run


def _round(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(anchor, key, row, score)``: the k best rows of every window, exactly; asked has anchors with the chunks to look at."""
    columns = ["label", "d", "part", "is_anchor", "id", "v", "windows"]
    window = "array<struct<key: bigint, least: bigint, most: bigint>>"
    left = rows.withColumn("is_anchor", F.lit(False)).withColumn("windows", F.lit(None).cast(window)).select(*columns)
    right = asked.withColumn("is_anchor", F.lit(True)).select(*columns)
    # Chunks that no anchor asks for are not sent.
    left = left.join(asked.select("label", "d", "part").distinct(), ["label", "d", "part"], "left_semi")
    both = left.unionByName(right).repartition("label", "d", "part").sortWithinPartitions("label", "d", "part", "is_anchor")
    found = both.mapInArrow(_streamed(k), "anchor bigint, key bigint, row bigint, score bigint")
    best = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "row")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)


def _windows(df: DataFrame) -> DataFrame:
    """One row per anchor with its windows."""
    return df.groupBy("anchor").agg(F.collect_list(F.struct("key", "least", "most")).alias("windows")).withColumnRenamed("anchor", "id")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Per anchor and positive the first negatives whose score is from ``low`` to ``high`` times the positive's.

    Columns: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``is_anchor`` is a condition on
    the columns ``id`` and ``label``. Rounds run as jobs while the result is built; each is checkpointed.
    """
    (low_n, low_d), (high_n, high_d) = low, high
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    # Components over 1e100 (NaN counts as larger than all) are too long anyway, and their squares would overflow.
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < 1e100)")
    rows = rows.filter(f"sqrt(aggregate(v, 0D, (s, x) -> s + ({scale}D * x) * ({scale}D * x))) + sqrt(size(v)) < 2147483648D")
    rows = rows.select("id", F.struct("label", F.expr(f"transform(v, x -> floor({scale}D * x))").alias("v")).alias("of")).groupBy("id").agg(F.min("of").alias("of")).select("id", "of.label", "of.v")
    rows = rows.withColumn("d", F.size("v"))
    norm = "sqrt(aggregate(v, 0D, (s, x) -> s + x * cast(x AS double)))"
    rows = settled(rows.withColumn("norm", F.expr(norm)))
    chunks = rows.groupBy("label", "d").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).withColumn("parts", F.expr(f"cast(ceil(n / {CHUNK}) AS int)"))
    chunks = settled(chunks)
    rows = settled(rows.join(chunks, ["label", "d"]).withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) AS int)")).select("label", "d", "part", "id", "v", "norm", "n", "longest", "parts"))
    anchors = settled(rows.filter(is_anchor).select("id", "label", "d", "v", "norm", "n", "longest", "parts"))

    # Positives: the same label's chunks.
    open_, found = anchors, []
    for share in (*POSITIVE_ROUNDS, None):
        least = F.lit(_NONE) if share is None else F.ceil(F.lit(share) * F.col("norm") * F.col("longest"))
        window = F.array(F.struct(F.lit(0).cast("bigint").alias("key"), least.cast("bigint").alias("least"), F.lit(-_NONE).cast("bigint").alias("most")))
        asked = open_.withColumn("windows", window).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        got = settled(_round(rows, asked, positives).select("anchor", "row", "score"))
        full = got.groupBy("anchor").agg(F.count("*").alias("have"))
        checked = open_.join(full, open_["id"] == full["anchor"], "left").withColumn("full", F.coalesce("have", F.lit(0)) >= F.least(F.lit(positives), F.col("n") - 1))
        if share is None:
            found.append(got)
            break
        found.append(got.join(checked.filter("full").select("anchor"), "anchor", "left_semi"))
        open_ = settled(checked.filter("NOT full").select(*anchors.columns))
        if open_.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = settled(pairs.select("anchor", F.col("row").alias("key"), F.col("score").alias("positive")))

    # Negatives: the other labels' chunks, from the top of each window downwards.
    window = pairs.select("anchor", "key", "positive", F.expr(f"cast(ceil({low_n} * cast(positive AS decimal(20,0)) / {low_d}) AS bigint)").alias("lo"), F.expr(f"cast(floor({high_n} * cast(positive AS decimal(20,0)) / {high_d}) AS bigint)").alias("most"))
    open_, done = settled(window.filter("lo <= most")), []
    spread = 16  # an anchor meets the chunks of all other labels; salted, as all vectors may have one length
    places = chunks.select(F.col("label").alias("to"), "d", F.expr("explode(transform(sequence(0, parts - 1), p -> struct(p AS part, pmod(hash(label, p), %d) AS salt)))" % spread).alias("x")).select("to", "d", "x.part", "x.salt")
    for share in NEGATIVE_ROUNDS:
        lowered = open_.withColumn("least", F.when(F.lit(share >= 1), F.col("lo")).otherwise(F.greatest("lo", F.col("most") - F.floor(F.lit(share) * (F.col("most") - F.col("lo"))))))
        asked = anchors.select("id", "v", "label", "d").join(_windows(lowered), "id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        asked = asked.join(places, ["d", "salt"]).filter("label <> to").select(F.col("to").alias("label"), "d", "part", "id", "v", "windows")
        got = settled(_round(rows, asked, negatives))
        full = got.groupBy("anchor", "key").agg(F.count("*").alias("have"))
        checked = lowered.join(full, ["anchor", "key"], "left").withColumn("full", (F.coalesce("have", F.lit(0)) >= negatives) | (F.col("least") <= F.col("lo")))
        done.append(got.join(checked.filter("full").select("anchor", "key", "positive"), ["anchor", "key"]))
        open_ = settled(checked.filter("NOT full").select(*open_.columns))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("row").alias("negative_id"),
        F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
