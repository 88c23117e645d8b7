"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. After a fixed random rotation, which spreads distance over all
coordinates, they are split into blocks of few dimensions, and each block gets the share of the squared distance that its
dimensions have. If two vectors are within the whole distance, at least one block is within its share. So each block is
range-joined under its budget: blocks are cut into grid cells as wide as the budget's radius along their first
coordinates, and only equal and neighbouring cells are compared. A pair within the budget of several blocks counts in the
first of them. Every such candidate is verified by its cosine in double precision on the vectors as given.

Cells are divided into chunks of bounded size by hashes of ids, and pairs of chunks are the unit of work, so a cell with
a third of all vectors becomes many small tasks. A task compares two chunks as matrices and returns, for each vector that
has links, the number of vectors linked and the smallest vector of its connected part in these two chunks. Pairs of vectors
are never written out. Components follow from these parts.

Equal vectors with one label are one class with a weight: they link with each other without being compared.

Components are scaled by the largest one where squares would leave the range of doubles. Ids must be whole numbers or text
that reads as such.

Nulls and ties: rows with a null label, vector or id, zero vectors, and vectors with null or non-finite components link
with nothing (no links, themselves as component, kept; a null id has a null component). Vectors of different lengths don't
link. Repeated rows of a vector count as vectors of their own; rows with one id are one node of the graph. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .storage import settled

BLOCK = 8
#: Coordinates of a block that make its grid.
GRID = 2
#: Vectors of a chunk, about.
CHUNK = 768
_SLACK = 1e-9


@lru_cache(maxsize=8)
def _rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _blocks(d: int) -> np.ndarray:
    """Borders of the blocks of d dimensions."""
    n = max(1, round(d / BLOCK))
    return np.linspace(0, d, n + 1).round().astype(int)


def _budgets(d: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(_blocks(d)) / d + _SLACK


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(axis=1))
    return x / norm[:, None], norm


def _cells(cosine: float):
    """Each vector once for each block: the grid cell of its block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            flat = np.asarray(batch.column("v").flatten(), dtype=np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                unit, _ = _unit(flat[at[rows][:, None] + np.arange(d)])
                turned, border = unit @ _rotation(d), _blocks(d)
                part = batch.take(pa.array(rows))
                for b, (lo, budget) in enumerate(zip(border[:-1], _budgets(d, cosine))):
                    grid = np.floor(turned[:, lo : min(lo + GRID, border[b + 1])] / np.sqrt(budget)).astype(np.int32)
                    cell = pa.ListArray.from_arrays(pa.array(np.arange(0, grid.size + 1, grid.shape[1], dtype=np.int32)), pa.array(grid.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), b, np.int32)), cell], [*part.schema.names, "d", "block", "cell"])

    return run


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of the connected part of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(a: np.ndarray, b: np.ndarray, same: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices that link and whose first block within its budget is this one."""
    d = a.shape[1]
    (ua, na), (ub, nb) = _unit(a), _unit(b)
    ra, rb, border, budget = ua @ _rotation(d), ub @ _rotation(d), _blocks(d), _budgets(d, cosine)
    xa, xb = ra[:, border[block] : border[block + 1]], rb[:, border[block] : border[block + 1]]
    near = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None] - 2 * xa @ xb.T <= budget[block]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    keep = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 1 << 15):
        p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        hit = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= cosine
        if block:
            t = np.flatnonzero(hit)
            parts = np.add.reduceat((ra[p[t]] - rb[q[t]]) ** 2, border[:-1], axis=1)
            hit[t] = (parts[:, :block] > budget[:block]).all(axis=1)
        keep[lo : lo + (1 << 15)] = hit
    return i[keep], j[keep]


def _compared(cosine: float):
    def unpack(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        items = column[row].values
        v = items.field("v")
        ids = items.field("id").to_numpy(zero_copy_only=False)
        return ids, items.field("w").to_numpy(zero_copy_only=False), np.asarray(v.flatten(), dtype=np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, block = batch.column("same")[row].as_py(), batch.column("block")[row].as_py()
                ids, w, a = unpack(batch.column("left"), row)
                if same:
                    other, wo, b = ids, w, a
                else:
                    other, wo, b = unpack(batch.column("right"), row)
                i, j = _linked(a, b, same, block, cosine)
                if not len(i):
                    continue
                j_at = j if same else j + len(ids)
                every, weight = (ids, w) if same else (np.concatenate([ids, other]), np.concatenate([w, wo]))
                order = np.argsort(every, kind="stable")  # so the smallest index of a part is its smallest id
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                part = every[order][_parts(len(every), rank[i], rank[j_at])[rank]]
                links = np.bincount(i, weight[j_at], len(every)) + np.bincount(j_at, weight[i], len(every))
                t = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(every[t]), pa.array(links[t].astype(np.int64)), pa.array(part[t])], ["id", "links", "part"])

    return run


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row ``(vec_id, n_links, component_id, kept)``."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    # Squares of very long or short vectors leave the range of doubles; their directions do not. Others stay as given.
    rows = rows.withColumn("v", F.expr("transform(array(array_max(transform(v, x -> abs(x)))), m -> IF(m > 1e-100D AND m < 1e100D OR NOT coalesce(m > 0 AND m < double('Infinity'), false), cast(v AS array<double>), transform(v, x -> try_divide(cast(x AS double), m))))[0]"))
    sound = F.expr("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    classes = settled(rows.filter(sound).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")))

    cells = classes.mapInArrow(_cells(cosine), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in classes.schema)}, d int, block int, cell array<int>")
    key = ["label", "d", "block", "cell"]
    counts = cells.groupBy(*key).agg(F.count("*").alias("n"))
    placed = cells.join(counts, key).withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int"))
    chunks = settled(placed.groupBy(*key, "chunk").agg(F.collect_list(F.struct("id", "w", "v")).alias("items")))

    # Of the neighbouring cells only those after a cell in order, so each pair of cells meets once.
    ahead = [o for o in product((-1, 0, 1), repeat=GRID) if o >= (0,) * GRID]
    offsets = F.array(*(F.array(*(F.lit(x) for x in o)) for o in ahead))
    shift = F.explode(offsets).alias("offset")
    left = chunks.select("label", "d", "block", F.col("cell").alias("home"), F.col("chunk").alias("c1"), F.col("items").alias("left"), shift)
    # A block of fewer coordinates than the grid has its offsets cut to its own, each once.
    left = left.filter("forall(slice(offset, size(home) + 1, greatest(size(offset) - size(home), 0)), x -> x = 0)").withColumn(
        "cell", F.expr("transform(home, (x, i) -> x + offset[i])")
    )
    right = chunks.select(*key, F.col("chunk").alias("c2"), F.col("items").alias("right"))
    pairs = left.join(right, key).filter("cell <> home OR c1 <= c2").withColumn("same", F.expr("cell = home AND c1 = c2"))
    # The equal chunk is not sent twice.
    work = pairs.select("block", "same", "left", F.expr("if(same, NULL, right)").alias("right"))
    found = settled(work.mapInArrow(_compared(cosine), "id bigint, links bigint, part bigint"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("id <> part").distinct(), "id", "part").withColumnRenamed("node", "id")
    told = classes.join(links, "id", "left").join(roots, "id", "left").select("label", "v", F.expr("w - 1 + coalesce(links, 0)").alias("links"), F.coalesce("root", "id").alias("root"))
    out = rows.join(told, (rows["label"] == told["label"]) & (rows["v"] == told["v"]), "left")
    component = F.coalesce(told["root"], rows["id"])
    return out.select(
        rows["id"].alias(vec_id), F.coalesce(told["links"], F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(rows["id"] == component, F.lit(True)).alias("kept")
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
