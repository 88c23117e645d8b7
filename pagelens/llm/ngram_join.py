"""Jaccard self-join of shingle sets by prefixes with token combinations.

Sets are ordered by shingle hash. If the sets x and y reach the threshold, x holds at most e(x) = |x| - ceil(t |x|) shingles
that y lacks, so the j-th shingle they share stands among the first e + j of both. Each document keeps its first
``e + e / 2 + 4`` shingles (the extended prefix); linked sets share at least ``min(e) / 2 + 4`` of them.

Shingles are classed by how many sets hold them in the extended prefix:

* rare: among the first e + 1 rare shingles of a set, each is an index key of its own. If any shared shingle of the
  extended prefixes is rare, the first such one is a key of both sets;
* frequent: otherwise all shared ones are frequent. Sets are banded by powers of two of their sizes, and a pair meets in
  the band L of its smaller set, in which linked sets share at least S = S(L) shingles among the first e + S of both.
  Frequent shingles are dealt by hash into S - 1 classes, so some class holds two shared ones: all combinations of two
  frequent shingles of one class are keys, which are some 2.5 e for a set, and only sets with S frequent shingles have
  them. A set has keys of its own band, and of the band below if a partner can be that small.

Equal sets are one class from the start (equal size and 128-bit digest) and are never paired. A key's sets first meet the
one among them that shares most shingles with others (a star); of its centres each set is compared with the nearest.
Then only sets of a key that are not connected yet are paired, so groups of near copies are not expanded into all their
pairs. Each set has a bitmap of 1024 bits, the parities of its shingles' slots: bits that differ are at most as many as
the shingles that differ, so pairs with too many are no links. Keys are looked at by connected parts, each one row with the
bitmap of one of its sets and the largest distance of the others to it: by the triangle inequality that rules out most
pairs of parts. Only the sets of the parts left meet, with the test of bitmaps in the join's condition, so that other
pairs never leave it; the rest is compared as whole sets, which are read again from the texts. No link between different
parts is lost.

Nulls and ties: null or wordless text has an empty set and links with nothing; fewer words than the shingle length are one
shingle. Rows with one id are one document; rows with a null id take part with the class of their set, and have a null
component where all ids of it are null. Equal rows come back as often as they came. Other columns are ignored.
Shingles are 64-bit hashes: two shingles of one pair of sets collide with a chance below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .storage import Scratch
from .textscan import NOT_SPACE, mix, scan

#: A shingle in more extended prefixes than this is frequent.
FREQUENT = 16
#: 64-bit words of a set's bitmap of parities.
WORDS = 16
#: Sets compared with one held set in one task, about.
FAN = 512
#: Bits of the bitmap of ids whose whole sets are fetched; a crowded bitmap only lets more rows pass to the exact join.
BITMAP_BITS = 25


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per text the sorted, distinct shingle hashes."""
    for s in scan(column, NOT_SPACE):
        words = s.hashes()
        grams, at = s.grams(words, width)
        grams = grams.view(np.int64)
        border = np.searchsorted(at, s.word_at)
        out = []
        for t in range(s.texts):
            lo, hi = border[t], border[t + 1]
            if hi > lo:
                out.append(np.unique(grams[lo:hi]))
            else:
                own = words[s.word_at[t] : s.word_at[t + 1]]
                value = np.uint64(len(own))
                with np.errstate(over="ignore"):
                    for w in own:
                        value = value * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(np.array([value], np.uint64).view(np.int64) if len(own) else np.empty(0, np.int64))
        yield s.first, out


def _digest(x: np.ndarray) -> tuple[int, int]:
    u = x.view(np.uint64)
    one = np.add.reduce((u ^ (u >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)
    two = np.add.reduce((u ^ (u >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F) ^ np.uint64(0xE7037ED1A0B428DB), dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _parities(x: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each slot, as 64-bit words."""
    return np.packbits((np.bincount((x & (64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column("text"), width):
                n = np.array([len(x) for x in sets], np.int64)
                digests = [_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(first, len(sets)), pa.array(n), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), _lists([_parities(x) for x in sets])],
                    ["doc", "n", "d1", "d2", "bits"],
                )

    return run


def _chosen(batches: Iterator[pa.RecordBatch], width: int, bitmap: np.ndarray) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and sets of the documents whose ids the bitmap may hold."""
    for batch in batches:
        slot = np.asarray(batch.column("slot")).astype(np.int64)
        part = pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text")], ["doc", "text"]).filter(pa.array(((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) > 0))
        for first, sets in _sets(part.column("text"), width):
            yield part.column("doc").slice(first, len(sets)), sets


def _slack(n, num: int, den: int):
    """How many shingles of a set of n a linked set can lack."""
    return n - (n * num + den - 1) // den


def _prefix(x: np.ndarray, num: int, den: int) -> np.ndarray:
    slack = _slack(len(x), num, den)
    return x[: slack + slack // 2 + 4]


def _prefixes(width: int, num: int, den: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sets in _chosen(batches, width, bitmap):
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) for x in sets], pa.int32()), _lists([_prefix(x, num, den) for x in sets])], ["rep", "n", "low"])

    return run


def band_shared(band: int, num: int, den: int) -> int:
    """Least number of shingles that linked sets share in their extended prefixes where the smaller has 2^band or more."""
    n = 1 << band
    return min(_slack(n, num, den) // 2 + 4, (n * num + den - 1) // den)


def index_keys(n: int, pos: np.ndarray, token: np.ndarray, hot: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of a set of n shingles from the shared ones of its extended prefix, in order."""
    e = _slack(n, num, den)
    keys = [token[~hot & (pos + 1 - np.cumsum(hot) <= e + 1)]]
    own = n.bit_length() - 1
    for band in [own, own - 1] if own and (n * num + den - 1) // den < 1 << own else [own]:
        least = band_shared(band, num, den)
        frequent = token[hot & (pos < e + least)]
        if least < 2 or len(frequent) < least:
            continue
        kind = mix(frequent.view(np.uint64) + np.uint64(band)) % np.uint64(least - 1)
        order = np.lexsort((frequent, kind))
        kind, frequent = kind[order], frequent[order].view(np.uint64)
        for step in range(1, int(np.bincount(kind.astype(np.int64)).max())):
            first = np.flatnonzero(kind[step:] == kind[:-step])
            keys.append(mix(mix(frequent[first]) + frequent[first + step] * np.uint64(3) + np.uint64(band)).view(np.int64))
    return np.concatenate(keys)


def _keyed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = np.asarray(batch.column("items").offsets).astype(np.int64), batch.column("items").values
            pos, token, hot = (items.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "token", "hot"))
            n, keys = np.asarray(batch.column("n")), []
            for i in range(len(batch)):
                own = slice(at[i], at[i + 1])
                keys.append(index_keys(int(n[i]), pos[own], token[own], hot[own], num, den))
            rows = pa.array(np.repeat(np.arange(len(batch)), [len(k) for k in keys]))
            shared = pa.array(np.diff(at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64()), batch.column("rep").take(rows), batch.column("n").take(rows), shared.take(rows)], ["key", "rep", "n", "w"])

    return run


def _whole(width: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sets in _chosen(batches, width, bitmap):
            yield pa.RecordBatch.from_arrays([doc, _lists(sets)], ["doc", "shingles"])

    return run


def _compared(num: int, den: int):
    """Each held set, and then the sets to compare with it, which pass by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, {}
        for batch in batches:
            at, values = np.asarray(batch.column("shingles").offsets).astype(np.int64), np.asarray(batch.column("shingles").values)
            x, y = [], []
            for i, (centre, salt, passes, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("centre", "salt", "passes", "doc")))):
                own = values[at[i] : at[i + 1]]
                if (centre, salt) != place:
                    place, held = (centre, salt), {}
                if not passes:
                    held[_digest(own)] = own.copy()
                elif any(den * (same := _common(own, h)) >= num * (len(own) + len(h) - same) for h in held.values()):
                    x.append(centre)
                    y.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of ids, brought to the driver in pieces of 8 KiB."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.asarray(batch.column(0)).astype(np.int64)
            for c in np.unique(slots >> 16).tolist():
                have.setdefault(c, np.zeros(1 << 16, dtype=bool))[slots[slots >> 16 == c] & 0xFFFF] = True
        for c, bits in have.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    slots = ids.select(id_slot("doc").alias("slot")).distinct()
    for r in slots.repartition(F.expr("slot div 65536")).mapInArrow(pieces, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * 8192 : (r.chunk + 1) * 8192] |= np.frombuffer(r.bits, np.uint8)
    return out


def id_slot(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS)).cast("int")


def _verified(scratch: Scratch, name: str, near: DataFrame, source: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose whole sets reach the threshold; sets are read again, for the documents in these pairs only.

    Sets travel once for each pair, to the set x that a task holds; a set x with many partners is held by several tasks.
    """
    degree = near.groupBy("x").agg(F.expr(f"cast(ceil(count(*) / {FAN}) AS int)").alias("salts"))
    placed = near.join(degree, "x").select("x", "y", F.pmod(F.xxhash64("y"), "salts").cast("int").alias("salt"))
    asked = placed.selectExpr("y AS doc", "x AS centre", "salt", "true AS passes").unionByName(placed.selectExpr("x AS doc", "x AS centre", "salt", "false AS passes").distinct())
    asked = scratch.written(asked, f"{name}-asked")
    bitmap = id_bitmap(asked.select("doc"))
    sets = source.withColumn("slot", id_slot("doc")).mapInArrow(_whole(width, bitmap), "doc bigint, shingles array<bigint>")
    placed = sets.join(asked, "doc").repartition("centre", "salt").sortWithinPartitions("centre", "salt", "passes")
    links = scratch.written(placed.mapInArrow(_compared(num, den), "x bigint, y bigint").distinct(), f"{name}-links")
    scratch.drop(f"{name}-asked")
    return links


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (8, 10), doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per document ``(doc_id, n_shingles, component_id)``; the threshold is a fraction, compared in whole numbers.

    Ids must be whole numbers or text that reads as such. Several jobs run while the result is built; tables that they
    share are written and deleted again, the last ones stay in the checkpoint folder.
    """
    num, den = threshold
    if 2 * num <= den:
        raise ValueError("the threshold must be over one half")
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    every = scratch.written(source.mapInArrow(_digests(width), "doc bigint, n bigint, d1 bigint, d2 bigint, bits array<bigint>"), "every")
    reps = every.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"), F.any_value("bits").alias("bits")).filter("rep IS NOT NULL")
    reps = scratch.written(reps.select("n", "d1", "d2", "rep", *(F.col("bits")[i].alias(f"b{i}") for i in range(WORDS))), "reps")
    # A row that only shares the bitmap's slot with a class is one more, equal member of its own class.
    bitmap = id_bitmap(reps.select(F.col("rep").alias("doc")))
    prefixes = source.filter("doc IS NOT NULL").withColumn("slot", id_slot("doc")).mapInArrow(_prefixes(width, num, den, bitmap), "rep bigint, n int, low array<bigint>")
    prefixes = scratch.written(prefixes, "prefixes")
    tokens = prefixes.select("rep", "n", F.posexplode("low").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token", (F.col("df") > frequent).alias("hot"))
    items = tokens.join(shared, "token").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "hot"))).alias("items"))
    keys = scratch.written(items.mapInArrow(_keyed(num, den), "key bigint, rep bigint, n int, w int"), "keys")
    scratch.drop("prefixes")

    # Each set with the nearest centre of its keys.
    words = [f"b{i}" for i in range(WORDS)]
    apart = " + ".join(f"bit_count(a.b{i} ^ b.b{i})" for i in range(WORDS))
    need = f"((cast({num} AS bigint) * (a.n + b.n) + {num + den - 1}) div {num + den})"
    near = f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) AND {apart} <= a.n + b.n - 2 * {need}"
    centres = keys.groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("minus"))).alias("best"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    centres = centres.select("key", (-F.col("best.minus")).alias("centre"))
    several = scratch.written(keys.join(centres, "key").select("key", "rep", "n", "centre"), "several")
    scratch.drop("keys")
    star = several.filter("rep <> centre").select("rep", "centre").distinct()
    marked = reps.select("rep", F.col("n").cast("int").alias("n"), *words)
    star = star.join(marked.select(F.struct("n", *words).alias("a"), "rep"), "rep").join(marked.select(F.struct("n", *words).alias("b"), F.col("rep").alias("centre")), "centre")
    star = star.filter(near).groupBy(F.col("rep").alias("y")).agg(F.min(F.struct(F.expr(apart).alias("apart"), "centre")).alias("best")).select(F.col("best.centre").alias("x"), "y")
    star = scratch.written(star, "star")
    first = _verified(scratch, "first", star, source, width, num, den)
    roots = components(first, "x", "y")

    # Keys stay open while their sets are not connected. Their parts meet first, then the sets of parts that may be near.
    placed = marked.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = scratch.written(placed, "placed")
    labelled = several.select("key", "rep").join(placed.select("rep", "root").distinct(), "rep").select("key", "root")
    parts = scratch.written(labelled.distinct(), "parts")
    scratch.drop("several")
    open_keys = parts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    # Half-sized bitmaps, folded from the whole ones, travel with the keys.
    half = [f"b{i} ^ b{i + WORDS // 2} AS h{i}" for i in range(WORDS // 2)]
    folded = " + ".join(f"bit_count(a.h{i} ^ b.h{i})" for i in range(WORDS // 2))
    halves = placed.selectExpr("rep", "root", "n", f"struct({', '.join(half)}) AS a")
    middle = halves.filter("rep = root").groupBy("root").agg(F.any_value("a").alias("b"))
    reach = halves.join(middle, "root").groupBy("root").agg(
        F.max(F.expr(folded)).cast("int").alias("radius"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").cast("int").alias("members"), F.any_value("b").alias("b"),
    )
    rest = scratch.written(parts.join(open_keys, "key", "left_semi").join(reach.select("root", "radius", "least", "most", "members", "b.*"), "root"), "rest")
    sizes = f"{den} * a.most >= {num} * b.least AND {den} * b.most >= {num} * a.least"
    farthest = f"cast({den - num} AS bigint) * (a.most + b.most) div {num + den}"
    found = rest.alias("a").join(rest.alias("b"), F.expr(f"a.key = b.key AND a.root < b.root AND {sizes} AND {folded} - a.radius - b.radius <= {farthest}"))
    found = found.selectExpr("IF(a.members <= b.members, a.root, b.root) AS few", "IF(a.members <= b.members, b.root, a.root) AS many").distinct()
    left = found.join(placed.select(F.col("root").alias("few"), "rep", "n", *words), "few").drop("few")
    right = placed.select(F.col("root").alias("many"), "rep", "n", *words)
    pairs = left.alias("a").join(right.alias("b"), F.expr(f"a.many = b.many AND {near}")).selectExpr("least(a.rep, b.rep) AS x", "greatest(a.rep, b.rep) AS y")
    tried = star.selectExpr("least(x, y) AS x", "greatest(x, y) AS y")
    pairs = scratch.written(pairs.join(tried, ["x", "y"], "left_anti").distinct(), "pairs")
    scratch.drop("rest", "star", "parts", "placed")
    second = _verified(scratch, "second", pairs, source, width, num, den)
    # Classes that share an id are one document; so are all classes of its rows.
    final = components(first.unionByName(second), "x", "y")
    scratch.drop("pairs", "first-links", "second-links")
    found = reps.select("n", "d1", "d2", F.col("rep").alias("node")).join(final, "node", "left").select("n", "d1", "d2", F.coalesce("root", "node").alias("component"))
    return every.join(found, ["n", "d1", "d2"], "left").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (8, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; rows with a null id stay."""
    found = near_duplicates(docs, width, threshold, doc_id, text)
    go = found.filter(F.col("component_id") != F.col(doc_id)).select(F.col(doc_id).alias("__go")).distinct()
    return docs.join(go, docs[doc_id] == go["__go"], "left_anti")
