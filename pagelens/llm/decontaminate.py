"""Benchmark decontamination by winnowing.

Words of texts become k-gram hashes; of each ``window - k + 1`` successive k-grams the smallest is kept as a fingerprint.
Two texts that share ``window`` successive words share a window of k-grams, hence its smallest one at the same place, so
joining fingerprints misses no shared window. A joined pair is extended word by word to both sides, over at most
``window - k`` words, and counts when the common run holds a whole window. Words themselves are compared, not hashes.

An item of fewer words than ``window`` is one window: its length L is looked up as L-grams, all of which are kept.

A bitmap of fixed size with the benchmark's fingerprints goes to all tasks, so documents emit a fingerprint only if the
benchmark may hold it; a crowded bitmap lets more rows pass to the join and changes no result.

Nulls and ties: null text has no words and is not contaminated; rows with a null id are judged like others; equal rows
come back as often as they came. Empty items have no window. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textscan import ALNUM, Scan, scan, sliding_min

K = 6
#: Bits of the bitmap: 4 MiB on each executor, whatever the size of the benchmark.
BITMAP_BITS = 25
_CHUNK = 1 << 16

_HIT = "struct<fp:bigint,len:int,pos:int,left:array<string>,mid:array<string>,right:array<string>>"
_ARROW_HIT = pa.list_(
    pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("pos", pa.int32()), ("left", pa.list_(pa.string())), ("mid", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
)


def selected(words: np.ndarray, s: Scan, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts of a scan: k-gram hashes that are smallest in a window of k-grams, and their places."""
    grams, at = s.grams(words, k)
    w = window - k + 1
    if w <= 1 or not len(at):
        return grams, at
    whole = np.searchsorted(at, s.gram_starts(window))  # each gram that begins a window of words begins a window of w grams
    if not len(whole):
        return grams[:0], at[:0]
    least = sliding_min(grams, w)[whole]
    keep = np.zeros(len(grams), dtype=bool)
    for j in range(w):
        keep[whole[grams[whole + j] == least] + j] = True
    return grams[keep], at[keep]


def _around(s: Scan, text: int, at: int, k: int, window: int) -> tuple[list[str], list[str], list[str]]:
    lo, hi = int(s.word_at[text]), int(s.word_at[text + 1])
    reach = max(0, window - k)
    left = [s.word(i) for i in range(at - 1, max(lo, at - reach) - 1, -1)]
    return left, [s.word(i) for i in range(at, at + k)], [s.word(i) for i in range(at + k, min(hi, at + k + reach))]


def _hits(s: Scan, words: np.ndarray, lengths: list[int], window: int, k: int, bitmap: np.ndarray | None) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(s.texts)]
    for n in lengths:
        own = k if n >= window else n
        found, at = selected(words, s, own, window if n >= window else n)
        if bitmap is not None and len(found):
            slot = found & np.uint64((1 << BITMAP_BITS) - 1)
            ok = (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            found, at = found[ok > 0], at[ok > 0]
        text = np.searchsorted(s.word_at, at, "right") - 1
        for f, a, t in zip(found.view(np.int64).tolist(), at.tolist(), text.tolist()):
            left, mid, right = _around(s, t, a, own, n)
            out[t].append({"fp": f, "len": n, "pos": a - int(s.word_at[t]), "left": left, "mid": mid, "right": right})
    return out


def _fingerprints(window: int, k: int, lengths: list[int], bitmap: np.ndarray | None):
    """Per text its key columns, number of words, and fingerprints with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.drop_columns(["text"])
            for s in scan(batch.column("text"), ALNUM):
                words, n = s.hashes(), np.diff(s.word_at)
                if bitmap is None:  # items: each by its own length
                    hits: list[list[dict]] = [[] for _ in range(s.texts)]
                    for own in np.unique(np.minimum(n[n > 0], window)).tolist():
                        mine = _hits(s, words, [own], window, k, None)
                        for t in np.flatnonzero(np.minimum(n, window) == own).tolist():
                            hits[t] = mine[t]
                else:
                    hits = _hits(s, words, lengths, window, k, bitmap)
                part = keys.slice(s.first, s.texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(n, pa.int64()), pa.array(hits, _ARROW_HIT)], [*part.schema.names, "n_words", "hits"]
                )

    return run


def _chunks(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's slots as 8 KiB pieces of the bitmap; pieces of all tasks are combined below."""
    have: dict[int, np.ndarray] = {}
    for batch in pairs:
        slots = np.asarray(batch.column(0)).astype(np.int64)
        for c in np.unique(slots // _CHUNK).tolist():
            bits = have.setdefault(c, np.zeros(_CHUNK, dtype=bool))
            bits[slots[slots // _CHUNK == c] % _CHUNK] = True
    for c, bits in have.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _bitmap(marks: DataFrame) -> np.ndarray:
    """At most 2^BITMAP_BITS bits, brought to the driver in pieces of one slot range each."""
    slots = marks.select(F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("slot")).distinct()
    pieces = slots.repartition(F.expr(f"slot div {_CHUNK}")).mapInArrow(_chunks, "chunk int, bits binary")
    out = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r.chunk * _CHUNK // 8 : (r.chunk + 1) * _CHUNK // 8] |= np.frombuffer(r.bits, np.uint8)
    return out


def _common(a: str, b: str) -> Column:
    """Length of the longest common beginning of two arrays of words."""
    same = F.zip_with(F.col(a), F.col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def covered(spans: Column) -> Column:
    """Number of places in the union of half-open ranges [a, b)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["to"]))).cast("bigint").alias("n"), F.greatest(acc["to"], x["b"]).alias("to")
        ),
    )["n"]


def _judged(docs: DataFrame, benchmark: DataFrame, doc_id: str, item_id: str, text: str, window: int, k: int) -> DataFrame:
    """Per id and text ``(doc, body, n_words, n_hit, items, copies)``; ``body`` is the hash of the text."""
    lookup = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    marks = (
        lookup.mapInArrow(_fingerprints(window, k, [], None), f"item {lookup.schema['item'].dataType.simpleString()}, n_words bigint, hits array<{_HIT}>")
        .select("item", F.explode("hits").alias("h")).select("item", "h.*").drop("pos")
    )
    lengths = sorted(r[0] for r in marks.select("len").distinct().collect())  # at most ``window`` numbers
    bitmap = _bitmap(marks)

    source = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    scanned = source.mapInArrow(
        _fingerprints(window, k, lengths, bitmap), f"doc {source.schema['doc'].dataType.simpleString()}, body bigint, n_words bigint, hits array<{_HIT}>"
    )
    # One row per hit, and one of length 0, which meets nothing and stands for the document itself.
    mark = F.struct(
        F.xxhash64("doc", "body").alias("fp"), F.lit(0).alias("len"), F.lit(-1).alias("pos"),
        *(F.array().cast("array<string>").alias(c) for c in ("left", "mid", "right")),
    )
    rows = scanned.select("doc", "body", "n_words", F.explode(F.concat("hits", F.array(mark))).alias("h")).select("doc", "body", "n_words", "h.*")
    known = marks.select("fp", "len", F.col("left").alias("ml"), F.col("mid").alias("mm"), F.col("right").alias("mr"), "item")
    met = rows.join(known, ["fp", "len"], "left")
    low, high = F.col("pos") - _common("left", "ml"), F.col("pos") + F.size("mid") + _common("right", "mr")
    held = F.col("mm").isNotNull() & (F.col("mid") == F.col("mm")) & (high - low >= F.col("len"))
    per = met.select(
        "doc", "body", "n_words", F.col("len"), F.when(held, F.struct(low.alias("a"), high.alias("b"))).alias("span"), F.when(held, F.col("item")).alias("item")
    )
    grouped = per.groupBy("doc", "body", "n_words").agg(
        F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"), F.count(F.when(F.col("len") == 0, F.lit(1))).alias("copies")
    )
    return grouped.select("doc", "body", "n_words", covered(F.col("spans")).alias("n_hit"), "items", "copies")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 13, k: int = K) -> DataFrame:
    """Per document ``(doc_id, n_words, n_hit, items)``: words, words inside a shared window, ids of items with such windows."""
    found = _judged(docs, benchmark, doc_id, item_id, text, window, k)
    return found.select(F.col("doc").alias(doc_id), "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 13, k: int = K) -> DataFrame:
    """Documents without those of which at least one word in ``share`` is inside a shared window. Each row goes by its own
    text alone, whatever other rows have its id or a null id too."""
    found = _judged(docs, benchmark, doc_id, item_id, text, window, k)
    bad = found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc").alias("__bad"), F.col("body").alias("__body"))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__bad"]) & (F.xxhash64(docs[text]) == bad["__body"]), "left_anti")
