"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, their stems (the first STEM bytes), pairs of neighbours and pairs with one
word between, hashed into ``2^bits`` coordinates. Training is the follow-the-regularized-leader update with per-coordinate learning rates and L1 and L2 terms
in numpy; L1 leaves few weights that are not zero, and only these are kept. They are at most ``2^bits`` and are broadcast.

The classifier is fitted on a bounded sample, as documented by ``max_rows``: the labelled rows with the smallest hashes of
their ids, at most that many. Their features are made in parallel; one task runs the sequential updates over them. Every
text is then scored whole, and only the weights that its own features meet are looked at.

Nulls and ties: null and empty text has no features, so its score is that of the intercept; null labels and labels
without a document teach nothing; of several labels of one id the largest counts, of several texts
of one id the smallest; without any label of either kind
scores are 1/2. Rows come back as often as they came. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import settled
from .textscan import ALNUM, Scan, scan

#: Bytes of a word that count as its stem.
STEM = 4


def features(s: Scan, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of a scan, with the text of each; coordinate 0 is the intercept's."""
    words = s.hashes()
    own = np.repeat(np.arange(s.texts), np.diff(s.word_at))
    parts, texts = [words, s.hashes(STEM) ^ np.uint64(0x2545F4914F6CDD1D)], [own, own]
    pairs, at = s.grams(words, 2)
    parts.append(pairs)
    texts.append(np.searchsorted(s.word_at, at, "right") - 1)
    at = s.gram_starts(3)
    if len(at):
        parts.append((words[at] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15) + words[at + 2])
        texts.append(np.searchsorted(s.word_at, at, "right") - 1)
    index = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.maximum(index, 1), np.concatenate(texts)


def _featurize(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in scan(batch.column("text"), ALNUM):
                index, text = features(s, bits)
                key = np.unique((text.astype(np.int64) << bits) | index)
                at = np.searchsorted(key >> bits, np.arange(s.texts + 1)).astype(np.int32)
                values = pa.array((key & ((1 << bits) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("place").slice(s.first, s.texts), batch.column("label").slice(s.first, s.texts), pa.ListArray.from_arrays(pa.array(at), values)], ["place", "label", "features"]
                )

    return run


class Ftrl:
    """Weights follow from the sums z and n of each coordinate; a coordinate whose |z| stays within l1 has weight 0."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, label: float) -> None:
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.append(0, f).astype(np.int64), float(y)) for b in batches for f, y in zip(b["features"], b["label"])]
        model = Ftrl(bits)
        if len({y for _, y in rows}) == 2:
            share = sum(y for _, y in rows) / len(rows)
            model.z[0] = -np.log(share / (1 - share)) * (model.beta / model.alpha + model.l2)  # the intercept starts at the share of label 1
            for _ in range(epochs):
                for f, y in rows:
                    model.learn(f, y)
            w = model.weights(np.arange(1 << bits))
            i = np.flatnonzero(w)
            yield pd.DataFrame({"i": i.astype("int32"), "w": w[i]})

    return run


def weights(labelled: DataFrame, bits: int = 20, epochs: int = 4) -> np.ndarray:
    """Dense weights from ``(key, text, label)``; the sample is chosen before any text is read beyond it."""
    order = F.xxhash64("key", F.lit("toxicity"))
    chosen = labelled.withColumn("place", order).select("place", "label", "text")
    made = chosen.mapInArrow(_featurize(bits), "place bigint, label int, features array<int>")
    fitted = made.repartition(1).sortWithinPartitions("place").mapInPandas(_train(bits, epochs), "i int, w double")
    out = np.zeros(1 << bits)
    found = fitted.toPandas()
    out[found["i"].to_numpy()] = found["w"].to_numpy()
    return out


def toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bits: int = 20, max_rows: int = 20_000
) -> DataFrame:
    """``(doc_id, score)`` of every document; ``learn_from`` is a condition on the labels' id column."""
    known = (
        labels.filter(learn_from & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key", F.lit("toxicity")), "key").limit(max_rows)
    )
    known = settled(known)  # at most max_rows pairs of numbers, so broadcasting them is safe
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    texts = texts.groupBy("key", "label").agg(F.min("text").alias("text"))  # repeated rows of an id teach once
    w = weights(texts, bits)
    spark = docs.sparkSession
    kept = np.flatnonzero(w[1:]) + 1
    sent = spark.sparkContext.broadcast((kept.astype(np.int32), w[kept], float(w[0])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, value, bias = sent.value
        dense = np.zeros(1 << bits)
        dense[index] = value
        live = dense != 0
        for batch in batches:
            for s in scan(batch.column("text"), ALNUM):
                i, text = features(s, bits)
                met = live[i]
                key = np.unique((text[met].astype(np.int64) << bits) | i[met])
                total = bias + np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], minlength=s.texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(s.first, s.texts), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))], ["doc", "score"])

    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(score, f"doc {source.schema['doc'].dataType.simpleString()}, score double").withColumnRenamed("doc", doc_id)
