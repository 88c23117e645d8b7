"""Hard negatives and the threshold join below them against plain Python."""

import collections
import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagelens.llm import hard_negatives as H


def plain(rows, anchor, positives=5, negatives=3):
    """rows are (id, vector, label)."""
    by_id = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if math.isqrt(sum(x * x for x in whole)) >= 2**31 - 2:
            continue
        by_id[i] = min(by_id.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in by_id.items():
        if a % anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in by_id.items() if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(found)]
    return sorted(out)


def got(df, anchor):
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("id") % anchor == 0).collect())


SCHEMA = "vec_id bigint, embedding array<double>, label int"


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 40)
    monkeypatch.setattr(H, "ANCHORS", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.2, (6, 20))
    rows = []
    for i in range(400):
        v = centres[rng.integers(6)] * rng.choice([1.0, 0.5, -0.2]) + rng.normal(0, 0.05, 20)
        rows.append((i, v.tolist(), int(rng.choice([0, 0, 0, 1, 2]))))
    rows += [(400 + i, rows[3][1], i % 3) for i in range(30)]  # ties
    assert got(spark.createDataFrame(rows, SCHEMA), 5) == plain(rows, 5)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 30), st.integers(0, 40), st.integers(1, 20), st.sampled_from([3, 1000, 10**8]))
def test_threshold_join(seed, d, n, m, size):
    rng = np.random.default_rng(seed)
    rows, anchors = (np.floor(rng.normal(0, size, (k, d)) * rng.choice([0, 0.1, 1], (k, 1))).astype(np.int64) for k in (n, m))
    whole = anchors @ rows.T
    least = rng.integers(-d * size, 3 * d * size * size + 2, m) if seed % 3 else np.full(m, H._NONE)
    i, j, score = H.reaching(anchors, least, rows)
    want = {(a, b): int(whole[a, b]) for a in range(m) for b in range(n) if whole[a, b] >= least[a]}
    assert dict(zip(zip(i.tolist(), j.tolist()), score.tolist())) == want


def test_covered_dimensions_are_not_indexed(monkeypatch):
    """Rows whose whole norm can't reach the threshold are never multiplied."""
    rows = np.ones((50, 16), np.int64)
    rows[:5] *= 100
    i, j, score = H.reaching(np.full((1, 16), 10, np.int64), np.array([8000]), rows)
    assert sorted(j.tolist()) == [0, 1, 2, 3, 4] and set(score.tolist()) == {16_000}


def test_odd_rows(spark):
    rng = random.Random(9)
    vector = lambda d=4: [rng.uniform(-1, 1) for _ in range(d)]
    rows = [(i, vector(), i % 3) for i in range(40)]
    rows += [(None, vector(), 1), (50, None, 1), (51, vector(), None), (52, [0.5, None, 0.5, 0.5], 1), (53, [math.nan] * 4, 1), (54, [math.inf, 0.0, 0.0, 0.0], 1), (55, [], 1), (56, [0.0] * 4, 1)]
    rows += [(57, [1e200, 1e200, 0.0, 0.0], 1), (58, [1e-200] * 4, 1), (59, vector(7), 1), (60, vector(7), 2), (60, vector(7), 1), (65, [8e6, 0.0, 0.0, 1.0], 0), (3, rows[3][1], 0), (70, vector(), 7)]
    names = "id label_ v of key least most windows part parts salt d n norm longest anchor nth score row is_anchor to".split()
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    assert got(df, 5) == plain(rows, 5)
    assert got(df.limit(0), 5) == []
    assert got(df.filter("vec_id % 5 <> 0"), 5) == []
    assert collections.Counter(r[0] for r in got(df, 1))
