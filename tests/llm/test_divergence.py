"""Source divergence against plain Python, with tiles and blocks small enough to be many."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pagelens.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, ranks=200):
    """rows are (text, lang, source)."""
    groups, seen, counts = set(), collections.defaultdict(set), collections.defaultdict(collections.Counter)
    for i, row in enumerate(rows):
        text, lang, source = (x or "" for x in row)
        groups.add((lang, source))
        for term in TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text)):
            seen[lang, term].add(i)
            counts[lang, source][term] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), docs in seen.items() if of == lang and len(docs) >= least]
        sources = [s for of, s in groups if of == lang]
        whole = collections.Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in D.source_divergence(df, **options).collect())


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("tile, matrix", [(128, 1 << 21), (2, 8)])
def test_against_plain_python(spark, monkeypatch, tile, matrix):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "MATRIX", matrix)
    rng = random.Random(tile)
    words = [w + e for w in "alpha Beta über ß ÀÉ z zz 東京 gamma delta".split() for e in ("", "s", "ed")]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(40))) + "!1", rng.choice(["en", "de", None]), f"s{rng.randrange(7)}") for _ in range(150)]
    rows += [("", "fr", "a"), (None, "fr", "b"), ("only once", "fr", None), ("12 34", "en", "no terms"), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    for ranks in (200, 3):
        assert got(df, ranks=ranks) == plain(rows, ranks=ranks)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=60), st.integers(1, 5))
def test_skyband(points, k):
    count, base = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    place = np.random.default_rng(len(points)).permutation(len(points))
    want = [sum(count[j] >= count[i] and base[j] <= base[i] and place[j] < place[i] for j in range(len(points))) < k for i in range(len(points))]
    assert D.dominated_by_fewer(count, base, place, k).tolist() == want


def test_skyband_of_many():
    rng = np.random.default_rng(1)
    count, base, place = rng.integers(1, 400, 5000), rng.integers(1, 400, 5000), rng.permutation(5000)
    by = np.array([((count >= c) & (base <= b) & (place < p)).sum() for c, b, p in zip(count, base, place)])
    assert (D.dominated_by_fewer(count, base, place, 20) == (by < 20)).all()


def test_partitions_are_thinned_while_read(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", "s", f"t{i}", rng.randrange(1, 5), rng.randrange(5, 9)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n bigint, n_lang bigint").repartition(2)
    monkeypatch.setattr(D, "HELD", 1000)
    kept = {r.term for r in D.skybands(df, 5).collect()}
    best = sorted(rows, key=lambda r: (-(r[3] ** 2) / r[4], r[2].encode()))[:5]
    assert {r[2] for r in best} <= kept and len(kept) < 1000


def test_shares_of_large_counts():
    n = np.array([0, 5, 10**13, 4 * 10**15], np.int64)
    assert D._shares(n, np.full(4, 9 * 10**15)).tolist() == [1 + 10**9 * (int(x) + 1) // (9 * 10**15) for x in n]


def test_odd_rows(spark):
    extra = ", ".join(f"{c} string" for c in "n docs term item value rank a b block tile total kept part tiles".split())
    rows = [(" ".join(["Wort"] * 3), None, "s")] * 3 + [("x" * 100_000 + " wort wörter", "", None)] + [("!", "en", "s")]
    df = spark.createDataFrame([(*r, *["x"] * 14) for r in rows], SCHEMA + ", " + extra)
    assert got(df) == plain(rows)
    assert got(df.limit(0)) == []
