"""The index of the Jaccard join: linked sets share a key whatever is frequent, and passages that many texts share."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pagelens.llm import ngram_join as J
from pagelens.llm.ngram_join import near_duplicates


def prefix(x, num, den):
    return J._prefix(np.array(sorted(x), np.int64), num, den)


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([(9, 10), (8, 10), (6, 10), (95, 100)]), st.sampled_from([0.0, 0.3, 0.9, 1.0]))
def test_linked_sets_share_a_key(seed, n, threshold, share):
    num, den = threshold
    rng = random.Random(seed)
    union = [rng.randrange(-(2**62), 2**62) for _ in range(n + n * (den - num) // num + 2)]
    a = set(union[:n])
    # The largest change that keeps the threshold, of additions and removals.
    b = set(a)
    for v in rng.sample(union, len(union)):
        c = b ^ {v}
        if c and den * len(a & c) >= num * len(a | c) and rng.random() < 0.9:
            b = c
    hot_of = {v: rng.random() < share for v in union}
    prefixes, keys = [prefix(x, num, den).tolist() for x in (a, b)], []
    for x, p in zip((a, b), prefixes):
        # What both prefixes hold is counted twice and so among the shared ones, as is what is frequent; others may be.
        common = [(i, v) for i, v in enumerate(p) if v in prefixes[0] and v in prefixes[1] or hot_of[v] or rng.random() < 0.2]
        pos, token = np.array([i for i, _ in common], np.int64), np.array([v for _, v in common], np.int64)
        keys.append(set(J.index_keys(len(x), pos, token, np.array([hot_of[v] for v in token.tolist()], bool), num, den).tolist()))
    if a != b:
        assert keys[0] & keys[1]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 300), st.integers(0, 60))
def test_bitmaps_never_differ_in_more_bits_than_sets_in_shingles(seed, n, changed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-(2**62), 2**62, n)
    b = np.concatenate([a[changed:], rng.integers(-(2**62), 2**62, changed)])
    bits = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(J._parities(np.unique(a)).tolist(), J._parities(np.unique(b)).tolist()))
    assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("share", [0.5, 0.95])
def test_a_passage_in_half_of_the_texts(spark, share, monkeypatch):
    """Half of 400 texts hold one passage that is half, or nearly all, of each; among them are groups of near copies."""
    monkeypatch.setattr(J, "FAN", 7)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(400):
        own = [f"w{i}_{j}" for j in range(int(100 / share) - 100 if share < 0.9 else rng.randrange(1, 16))]
        words = passage + own if i % 2 else [f"u{i}_{j}" for j in range(120)]
        if i % 5 == 4:
            words = rows[i - 4 if i % 10 == 9 else i - 2][1].split()
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, (9, 10), frequent=4).collect())
    sets = [frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) for w in (t.split() for _, t in rows)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == [(i, len(sets[i]), find(i)) for i in range(400)]
    assert len({c for _, _, c in got}) < 400
