"""Operators against brute force on small fixtures, and their defined results on odd input."""

import collections
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagelens.llm import licenses, line_dedup as L, pii
from pagelens.llm.decontaminate import clean, contamination
from pagelens.llm.embedding_join import embedding_duplicates
from pagelens.llm.graph import components
from pagelens.llm.language_id import document_languages, in_declared_language, page_languages
from pagelens.llm.language_model import lm_scores
from pagelens.llm.ngram_join import near_duplicates, one_of_each
from pagelens.llm.pack import Encoder, Packer, fill, packed
from pagelens.llm.queries import id_remainder
from pagelens.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
# Names that operators use inside; as extra columns they must not get in the way.
EXTRA = "doc string, body string, key string, hits string, rest string, n string, low string, chunk string, units string, id string, label string, place string, __text string"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = SPACED.findall(lowered(text))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, one id with two texts, clashing names."""
    words = " ".join(f"Wort{i % 977}.{i % 13}" for i in range(30_000))
    texts = [
        (1, "a b c d e f g h i j k l m n o p"), (1, "a b c d e f g h i j k l m n o p"), (2, "a b c d e f g h i j k l m n o p"), (3, None), (None, "a b c d e f g h i j k l m n o p"), (4, ""), (5, " \n\t "),
        (6, "x"), (7, "x"), (8, words), (9, words + " end"), (10, "Größe und Maß <|endoftext|> ÀÉ"), (11, "!!! ???"), (1, "something else entirely"), (12, "\n\n\n"),
    ]
    n = len(EXTRA.split(","))
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *["x"] * n) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def counted(rows):
    return collections.Counter(map(repr, rows))


# Packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), max_size=6), st.integers(1, 80))
def test_fill_leaves_least_slack(counts, room):
    got = fill(counts, room)
    assert all(n <= counts[k] for k, n in got.items())
    items = list(counts.items())
    best = max(s for c in itertools.product(*(range(n + 1) for _, n in items)) if (s := sum(k * m for (k, _), m in zip(items, c))) <= room)
    assert sum(k * n for k, n in got.items()) == best


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80))
def test_packer_loses_nothing(lengths):
    packer = Packer(64)
    rows = [r for d, n in enumerate(lengths) for r in packer.add(d, np.arange(n, dtype=np.uint32))] + list(packer.end())
    per, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, ids, total, sequence, offset in rows:
        assert total == lengths[doc] and ids.tolist() == list(range(start, start + len(ids)))
        per[doc].append((start, len(ids)))
        sequences[sequence].append((offset, len(ids)))
    for parts, n in [*((per[d], n) for d, n in enumerate(lengths)), *((v, None) for v in sequences.values())]:
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == n if n is not None else at == 64 or at & (at - 1) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t'sab1. \u0085　é<|>", max_size=60) | st.just("<|endoftext|>a <|endoftext|>"))
def test_encoder_agrees_with_the_tokenizer(text):
    global _encoder
    _encoder = globals().get("_encoder") or Encoder()
    assert _encoder(text).tolist() == _encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_round_trip(docs, odd, none):
    for df in (docs.select("doc_id", "text").limit(60), odd):
        encoder = Encoder()
        per = collections.defaultdict(list)
        for r in packed(df).collect():
            per[r.doc_id].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
        expected = collections.defaultdict(int)
        for r in df.collect():
            expected[r.doc_id] += len(encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert {k: sum(map(len, v)) for k, v in per.items()} == expected
    assert packed(none).count() == 0


# Decontamination


def brute_contamination(documents, items, window=13):
    index = collections.defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lowered(text))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            index[tuple(w[a : a + n])].add(i)
    out = []
    for doc, text in documents:
        w = ALNUM.findall(lowered(text))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in index}:
            for a in range(len(w) - n + 1):
                if s := index.get(tuple(w[a : a + n])):
                    found |= s
                    hit[a : a + n] = [True] * n
        out.append((doc, len(w), sum(hit), sorted(found, key=str)))
    return out


def test_contamination_against_brute_force(spark, docs, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = spark.createDataFrame([(900, "a B c"), (901, "x"), (902, None), (903, ""), (904, "c d e f g h i j k l m n o p"), (None, "j k")], "item_id bigint, text string")
    for df, items in ((docs, bench), (odd, more), (odd, more.limit(0)), (none, more)):
        got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"], key=str)) for r in contamination(df, items).collect()]
        known = [(i, t) for i, t in items.select("item_id", "text").collect() if i is not None]
        expected = brute_contamination(df.select("doc_id", "text").collect(), known)
        if items is more:  # an item without an id marks words, but can't be named
            expected = [(d, n, None, f) for d, n, _, f in expected]
            got = [(d, n, None, f) for d, n, _, f in got]
        assert counted(got) == counted(expected)


def test_clean_keeps_columns_and_clean_rows(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r[0] for r in brute_contamination(docs.select("doc_id", "text").collect(), bench.collect()) if r[2] and 20 * r[2] >= r[1]}
    kept = clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad and bad


def test_rows_go_by_their_own_verdicts(spark, docs):
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(None, item), (None, "a clean row"), (None, None), (5, item), (5, "another clean row"), (6, item), (None, "a clean row")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert counted([(r.doc_id, r.text) for r in clean(df, bench).collect()]) == counted([r for r in rows if r[1] != item])

    texts = {r.lang: r.text for r in docs.filter("length(text) > 800").orderBy("doc_id").collect()}
    (own, text), (other, _) = list(texts.items())[:2]
    rows = [(None, text, other, "s"), (None, text, own, "s"), (900_000, text, other, "s"), (900_000, text, own, "s"), (None, None, other, "s"), (900_000, "x", other, None)]
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    kept = [tuple(r) for r in in_declared_language(more).filter("doc_id IS NULL OR doc_id = 900000").collect()]
    assert counted(kept) == counted([r for r in rows if r[1:3] != (text, other)])


# Near duplicates


def brute_components(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        if i != j and a and b and den * len(a & b) >= num * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    by_set = {}
    for i, s in sets:
        if i is not None and s:
            by_set[s] = min(by_set.get(s, i), find(i))
    return [(i, len(s), by_set.get(s) if i is None else find(i)) for i, s in sets]


@pytest.mark.parametrize("frequent", [64, 1])
def test_components_against_brute_force(spark, docs, odd, none, frequent):
    near = []
    base = [f"w{i}" for i in range(130)]
    for k in range(60):
        w = list(base)
        for j in range(k % 5):
            w[(37 * k + 29 * j) % 130] = f"x{k}_{j}"
        near.append((100 + k, " ".join(w)))
    near = spark.createDataFrame(near, "doc_id bigint, text string")
    tables = [(odd, 3, (90, 100)), (none, 3, (90, 100)), (docs, 5, (8, 10))] if frequent == 64 else [(near, 3, (90, 100))]
    for df, width, threshold in tables:
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, width, threshold, frequent=frequent).collect()]
        assert counted(got) == counted(brute_components(df.select("doc_id", "text").collect(), width, *threshold))


@pytest.mark.parametrize("threshold, sizes", [((8, 10), (881, 890, 899, 1101, 1110, 1123)), ((6, 10), (700, 890, 899, 1101, 1200, 1490, 1510))])
def test_components_across_the_border_of_combinations(spark, threshold, sizes):
    # Beginnings of one text in pairs: apart from its own pair a set has no partner, so each link hangs on one shared key.
    pairs = [(a, b) for a, b in itertools.combinations(sizes, 2) if a < 900 and b > 1100 and a * threshold[1] >= b * threshold[0]]
    rows = [(100 * k + i, " ".join(f"p{k}w{j}" for j in range(n + 4))) for k, p in enumerate(pairs) for i, n in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, 5, threshold, frequent=1).collect()]
    assert pairs and counted(got) == counted(brute_components(rows, 5, *threshold))


def test_one_of_each_keeps_the_smallest(odd):
    kept = one_of_each(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 2 not in ids and 7 not in ids and 9 not in ids
    assert {3, 4, 5, 6, 8, None} <= set(ids)


def test_components_of_a_long_chain(spark):
    got = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 300), (5, 5), (300, 200)], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(71)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Embeddings


def test_embedding_join_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 20))
    rows = []
    for i in range(60):
        v = base[i % 6] + rng.standard_normal(20) * (0.05 + 0.12 * (i % 3))
        rows.append((i, v.tolist(), [1, 2, None][i % 7 % 3]))
    rows += [(i, rows[0][1], 1) for i in (70, 71, 71)] + [(80, [0.0] * 20, 1), (81, None, 1), (82, [None] * 20, 1), (83, [math.nan] * 20, 1), (84, [math.inf] * 20, 1), (85, [], 1), (86, [1.0, 2.0], 1), (87, [2.0, 4.0], 1)]
    # Directions of vectors whose squares overflow or vanish; they link like their plain forms.
    extreme = [(90, [1e200, 1e200, 0.0], 1), (91, [1e-200, 1e-200, 1e-300], 1), (92, [1.0, 1.0, 0.0], 1), (93, [1e300, -1e300, 0.0], 1), (94, [5e-324, 0.0, 0.0], 1), (95, [1e308, 1e-308, 0.0], 1)]
    rows += extreme
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, v string")
    got = {}
    for r in embedding_duplicates(df).collect():
        got[r.vec_id] = (r.n_links, r.component_id, r.kept)
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}
    sound = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    for (i, a, x), (j, b, y) in itertools.combinations(sound, 2):
        a, b = (np.array(u) / np.abs(u).max() for u in (a, b))
        if x == y and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            links[i] += 1
            links[j] += 1
            i, j = (next(q for q in iter(lambda q=[p]: q.__setitem__(0, parent[q[0]]) or q[0], None) if parent[q] == q) if parent[p] != p else p for p in (i, j))
            parent[max(i, j)] = min(i, j)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    links[71] //= 2  # two rows of one vector: each has these links
    assert got == {r[0]: (links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}
    assert embedding_duplicates(df.limit(0)).count() == 0


# Line dedup


def test_line_dedup_takes_repeated_blocks_only(spark, odd, none):
    block = "\n".join(f"shared line {i} of a passage" for i in range(12))
    own = lambda k: "\n".join(f"own line {k} {i}" for i in range(6))
    df = spark.createDataFrame([(i, f"{own(i)}\n{block}\n{own(i + 50)}") for i in range(1, 5)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.line_dedup(df).collect()}
    assert got[1].n_removed == 0 and got[1].n_lines == 24 and got[1].text == df.filter("doc_id = 1").first().text
    for i in (2, 3, 4):
        assert got[i].n_removed == 12 and got[i].text == own(i) + "\n" + own(i + 50)
    rows = L.line_dedup(odd).collect()
    assert len(rows) == odd.count() and [r.text for r in rows if r.doc_id == 3] == [None] and {r.text for r in rows if r.doc_id == 4} == {""}
    assert L.line_dedup(none).count() == 0 and set(L.line_dedup(none).columns) == {*odd.columns, "n_lines", "n_removed"}


def test_line_dedup_finds_passages_between_any_lines(spark):
    # Passages of over 50 words in two to five lines, each between lines of the document's own: every copy but the first goes.
    rng = random.Random(5)
    line = lambda name, words: " ".join(f"{name}w{j}" for j in range(words))
    passages = [[line(f"p{k}l{i}", rng.choice([18, 24, 30, 60])) for i in range(rng.randint(3, 5))] for k in range(12)]
    rows, left = [], {}
    for n in range(60):
        k = n % len(passages)
        around = [line(f"d{n}a{i}", rng.randint(1, 30)) for i in range(6)]
        cut = rng.randint(0, 6)
        rows.append((n, "\n".join(around[:cut] + passages[k] + around[cut:])))
        left[n] = rows[-1][1] if n < len(passages) else "\n".join(around)
    got = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == left


def test_line_dedup_leaves_single_short_lines_and_keeps_a_first_copy(spark):
    rows = [(1, "a b c\none\nd e"), (2, "f\na b c\ng"), (3, "x y\nx y\nx y\nx y"), (None, "n1\nn2\nn3"), (4, "n1\nn2\nn3"), (5, " \n\n "), (6, " \n\n "), (7, ""), (7, "")]
    got = [(r.doc_id, r.text) for r in L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    text = dict(got)
    assert len(got) == len(rows) and text[1] == rows[0][1] and text[2] == rows[1][1] and text[None] == rows[3][1] and text[4] == ""
    assert text[5] == text[6] == rows[5][1] and text[7] == "" and "x y" in text[3]


# Language ID


def test_languages(spark, docs, odd, none):
    got = {r.doc_id: r for r in document_languages(docs).collect()}
    labels = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count() and sum(got[i].text_language == labels[i] for i in got) >= 0.98 * len(got)
    assert all(0 < r.probability <= 1 for r in got.values())
    kept = in_declared_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    assert document_languages(odd).count() == odd.count() and {r.language for r in document_languages(none.unionByName(odd)).collect()} == {"en"}
    assert in_declared_language(odd).count() == odd.count() and document_languages(none).count() == 0


def test_host_prior_decides_what_the_text_does_not(spark, docs):
    body = {r.lang: r.text for r in docs.filter("length(text) > 500").collect()}
    page = lambda i, host, text, lang="": (i, f"https://{host}/p", f"<html{lang}><body>{text}</body></html>")
    rows = [page(i, "www.a.example.de", body["de"]) for i in range(40)] + [page(i, "b.example.fr", body["fr"]) for i in range(40, 80)]
    rows += [page(90, "www.a.example.de", "123"), page(91, "b.example.fr", ""), page(92, "other.example.fr", "?"), (93, None, None), page(94, "b.example.fr", body["de"], ' lang="fr"')]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.language for r in page_languages(df, docs).collect()}
    assert [got[i] for i in (90, 91, 92, 94)] == ["de", "fr", "fr", "de"] and len(got) == len(rows)
    assert page_languages(df, docs.limit(0)).filter("language IS NULL").count() == len(rows)


# Toxicity


def test_toxicity_learns_and_keeps_apart(spark, docs, odd, none):
    mean = [(i, f"you are a{i} vile b{i % 7} person c{i % 11}" if i % 4 == 0 else f"you are a{i} kind b{i % 7} person c{i % 11}", int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame([m[:2] for m in mean], "doc_id bigint, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in mean] + [(None, 1), (5000, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity(df, labels, F.col("doc_id") % 2 == 0).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in mean)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(df, flipped, F.col("doc_id") % 2 == 0).collect()} == got
    scores = toxicity(odd, labels.limit(0), F.lit(True)).collect()
    assert len(scores) == odd.count() and {r.score for r in scores} == {0.5}
    assert toxicity(none, labels, F.lit(True)).count() == 0


# Language model


def test_language_model_counts_and_probabilities(spark, docs, odd, none):
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update(SPACED.findall(lowered(r.text)))
            counts[None] += 1
    total = sum(counts.values())
    scale = total + 0.1 * (len(counts) + 1)
    for top in (200,):
        got = {r.doc_id: r for r in lm_scores(docs, id_remainder(10) != 0, warm_docs=40, top_words=top).collect()}
        for r in rows:
            w = [*SPACED.findall(lowered(r.text)), None]
            g = got[r.doc_id]
            assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total) and g.score < 0
            assert math.isclose(g.base_score, sum(math.log10((counts[x] + 0.1) / scale) for x in w), rel_tol=1e-9)
    few = lm_scores(odd, id_remainder(10) != 0, warm_docs=5).collect()
    assert len(few) == odd.count() and {r.n_tokens for r in few if r.doc_id in (3, 4, 5, 12)} == {1}
    assert lm_scores(none, id_remainder(10) != 0).count() == 0
    assert {r.n_known for r in lm_scores(odd, F.lit(False)).collect()} == {0}


def test_language_model_writes_ids_once_and_learns_each_token_once():
    import pyarrow as pa

    from pagelens.llm import language_model as lm

    texts = ["", None, "A b  c", *(" ".join(f"Wort{j * i % 97} and" for j in range(i)) for i in (3, 16, 40, 700))]
    n, encode = len(texts), lm.Subwords()
    rows = pa.RecordBatch.from_pydict({"doc": pa.array(range(n)), "body": pa.array(range(n)), "learn": pa.array([i != 4 for i in range(n)]), "text": pa.array(texts, pa.string())})
    made = pa.Table.from_batches(list(lm._encoded((None, None))(iter([rows]))))
    ids = made.filter(pa.compute.equal(made["kind"], lm.IDS)).select(["doc", "learn", "ids"]).to_pylist()
    assert sorted((r["doc"], r["learn"]) for r in ids) == [(i, i != 4) for i in range(n)]
    for r in ids:
        got = np.frombuffer(r["ids"], lm._width(encode.size))
        want = [t for w in SPACED.findall(lowered(texts[r["doc"]])) for t in encode.encoder.tokenizer.encode(" " + w, add_special_tokens=False).ids]
        assert got.tolist() == [*want, encode.end]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([r["ids"] for r in ids], pa.binary())})
    seen = [scored[scored >= 0] for _, scored, _ in lm._window_batches(iter([batch]), np.zeros(encode.size, np.int32), 0, 7, 1)]
    assert sorted(np.concatenate(seen).tolist()) == list(range(sum(len(r["ids"]) for r in ids) // 2))


def test_attention_scores_stay_finite():
    from pagelens.llm.attention import SLOTS, Model, windows

    rng = np.random.default_rng(3)
    model = Model(0, flat=(rng.standard_normal(Model(0).flat().size) * 8).astype(np.float32))
    slots = rng.integers(0, SLOTS, 60).astype(np.int32)
    x, scored = windows(slots, np.array([0, 60]), 0)
    at, log = model.scores(x, scored, slots)
    loss, grads = model.gradient(x, scored, slots)
    assert np.isfinite(log).all() and (log <= 1e-3).all() and all(np.isfinite(g).all() for g in grads.values())
    assert math.isclose(-log.mean(), loss, rel_tol=1e-4)


def test_attention_is_causal_and_normalized():
    from pagelens.llm.attention import SLOTS, WINDOW, Model, windows

    rng = np.random.default_rng(1)
    model = Model(3, flat=(rng.standard_normal(Model(0).flat().size) * 0.3).astype(np.float32))
    slots = rng.integers(0, SLOTS, 50).astype(np.int32)
    at, log = model.scores(*windows(slots, np.array([0, 20, 20, 50]), 3), slots)
    assert sorted(at.tolist()) == list(range(50))
    later = slots.copy()
    later[40:] = 7
    at2, log2 = model.scores(*windows(later, np.array([0, 20, 20, 50]), 3), later)
    first, second = dict(zip(at.tolist(), log)), dict(zip(at2.tolist(), log2))
    assert all(math.isclose(first[i], second[i], rel_tol=1e-6) for i in range(40))
    total = 0.0
    for s in range(SLOTS):  # probabilities of all next slots
        slots[10] = s
        x, scored = windows(slots[:11], np.array([0, 11]), 3)
        p = dict(zip(*(v.tolist() for v in model.scores(x, scored, slots[:11]))))
        total += math.exp(p[10])
    assert math.isclose(total, 1, rel_tol=1e-4) and WINDOW == x.shape[1]


def test_attention_gradient():
    from pagelens.llm.attention import SLOTS, Model, windows

    rng = np.random.default_rng(2)
    model = Model(0)
    model.p = {k: v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    slots = rng.integers(0, SLOTS, 40).astype(np.int32)
    x, scored = windows(slots, np.array([0, 40]), 0)
    _, grads = model.gradient(x, scored, slots)
    for name, place in (("q", (slots[3], 2)), ("k", (slots[4], 1)), ("v", (slots[5], 0)), ("r", (slots[6], 3)), ("near", (1,)), ("wg", (2, 5)), ("bg", (4,)), ("wm", (int(slots[7]) // 32, 1, 2)), ("bm", (int(slots[8]) // 32, 3))):
        old, losses = model.p[name][place], []
        for step in (1e-5, -1e-5):
            model.p[name][place] = old + step
            losses.append(model.gradient(x, scored, slots)[0])
        model.p[name][place] = old
        assert math.isclose((losses[0] - losses[1]) / 2e-5, grads[name][place], rel_tol=2e-2, abs_tol=2e-5), name


# PII


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[0::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in s[1::2])) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark, none, odd):
    cards = [c for i in range(3000) if luhn(c := f"4{i:07d}12345678")][:200]
    values = {
        "card": cards, "date": [f"20{y:02d}-0{m}-1{d}" for y in range(20) for m in range(1, 4) for d in range(3)], "ipv4": [f"10.{i}.{i % 7}.255" for i in range(200)],
        "ssn": [f"123-{45 + i % 50}-{1000 + i}" for i in range(200)], "phone": [f"+1 (212) 555-{1000 + i}" for i in range(200)], "email": [f"ab.{i}x@mail.example.com" for i in range(200)],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame([(i, f"see {v}, and again {v}.") for i, (_, v) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymized(df, "secret").collect()}
    other = {r.doc_id: r.text for r in pii.pseudonymized(df, "another").collect()}
    new = collections.defaultdict(list)
    for i, (kind, v) in enumerate(rows):
        m = re.fullmatch(r"see (.*), and again (.*)\.", got[i].text)
        assert m and m[1] == m[2] and len(m[1]) == len(v) or kind == "ipv4"
        new[kind].append(m[1])
    assert sum(got[i].text != other[i] for i in got) > 0.99 * len(rows)
    for kind, vs in new.items():
        assert len(set(vs)) == len(values[kind]) and sum(a != b for a, b in zip(vs, values[kind])) > 0.97 * len(vs)
    assert all(luhn(c) and c[:6] == v[:6] for c, v in zip(new["card"], values["card"]))
    assert all(np.datetime64(d) for d in new["date"]) and all(max(map(int, x.split("."))) < 256 for x in new["ipv4"])
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new["ssn"]) and all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x) for x in new["phone"])


def test_values_that_do_not_validate_stay(spark, odd, none):
    same = ["4041894974608796", "2020-02-30", "300.1.1.1", "666-45-6789", "DE88370400440532013000", "", None, "no numbers", "a@b", "1 2 3"]
    df = spark.createDataFrame(list(enumerate(same)), "doc_id bigint, text string")
    assert [(r.text, r.n_values) for r in pii.pseudonymized(df, "k").orderBy("doc_id").collect()] == [(t, 0) for t in same]
    assert pii.pseudonymized(odd, "k").columns == [*odd.columns, "n_values"] and pii.pseudonymized(odd, "k").count() == odd.count() and pii.pseudonymized(none, "k").count() == 0
    iban = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00")], "doc_id bigint, text string")
    z = pii.pseudonymized(iban, "k").first().text.replace(" ", "")
    assert int(z[4:] + "1314" + z[2:4]) % 97 == 1 and z != "DE89370400440532013000"


def test_values_of_other_forms_are_replaced(spark):
    phones = [
        "+1 (139) 555-2766", "+1 (017) 555-7713", "+1 212 155 2766", "(212) 555-1000", "212-555-1000", "1-212-555-1000", "+44 20 7946 0958", "+49 (0)30 1234567", "0049 30 1234567", "020 7946 0958", "(030) 1234567", "01 23 45 67 89",
    ]
    ibans = ["GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "FR14 2004 1010 0505 0001 3M02 606", "IT60X0542811101000000123456", "MT84MALT011000012345MTLCAST001S"]
    df = spark.createDataFrame(list(enumerate([f"see {v}, done." for v in phones + ibans])), "doc_id bigint, text string")
    got = [(r.text[4:-7], r.n_values) for r in pii.pseudonymized(df, "secret").orderBy("doc_id").collect()]
    shape = lambda v: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))
    assert all(n == 1 and a != b and shape(a) == shape(b) for a, (b, n) in zip(phones + ibans, got))
    for v, _ in got[len(phones) :]:
        z = v.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in z[4:] + z[:4])) % 97 == 1
    assert [got[i][0][:3] for i in (0, 6, 7)] == ["+1 ", "+44", "+49"] and got[4][0][-8:] == got[5][0][-8:]

    card = "4111 1111 1111 1111"
    runs = [f"{card} 12/25", f"12 {card}", f"{card} 5500 0000 0000 0004", f"{card} {card} {card}"]
    df = spark.createDataFrame(list(enumerate([card, *runs])), "doc_id bigint, text string")
    own, *rest = [r.text for r in pii.pseudonymized(df, "secret").orderBy("doc_id").collect()]
    assert own != card and rest[0] == f"{own} 12/25" and all(card not in r for r in rest) and rest[2].startswith(own) and "0000 0000 0004" not in rest[2] and rest[3] == f"{own} {own} {own}"
    numbers = [f"+1 {a} {e} {n}" for a in ("019", "199", "200", "999") for e in ("000", "199", "200") for n in range(1000, 1030)]
    df = spark.createDataFrame(list(enumerate(numbers)), "doc_id bigint, text string")
    assert len({r.text for r in pii.pseudonymized(df, "k").collect()}) == len(numbers)


def test_feistel_is_a_permutation_of_its_domain(spark):
    domain = spark.range(189 * 7).selectExpr("id", f"{pii.feistel('t', 'id div 7', 'id % 7', '189', '7', chr(39) + 'k' + chr(39))} AS q").selectExpr("q.a * 7 + q.b AS x")
    assert sorted(r.x for r in domain.collect()) == list(range(189 * 7))


# Licenses


def test_license_scan(spark, odd, none):
    mit = licenses.NOTICES[-1][1]
    texts = ["Copyright (c) 2020 X\n\n" + mit.upper().replace(". ", ".\n"), "foo\nReleased under the  MIT licence!\nbar", "All rights reserved.", "", None, "Licensed under CC BY-NC 4.0.\n", mit.replace("free of charge", "for money")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, "All rights reserved.", "y")], "doc_id bigint, text string, license string")
    got = sorted((r.doc_id, r.whole, r.parts, r.n_lines) for r in licenses.license_scan(df).collect())
    assert got == [(0, ["MIT"], ["MIT"], 0), (1, [], ["MIT"], 1), (2, [], [], 0), (2, [], [], 0), (3, [], [], 0), (4, [], [], 0), (5, ["CC-BY-NC-4.0"], ["CC-BY-NC-4.0"], 1), (6, [], [], 0)]
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(none).count() == 0
    own = spark.createDataFrame([("mine", "Größe und Maß <|endoftext|> ÀÉ"), (None, "x"), ("void", None)], "license string, text string")
    assert [r.doc_id for r in licenses.license_scan(odd, own).filter("size(whole) > 0").collect()] == [10]


def test_whole_texts_of_common_licenses(spark):
    at = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    have = [(k, (at / f).read_text()) for f, k in files.items() if (at / f).exists()]
    have += [("GPL-3.0", t[: t.index("How to Apply These Terms")]) for k, t in have if k == "GPL-3.0"]
    have += [(k, f"{title}\n\nCopyright (c) 2020, X\n\n{text}") for k, (title, text) in licenses.TEXTS.items()]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(have)], "doc_id bigint, text string")
    assert {r.doc_id: r.whole for r in licenses.license_scan(df).collect()} == {i: [k] for i, (k, _) in enumerate(have)}
