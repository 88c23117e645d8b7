"""The corpus pipeline as a whole: what each stage keeps, against plain Python, with odd rows and clashing columns."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline as P
from pagelens.llm.language_id import in_declared_language

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["n_removed", "n_chunks", "n_lines", "gone", "lines", "n_values", "host", "rest", "doc", "body", "slot", "rep", "key", "root", "units", "items"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def chunks(lines):
    """Beginnings and ends of the chunks of a text's lines."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    roll = [md5(md5("" if i == 0 else lines[i - 1]) + md5(x)) for i, x in enumerate(lines)]
    wide = [x.count(" ") + 1 >= 16 for x in lines]
    out, low = [], 0
    for i in range(len(lines)):
        last = i + 1 == len(lines)
        if last or wide[i] or wide[i + 1] or (i == 0 or roll[i] < roll[i - 1]) and roll[i] < roll[i + 1]:
            out.append((low, i + 1))
            low = i + 1
    return out


def plain_lines(rows):
    """Each chunk but the first of its text, extended within its neighbours, line by line."""
    first, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        if r["text"] is None:
            out.append(r)
            continue
        lines = r["text"].split("\n")
        at, gone = chunks(lines), set()
        for k, (low, high) in enumerate(at):
            before = lines[at[max(0, k - 2)][0] : low]
            after = lines[high : at[k + 1][1]] if k + 1 < len(at) else []
            chunk = tuple(lines[low:high])
            if all(x.strip(" ") == "" for x in chunk):
                continue
            if chunk not in first:
                first[chunk] = before, after
                continue
            while low > at[k][0] - len(before) and (n := at[k][0] - low + 1) <= len(first[chunk][0]) and lines[low - 1] == first[chunk][0][-n]:
                low -= 1
            while (n := high - at[k][1]) < min(len(after), len(first[chunk][1])) and lines[high] == first[chunk][1][n]:
                high += 1
            run = lines[low:high]
            if sum(x.strip(" ") != "" for x in run) >= 2 or "\n".join(run).count(" ") + 1 >= 50:
                gone |= set(range(low, high))
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(" "):
            out.append({**r, "text": text if gone else r["text"], "n_chars": len(text) if gone else r["n_chars"]})
    return out


def plain_near(rows):
    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(lower(r["text"]))) else frozenset() for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def plain_clean(rows, items):
    windows = collections.defaultdict(set)
    for t in items:
        w = ALNUM.findall(lower(t))
        k = min(13, len(w))
        windows[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    out = []
    for r in rows:
        w = ALNUM.findall(lower(r["text"]))
        hit = {j for k, of in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in of for j in range(i, i + k)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rng = random.Random(12)
    real = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [" ".join(f"q{i}w{j}" for j in range(20)) for i in range(3)] + ["short item", "", None]
    shared = "\n".join(" ".join(f"l{i}x{j}" for j in range(12)) for i in range(14))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    rows += [(5000 + i, f"own{i} line {i}\n{shared}\nend{i} of {i} text", "en", None, None) for i in range(6)]
    short = ["a passage of two lines that many share and that has more", "than sixteen words in one of its lines so that it is a chunk by itself always"]
    rows += [(5050 + i, "\n".join([f"own {i} {j}" for j in range(i % 4)] + short + [f"end {i} {j}" for j in range(i % 3)]), "en", "s", 7) for i in range(8)]
    rows += [(5070 + i, f"alone {i}\n{short[1]}\nother {i}", "en", "s", 7) for i in range(2)]
    rows += [(5100 + i, " ".join(f"n{j if rng.random() > 0.01 * i else -i}" for j in range(200)), "de", "s", 5) for i in range(8)]
    rows += [(5200, f"a b c {items[0]} d", "en", "s", 1), (5201, " ".join(f"c{j}" for j in range(600)) + " " + items[1][:60], "en", "s", 1), (5202, "Short, ITEM", "en", "s", 1)]
    rows += [(5300, None, None, None, None), (5301, "", "en", "s", 0), (5302, " \n\t", "en", "s", 3), (5303, "ß" * 30_000 + "\n" + "word " * 30_000, None, "s", 9)]
    spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), items


def as_rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_every_stage_and_the_run(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    plain = [as_rows(in_declared_language(docs))]
    plain += [plain_lines(plain[-1])]
    plain += [plain_near(plain[-1])]
    plain += [plain_clean(plain[-1], items)]
    for (name, stage), want in zip(P.STAGES[:-1], plain):
        docs = spark.createDataFrame([tuple(r.values()) for r in as_rows(stage(spark, docs, at))], docs.schema)
        assert docs.columns == [f.name for f in docs.schema] and as_rows(docs) == want, name
    assert len(plain[0]) > len(plain[1]) or any(a["text"] != b["text"] for a, b in zip(plain[0], plain[1]))
    assert len(plain[1]) > len(plain[2]) > len(plain[3])
    pieces = P.run(spark, at).collect()
    whole = collections.Counter()
    for p in pieces:
        whole[p.doc_id] += p.length
    assert {p.doc_id: p.doc_tokens for p in pieces} == dict(whole) and set(whole) == {r["doc_id"] for r in plain[3]}


def test_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
