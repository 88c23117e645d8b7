"""License canonical forms against a plain Python canonicalizer, and changed license texts."""

import hashlib
import pathlib
import re

import pytest

from pagelens.llm import licenses as L

COPYRIGHT = re.compile(r"^[^a-z0-9]*(copyright\b(?! holder| owner| notice| license| law)|\(c\)\s*(copyright\b|[0-9]{4}\b)|©|all rights reserved)")


def plain_line(line):
    low = line.lower()
    if COPYRIGHT.search(low):
        return ""
    out = re.sub(r"[\W_]+", " ", low).strip()
    for a, b in L.SPELLINGS:
        out = out.replace(a.replace("-", " "), b)
    return out


def plain_units(text):
    """(kind, canonical) of the whole text, its paragraphs and its lines."""
    lines = (text or "").split("\n")
    forms = [plain_line(x) for x in lines]
    whole = re.sub(" +", " ", " ".join(f for f in forms if f)).strip()
    paragraphs, now = [], []
    for x, f in zip(lines, forms):
        if x.strip(" ") == "":
            paragraphs.append(now)
            now = []
        else:
            now.append(f)
    paragraphs = [re.sub(" +", " ", " ".join(p)).strip() for p in [*paragraphs, now]]
    return [(k, c) for k, cs in (("text", [whole]), ("paragraph", paragraphs), ("line", forms)) for c in cs if c]


def plain_scan(text, known):
    met = [(k, c, known[hashlib.sha256(c.encode()).hexdigest()]) for k, c in plain_units(text) if hashlib.sha256(c.encode()).hexdigest() in known]
    whole, parts = {x for k, _, ls in met if k == "text" for x in ls}, {x for _, _, ls in met for x in ls}
    return sorted(whole), sorted(parts), len({c for k, c, _ in met if k == "line"})


@pytest.fixture(scope="module")
def known(spark):
    out = {}
    for r in L.built_in(spark).collect():
        out.setdefault(r.digest, set()).add(r.license)
    return out


MIT = L.NOTICES[-1][1]
BSD = L.TEXTS["BSD-2-Clause"][1]
CURLY = str.maketrans({'"': "“", "'": "’", " ": " "})
CASES = [
    MIT, MIT.translate(CURLY), BSD.translate(CURLY), MIT.replace("free of charge", "for money"), BSD + "\n(c) Selling this software is forbidden.\n", "(c) 2019 A. Person\n" + BSD, "(C) Copyright 2019\n" + BSD,
    "© X\n\n" + MIT + "\n\nAll rights reserved.", "Licensed under CC BY-NC 4.0.", "licensed under cc‑by–nc 4.0!", "", None, "a\n \n\nb\n\n\n", "\n(c) only a clause\n",
]


def test_against_plain_python(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(CASES)], "doc_id bigint, text string"))
    rows = df.collect()
    got = {r.doc_id: (list(r.whole), list(r.parts), r.n_lines) for r in L.license_scan(df).collect()}
    assert got == {r.doc_id: plain_scan(r.text, known) for r in rows}
    told = [got[10_000 + i][0] for i in range(len(CASES))]
    assert told == [["MIT"], ["MIT"], ["BSD-2-Clause"], [], [], ["BSD-2-Clause"], ["BSD-2-Clause"], ["MIT"], ["CC-BY-NC-4.0"], ["CC-BY-NC-4.0"], [], [], [], []]


def test_a_changed_clause_is_not_the_license(spark):
    at = pathlib.Path("/usr/share/common-licenses/Apache-2.0")
    if not at.exists():
        pytest.skip("no license texts here")
    lines = at.read_text().split("\n")
    clause = next(i for i, x in enumerate(lines) if x.strip().startswith("(c)"))
    changed = [*lines[:clause], "      (c) You owe the author one thousand coins and", *lines[clause + 1 :]]
    df = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(changed))], "doc_id bigint, text string")
    assert {r.doc_id: list(r.whole) for r in L.license_scan(df).collect()} == {0: ["Apache-2.0"], 1: []}
