"""Finding of personal data in long runs: no recursion by their length, and the finds of the plain patterns."""

import random
import re

from pyspark.sql import functions as F

from pagelens.llm import pii


def test_long_runs_of_digits_and_labels_do_not_overflow(spark):
    cards, address = "4111 1111 1111 1111 " * 2000, "a1@b" + ".c" * 20_000 + ".com"
    same = ["7" * 20_000, "1" * 50_000 + "x", "1-" * 20_000, "ab" * 30_000]
    df = spark.createDataFrame(list(enumerate([*same, cards, f"to {address} now"])), "doc_id int, text string")
    got = [(r.text, r.n_values) for r in pii.pseudonymized(df, "k").orderBy("doc_id").collect()]
    assert got[:4] == [(t, 0) for t in same]
    moved = {got[4][0][i : i + 20] for i in range(0, len(cards), 20)}
    assert len(got[4][0]) == len(cards) and len(moved) == 1 and got[4][1] == 1
    assert re.fullmatch("4111 11[0-9]{2} [0-9]{4} [0-9]{4} ", one := moved.pop()) and one != cards[:20]
    assert got[5][1] == 1 and got[5][0].endswith(address[2:] + " now") and got[5][0] != f"to {address} now"


def test_finds_are_those_of_the_plain_patterns(spark):
    plain = pii._PATTERNS | {
        "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "card": r"\b[0-9](?:[ -]?[0-9]){12,}\b",
    }
    pick, texts = random.Random(4), ["a@b.comx1x@d.com", "a@b.co..x@d.com", "a@b.c.d1.com-x.e", "1234 5678 9012 34567a", "1234 5678 9012 3456a"]
    for signs, start in (("0123456789 -x", ""), ("0123456789 -x", "4111 1111 1111 1"), ("aB1.@-_ ", "a@b.co"), ("a1.@-", ""), ("12a@.c- +(", "a@b.co")):
        texts += [start + "".join(pick.choices(signs, k=40)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found = {r.text: r.found for r in df.select("text", F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0)).alias("found")).collect()}
    assert found == {t: [m[0] for m in re.finditer("|".join(plain.values()), t, re.ASCII)] for t in texts}
