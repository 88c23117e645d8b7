"""Registered queries of the training-data operators, over whole tables, with the digest columns that checks compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontaminate import contamination
from .divergence import ORACLE as DIVERGENCE_SQL, source_divergence
from .embedding_join import ORACLE as EMBEDDING_SQL, embedding_duplicates
from .hard_negatives import ORACLE as HARD_NEGATIVES_SQL, hard_negatives
from .language_id import page_languages
from .language_model import lm_scores
from .licenses import license_scan
from .line_dedup import ORACLE as LINE_DEDUP_SQL, line_dedup
from .ngram_join import near_duplicates
from .pack import packed
from .pii import pseudonymized
from .secret_scan import secret_scan
from .toxicity import toxicity

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: how the contracts split learning from held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def pieces_digest(docs: DataFrame) -> DataFrame:
    """Pieces of packed sequences with a checksum in place of their ids."""
    return packed(docs, window=2048, end_id=1).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        F.col("offset").cast("bigint").alias("offset"),
    )


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(90, 100))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=id_remainder(4) != 2)
    return scored.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))


ORACLE["op8_line_dedup"] = f"SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM ({LINE_DEDUP_SQL})"


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), secret="key of the registered query")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("whole", ",").alias("whole"), F.array_join("parts", ",").alias("parts"), "n_lines")


@query
def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLE["op2_embedding_join"] = EMBEDDING_SQL


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(table(spark, sf_dir, "documents"), learn_from=id_remainder(10) != 0)
    return scored.select("doc_id", F.coalesce(id_remainder(10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex", "crf")]
    base = told(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)


ORACLE["op12_source_divergence"] = DIVERGENCE_SQL


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(vectors, is_anchor=F.col("id") % 50 == 0, positives=5, negatives=3, low=(50, 100), high=(95, 100), scale=256)


ORACLE["op13_hard_negatives"] = HARD_NEGATIVES_SQL


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
    lambda a: array_to_string(ws[a : a + least(13, len(ws)) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS place, unnest(list_transform(range(1, len(ws) - k + 2),
    lambda a: array_to_string(ws[a : a + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k),
met AS (SELECT doc_id, place, k, item_id FROM dw JOIN iw USING (k, g)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(place, place + k)) AS word FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op9_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 90 * (x.n + y.n - same)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
