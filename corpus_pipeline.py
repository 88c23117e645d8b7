"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept:

1. language ID: documents whose text is surely of another language than declared go;
2. line dedup: repeated chunks of lines go from the texts; documents left without any text by that go;
3. n-gram Jaccard join: of each group of near duplicates (five-word shingles, 0.8) the smallest id stays;
4. benchmark decontamination: documents of which a twentieth or more is in passages of the benchmark go;
5. packing: the rest becomes sequences of at most 2048 tokens.

Stages 1 to 4 return the columns of the documents, the last one pieces of sequences. Nulls, ties and repeated rows are
treated as the operators say. Packing chooses sequences by a search that SQL can't express, so there is no oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.llm.decontaminate import clean
from pagelens.llm.language_id import in_declared_language
from pagelens.llm.line_dedup import line_dedup
from pagelens.llm.ngram_join import one_of_each
from pagelens.llm.queries import pieces_digest
from pagelens.llm.storage import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_declared_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The operator's own counts would clash with columns of these names, so the documents' columns go in under others.
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    found = line_dedup(docs.withColumnsRenamed(names))
    kept = found.filter("n_removed = 0 OR length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        own = F.col(names["n_chars"])
        kept = kept.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, F.length("text")).otherwise(own).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
