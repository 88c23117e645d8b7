"""Language ID by Bayesian evidence fusion.

Three kinds of evidence on a text's language are multiplied:

* the text: byte trigrams of letters under one smoothed distribution per language, counted over all labelled texts;
* the declared markup language: P(declared code | language), estimated by comparing declarations with text decisions;
* the address suffix and the host: a prior smoothed in steps, host to domain to suffix (top-level domain) to all rows. Each level's counts of text decisions, from
  grouped aggregation, are mixed with the level above as ``(n(language) + m p_above(language)) / (n + m)``.

Trigram counts are made per task in numpy and summed by Spark, so what reaches the driver is languages x 2^bits numbers,
whatever the corpus. Counts by declaration, suffix, domain and host stay tables; hosts are joined, not broadcast. Domain
and host counts are pre-aggregated per task, and a host with a third of all rows is one row of the joined side.

A text's own decision is taken out of its host's and domain's counts before these become its prior. Text evidence is
tempered: trigrams of one text depend on each other, so its log-likelihood ratio counts by ``weight`` per trigram.

Nulls and ties: null or letterless text gives no text evidence; null or unknown declarations and null hosts give none of
their kind; with no evidence at all the language is that of the largest prior. Equal posteriors take the smallest code.
Rows come back as often as they came. Training rows with null labels teach nothing; an
empty training table gives null languages. Column names of the input are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import settled
from .textscan import buffers, slices

BITS = 16
#: Bytes as letters: lower-cased letters and all non-ASCII bytes are themselves, all others are one gap.
_FOLD = np.zeros(256, dtype=np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(1, 27)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_FOLD[0x80:] = np.arange(27, 27 + 128)


def trigrams(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows: first row, rows, hashed trigrams, and the row of each; trigrams of gaps alone are left out."""
    raw, at = buffers(column)
    for i, j in slices(at):
        x = _FOLD[raw[at[i] : at[j]]]
        border = at[i : j + 1] - at[i]
        if len(x) < 3:
            yield i, j - i, np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        value = ((x[:-2] * 155 + x[1:-1]) * 155 + x[2:]).astype(np.uint32)
        keep = (x[1:-1] > 0) & ((x[:-2] > 0) | (x[2:] > 0))
        for b in border[1:-1]:  # a trigram lies in one text
            keep[max(0, b - 2) : b] = False
        index = (value[keep] * np.uint32(2654435769)) >> np.uint32(32 - bits)
        yield i, j - i, index.astype(np.int64), np.searchsorted(border, np.flatnonzero(keep), "right") - 1


def _counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), dtype=object)
            for first, n, index, row in trigrams(batch.column("text"), bits):
                own = labels[first : first + n]
                for label in set(own.tolist()):
                    count = have.setdefault(label, np.zeros(1 << bits, dtype=np.int64))
                    count += np.bincount(index[(own == label)[row]], minlength=1 << bits)
        for label, count in have.items():
            i = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "n": pa.array(count[i], pa.int64())})

    return run


class TextModel:
    """Log-probabilities of trigrams, one column per language in order of codes."""

    def __init__(self, languages: list[str], table: np.ndarray, bits: int):
        self.languages, self.table, self.bits = languages, table, bits


def text_model(labelled: DataFrame, text: str = "text", label: str = "lang", bits: int = BITS, smooth: float = 0.5) -> TextModel:
    """Trigram distributions of all labelled texts."""
    source = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter("label IS NOT NULL")
    found = source.mapInArrow(_counts(bits), "label string, i int, n bigint").groupBy("label", "i").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique().tolist())
    table = np.full((1 << bits, max(1, len(languages))), smooth)
    if languages:
        np.add.at(table, (found["i"].to_numpy(), np.searchsorted(languages, found["label"].to_numpy().astype(str))), found["n"].to_numpy())
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), bits)


def _likelihoods(sent, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rest = batch.drop_columns(["__text"])
            for first, n, index, row in trigrams(batch.column("__text"), model.bits):
                scores = np.stack([np.bincount(row, model.table[index, k], minlength=n) for k in range(model.table.shape[1])], axis=1) if n else np.zeros((0, 1))
                scores = weight * (scores - scores.max(axis=1, keepdims=True))
                part = rest.slice(first, n)
                at = pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(at, pa.array(scores.ravel()))
                met = pa.array(np.bincount(row, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, met], [*part.schema.names, "__text_log", "__trigrams"])

    return run


def host_of(url: str) -> Column:
    """Lower-cased host of an address, without user, port and trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.col(url))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def domain_of(host: str) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.col(host), ".", -2)


def _levels(decided: DataFrame, key: str, k: int, counts: str) -> DataFrame:
    """Decisions for each language, as one array per key."""
    return decided.filter(f"{key} IS NOT NULL").groupBy(key).agg(F.array(*(F.sum(F.when(F.col("__best") == i + 1, F.col("n")).otherwise(0)) for i in range(k))).alias(counts))


def identify(
    rows: DataFrame, model: TextModel, keys: list[str], text: Column, declared: Column, host: Column, domain: Column, suffix: Column, weight: float = 0.1, strength: float = 20.0, pseudo: float = 1.0
) -> DataFrame:
    """Per row ``keys``, ``declared``, ``host``, ``text_language`` (by the text alone), ``language``, ``probability`` (its
    posterior) and ``trigrams``; the evidence is given as expressions over the rows' columns."""
    codes = model.languages
    k = len(codes)
    lean = rows.select(
        F.struct(*(F.col(f"`{c}`") for c in keys)).alias("__key"), text.alias("__text"), F.nullif(F.substring_index(F.lower(F.trim(declared)), "-", 1), F.lit("")).alias("__declared"),
        host.alias("__host"), domain.alias("__domain"), F.lower(suffix).alias("__suffix"),
    )
    if not k:
        return lean.selectExpr("__key.*", "__declared AS declared", "__host AS host", "cast(NULL AS string) AS text_language", "cast(NULL AS string) AS language", "cast(NULL AS double) AS probability", "0L AS trigrams")
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kept = lean.drop("__text")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema)}, __text_log array<double>, __trigrams bigint"
    scored = lean.mapInArrow(_likelihoods(sent, weight), schema).withColumn("__best", F.expr("if(__trigrams = 0, NULL, array_position(__text_log, array_max(__text_log)))").cast("int"))

    # One count for each host, declaration and decision; the coarser levels are sums of these.
    decided = settled(scored.filter("__best IS NOT NULL").groupBy("__declared", "__suffix", "__domain", "__host", "__best").agg(F.count("*").alias("n")))
    every = {r["__best"]: r["n"] for r in decided.groupBy("__best").agg(F.sum("n").alias("n")).collect()}  # one row a language
    told = decided.filter("__declared IS NOT NULL").groupBy("__best").agg(F.sum("n").alias("n")).collect()
    kinds = decided.agg(F.count_distinct("__declared")).first()[0]
    total = F.array(*(F.lit(float(every.get(i + 1, 0))) for i in range(k)))
    said = F.array(*(F.lit(float(next((r["n"] for r in told if r["__best"] == i + 1), 0))) for i in range(k)))
    joined = scored
    for key, counts in (("__declared", "__cd"), ("__suffix", "__cs"), ("__domain", "__cm"), ("__host", "__ch")):
        joined = joined.join(_levels(decided, key, k, counts), key, "left")

    def at(name: str, i: Column) -> Column:
        """A key's count for a language without the row's own decision."""
        return F.coalesce(F.get(F.col(name), i), F.lit(0)) - F.when(F.col(name).isNotNull() & (F.col("__best") == i + 1), 1).otherwise(0)

    def mixed(name: str, above: str) -> Column:
        n = F.aggregate(F.coalesce(F.col(name), F.array()), F.lit(0).cast("bigint"), lambda a, x: a + x) - F.when(F.col(name).isNotNull() & F.col("__best").isNotNull(), 1).otherwise(0)
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (at(name, i) + strength * F.get(F.col(above), i)) / (n + strength))

    base = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.get(total, i) + 1.0) / (float(sum(every.values())) + k))
    prior = joined.withColumn("__p0", base).withColumn("__p1", mixed("__cs", "__p0")).withColumn("__p2", mixed("__cm", "__p1")).withColumn("__p3", mixed("__ch", "__p2"))
    own = F.when(F.col("__declared").isNotNull() & F.col("__best").isNotNull(), 1).otherwise(0)
    word = lambda i: F.when(F.col("__declared").isNull(), 0.0).otherwise(
        F.log((at("__cd", i) + pseudo) / (F.get(said, i) - F.when(F.col("__best") == i + 1, own).otherwise(0) + pseudo * max(1, kinds)))
    )
    logs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(F.col("__text_log"), i), F.lit(0.0)) + F.log(F.get(F.col("__p3"), i)) + word(i))
    out = prior.withColumn("__logs", logs).withColumn("__top", F.array_max("__logs"))
    names = F.array(*(F.lit(c) for c in codes))
    return out.select(
        "__key.*", F.col("__declared").alias("declared"), F.col("__host").alias("host"), F.get(names, F.col("__best") - 1).alias("text_language"),
        F.get(names, F.array_position("__logs", F.col("__top")).cast("int") - 1).alias("language"),
        (1.0 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))).alias("probability"), F.col("__trigrams").alias("trigrams"),
    )


def page_text(html: str) -> Column:
    """Text of a page: markup, scripts, styles and comments become spaces."""
    return F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def page_languages(pages: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """Languages of crawled pages ``(page_id, url, html)``, with text evidence learned from ``(text, lang)``."""
    host = host_of("url")
    keyed = pages.select("page_id", "html", host.alias("host"))
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)", 1)
    return identify(keyed, text_model(labelled), ["page_id"], page_text("html"), declared, F.col("host"), domain_of("host"), F.substring_index("host", ".", -1), **options)


def _judged(docs: DataFrame, **options) -> DataFrame:
    """Languages of documents by all that a verdict depends on: id, label and source as given, and ``body``, the hash of the text."""
    nothing = F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("body"))
    return identify(rows, text_model(docs), ["doc_id", "body", "lang", "source"], F.col("text"), F.col("lang"), F.col("source"), nothing, nothing, **options)


def document_languages(docs: DataFrame, **options) -> DataFrame:
    """Languages of documents ``(doc_id, text, lang, source)``: the label is the declaration, the source the host."""
    return _judged(docs, **options).drop("body", "lang", "source")


def in_declared_language(docs: DataFrame, sure: float = 0.99, least: int = 20) -> DataFrame:
    """Documents without those whose text is, with that posterior and at least that many trigrams, of another language than
    declared. Each row goes by its own verdict alone, whatever other rows have its id or a null id too."""
    found = _judged(docs).filter((F.col("language") != F.col("declared")) & (F.col("probability") >= sure) & (F.col("trigrams") >= least))
    bad = found.select(*(F.col(c).alias(f"__bad_{c}") for c in ("doc_id", "body", "lang", "source"))).distinct()
    same = (F.xxhash64(docs["text"]) == bad["__bad_body"]) & docs["doc_id"].eqNullSafe(bad["__bad_doc_id"])
    return docs.join(bad, same & docs["lang"].eqNullSafe(bad["__bad_lang"]) & docs["source"].eqNullSafe(bad["__bad_source"]), "left_anti")
