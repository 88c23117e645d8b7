"""Line dedup by content-defined chunks of lines, extended line by line, with DataFrame functions only.

Every line has a hash, and every place between lines a rolling hash of the two lines before it. A chunk ends after a line
whose rolling hash is smaller than those one line before and after it, so borders depend on three or four lines around
them alone: text inserted elsewhere doesn't move them. A line of ``own_words`` words and more is a chunk by itself, so a
passage of prose has a chunk inside it wherever its neighbours put their borders.

Chunks that aren't blank are compared over all documents: digests are grouped first (a count and the first place for each,
combined before the shuffle), then the text of each repeated chunk is compared byte by byte with the text of its first
place. Where they are equal the repeat is extended to both sides, through two chunks before and one after, as far as lines
are equal there too. That reaches the edge of a passage: only the borders after its first two lines and its last depend on
lines outside, so any chunk farther off is found by itself. A run of equal lines goes if two of its lines at least aren't
blank or it has ``long_words`` words. The first place is that of the smallest document id (null
first), then of the smallest hash of the text, then the first in the text; every run that goes is equal to an earlier one,
so its first copy stays.

Not found: a passage whose lines are all shorter than ``own_words`` if no two borders fall into it, a chunk whose first
place has other neighbours than the place that shares more with it, and parts of lines.

Nulls and ties: null text stays null; a text without repeats stays as it is, an empty one too; a text of which all lines
go is empty. Rows that are equal in id and text are one document and stay equal. Within one text only the first of equal
runs stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LONG_WORDS = 50
OWN_WORDS = 16

# Expressions over ``text``, each over the one before.
_LINES = r"split(text, '\n', -1)"
_ROLL = "transform(lines, (l, i) -> md5(concat(md5(if(i = 0, '', element_at(lines, if(i = 0, 1, i)))), md5(l))))"
_WIDE = "transform(lines, l -> length(l) - length(replace(l, ' ', '')) + 1 >= {own_words})"
_ENDS = """filter(sequence(1, size(lines)), i -> i = size(lines) OR element_at(told.wide, i) OR element_at(told.wide, if(i = size(lines), i, i + 1))
    OR ((i = 1 OR element_at(told.roll, i) < element_at(told.roll, if(i = 1, 1, i - 1))) AND element_at(told.roll, i) < element_at(told.roll, if(i = size(lines), i, i + 1))))"""
_CHUNKS = """transform(ends, (e, j) -> array_join(slice(lines, if(j = 0, 0, element_at(ends, if(j = 0, 1, j))) + 1,
    e - if(j = 0, 0, element_at(ends, if(j = 0, 1, j)))), '\n'))"""
_ELIGIBLE = r"(length(run) - length(replace(run, ' ', '')) + 1 >= {long_words} AND length(trim(run)) > 0) OR size(filter(split(run, '\n', -1), l -> trim(l) <> '')) >= 2"
# How many lines before and after agree: the longest common end and beginning of the neighbouring chunks.
_BACK = "aggregate(sequence(1, least(size(before), size(first_before))), 0, (n, i) -> if(n = i - 1 AND element_at(before, -i) = element_at(first_before, -i), i, n))"
_FORTH = "aggregate(sequence(1, least(size(after), size(first_after))), 0, (n, i) -> if(n = i - 1 AND element_at(after, i) = element_at(first_after, i), i, n))"


def _steps(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    for name, expression in steps.items():  # a generator of one row keeps a step from being copied into each use of it
        df = df.withColumn(name, F.explode(F.array(F.expr(expression))))
    return df


def chunked(df: DataFrame, own_words: int) -> DataFrame:
    """Adds ``chunks``, which joined by line feeds give ``text`` again, and ``ends``, the number of the last line of each."""
    steps = {"lines": _LINES, "told": f"struct({_ROLL} AS roll, {_WIDE.format(own_words=own_words)} AS wide)", "ends": _ENDS, "chunks": _CHUNKS}
    return _steps(df, steps).drop("lines", "told")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS, own_words: int = OWN_WORDS) -> DataFrame:
    """All rows and columns with repeated runs of lines taken out of the text, and ``n_lines``, ``n_removed`` (lines before, lines gone)."""
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    wrapped = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).alias("rest"))

    # Digests of all chunks: no text is shuffled here.
    light = chunked(wrapped.select("doc", "body", "text"), own_words).select("doc", "body", F.posexplode("chunks").alias("at", "chunk")).filter(r"chunk RLIKE '[^ \n]'")
    light = light.select("doc", "body", "at", F.unhex(F.md5("chunk")).alias("digest"))
    repeated = light.groupBy("digest").agg(F.min(F.struct("doc", "body", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    places = light.join(repeated, "digest").select("doc", "body", "at", "digest", F.expr("struct(doc, body, at) <=> first").alias("is_first")).distinct()
    marked = places.groupBy("doc", "body").agg(F.collect_list(F.struct("at", "digest", "is_first")).alias("marks"))

    def with_marks(df: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        m = marks.withColumnsRenamed({"doc": "m_doc", "body": "m_body"})
        return df.join(m, df["doc"].eqNullSafe(m["m_doc"]) & (df["body"] == m["m_body"]), how).drop("m_doc", "m_body")

    # Texts of repeated chunks and of their neighbours only: the first place's against all others'.
    texts = chunked(with_marks(wrapped.select("doc", "body", "text"), marked, "inner"), own_words).select("doc", "body", F.explode("marks").alias("m"), "chunks", "ends")
    texts = texts.select(
        "doc", "body", "m.digest", "m.is_first", F.expr("element_at(chunks, m.at + 1)").alias("chunk"), F.expr("if(m.at = 0, 0, element_at(ends, greatest(m.at, 1))) + 1").alias("low"),
        F.expr("element_at(ends, m.at + 1)").alias("high"), F.expr(r"if(m.at = 0, NULL, array_join(slice(chunks, greatest(m.at - 1, 1), least(m.at, 2)), '\n'))").alias("before"), F.expr("get(chunks, m.at + 1)").alias("after"),
    )
    first = texts.filter("is_first").groupBy("digest").agg(F.min(F.struct("chunk", "before", "after")).alias("kept"))
    met = texts.filter("NOT is_first").join(first, "digest").filter("chunk = kept.chunk")
    split = lambda c: F.coalesce(F.split(c, "\n", -1), F.array().cast("array<string>"))
    met = met.select(
        "doc", "body", "low", "high", "chunk", split(F.col("before")).alias("before"), split(F.col("after")).alias("after"),
        split(F.col("kept.before")).alias("first_before"), split(F.col("kept.after")).alias("first_after"),
    )
    at_all = lambda e, a, b: f"if(size({a}) = 0 OR size({b}) = 0, 0, {e})"
    met = _steps(met, {"back": at_all(_BACK, "before", "first_before"), "forth": at_all(_FORTH, "after", "first_after")})
    met = _steps(met, {"run": r"array_join(concat(slice(before, size(before) - back + 1, back), array(chunk), slice(after, 1, forth)), '\n')"})
    runs = met.filter(_ELIGIBLE.format(long_words=long_words)).select("doc", "body", F.expr("sequence(low - back, high + forth)").alias("run"))
    gone = runs.groupBy("doc", "body").agg(F.array_distinct(F.flatten(F.collect_set("run"))).alias("gone"))

    out = with_marks(wrapped, gone, "left")
    out = _steps(out, {"lines": f"if(gone IS NULL, NULL, {_LINES})"})
    left = F.expr(r"if(gone IS NULL, text, array_join(transform(array_except(sequence(1, size(lines)), gone), i -> element_at(lines, i)), '\n'))")
    return out.select(
        F.col("doc").alias(doc_id), left.alias(text), *(F.col(f"rest.`{c}`").alias(c) for c in rest if c not in ("n_lines", "n_removed")),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


#: The same over DuckDB, for whole tables. Texts are few enough there to be grouped as they are.
ORACLE = f"""
WITH keyed AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
rolled AS (SELECT *, list_transform(lines, lambda l, i: md5(md5(CASE WHEN i = 1 THEN '' ELSE lines[i - 1] END) || md5(l))) AS roll,
    list_transform(lines, lambda l: length(l) - length(replace(l, ' ', '')) + 1 >= {OWN_WORDS}) AS wide FROM keyed),
ended AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR wide[i] OR wide[i + 1]
    OR ((i = 1 OR roll[i] < roll[i - 1]) AND roll[i] < roll[i + 1])) AS ends FROM rolled),
cut AS (SELECT doc_id, lines, unnest(range(1, len(ends) + 1)) AS place, unnest(list_transform(ends, lambda e, j: CASE WHEN j = 1 THEN 1 ELSE ends[j - 1] + 1 END)) AS low, unnest(ends) AS high,
    unnest(list_transform(ends, lambda e, j: CASE WHEN j <= 3 THEN 1 ELSE ends[j - 3] + 1 END)) AS low_before, unnest(list_transform(ends, lambda e, j: ends[j + 1])) AS high_after FROM ended),
placed AS (SELECT *, array_to_string(lines[low : high], chr(10)) AS chunk, CASE WHEN place = 1 THEN [] ELSE lines[low_before : low - 1] END AS before,
    CASE WHEN high_after IS NULL THEN [] ELSE lines[high + 1 : high_after] END AS after FROM cut),
firsts AS (SELECT chunk, arg_min({{'b': before, 'a': after}}, (doc_id, place)) AS f, min((doc_id, place)) AS at FROM placed WHERE len(list_filter(string_split(chunk, chr(10)), lambda l: trim(l) <> '')) > 0 GROUP BY chunk HAVING count(*) > 1),
met AS (SELECT doc_id, low, high, lines,
    list_max([0] || list_filter(range(1, least(len(before), len(f.b)) + 1), lambda i: before[len(before) - i + 1 :] = f.b[len(f.b) - i + 1 :])) AS back,
    list_max([0] || list_filter(range(1, least(len(after), len(f.a)) + 1), lambda i: after[: i] = f.a[: i])) AS forth
    FROM placed JOIN firsts USING (chunk) WHERE (doc_id, place) <> firsts.at),
runs AS (SELECT doc_id, low - back AS low, high + forth AS high, array_to_string(lines[low - back : high + forth], chr(10)) AS run FROM met),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS line FROM runs
    WHERE (length(run) - length(replace(run, ' ', '')) + 1 >= {LONG_WORDS} AND length(trim(run)) > 0) OR len(list_filter(string_split(run, chr(10)), lambda l: trim(l) <> '')) >= 2),
judged AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END AS text,
    coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed
FROM keyed LEFT JOIN judged USING (doc_id)
"""
