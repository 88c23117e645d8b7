"""Fixed-window rate limiting over a request log, and session cost.

A window opens at a client's first request and lasts W; the next window opens at the first request
after it. At most one window opens per W-aligned time bucket, because openings are at least W apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import Pieces
from .skew import join_dimension

KEY = ["kind", "client"]
#: Requests between which an empty bucket lies can't share a window, so each run of buckets is judged by itself.
RUN = [*KEY, "run"]


def _buckets(known: DataFrame, window_ms: int, limit: str) -> DataFrame:
    """Time buckets with requests: their run, its length, and whether two neighbours in it hold more than the limit.

    A window touches two neighbouring buckets at most, so a run where no two hold more admits everything. Windows run
    over a key's buckets, which are as many as the log is long, however many requests the key has.
    """
    counts = known.groupBy(*KEY, "bucket").agg(F.count("*").alias("n"))
    order = "OVER (PARTITION BY kind, client ORDER BY bucket)"
    near = f"lag(bucket) {order} = bucket - 1"
    rows = counts.selectExpr("*", f"CASE WHEN {near} THEN 0 ELSE 1 END AS opens", f"n + CASE WHEN {near} THEN lag(n) {order} ELSE 0 END AS two")
    rows = rows.selectExpr(*KEY, "bucket", "two", f"sum(opens) {order} AS run")
    whole = "OVER (PARTITION BY kind, client, run)"
    return rows.selectExpr(*KEY, "bucket", "run", f"max(two) {whole} > {limit} AS busy", f"count(*) {whole} AS length")


def _next_openings(times: DataFrame, window_ms: int) -> DataFrame:
    """For each distinct request time of a run the first one at least a window later, ``following``, if any.

    The end of a request's window falls into the next time bucket. There the nearest request at or after it is a running
    minimum within one bucket; where that bucket has none left, the next bucket of the run begins with it.
    """
    placed = times.selectExpr(*RUN, "ts_ms", f"ts_ms div {window_ms} AS bucket", f"ts_ms % {window_ms} AS off")
    probes = placed.selectExpr(*RUN, "ts_ms", "bucket + 1 AS bucket", "off", "0 AS asked")
    both = placed.selectExpr(*RUN, "ts_ms", "bucket", "off", "1 AS asked").unionByName(probes)
    here = "OVER (PARTITION BY kind, client, run, bucket ORDER BY off DESC, asked DESC ROWS UNBOUNDED PRECEDING)"
    near = both.selectExpr("*", f"min(CASE WHEN asked = 1 THEN off END) {here} AS at").filter("asked = 0")
    buckets = both.groupBy(*RUN, "bucket").agg(F.min(F.expr("CASE WHEN asked = 1 THEN ts_ms END")).alias("first"))
    after = "OVER (PARTITION BY kind, client, run ORDER BY bucket DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    later = buckets.selectExpr(*RUN, "bucket", f"last(first, true) {after} AS later")
    return near.join(later, [*RUN, "bucket"]).selectExpr(*RUN, "ts_ms", f"coalesce(bucket * {window_ms} + at, later) AS following")


def _window_starts(pieces: Pieces, busy: DataFrame, window_ms: int) -> DataFrame:
    """Openings ``(kind, client, run, start)``: the first request of each run and all that follow from it.

    Pointer doubling: each round adds what is reached from all openings found so far and doubles the length of the
    pointers, so runs of n buckets take about log2(n) rounds for all alike, and no run is gathered anywhere. Rounds end
    when no pointer is left; each round's tables replace the ones before.
    """
    times = pieces.written(busy.select(*RUN, "ts_ms").distinct(), "times")
    found = times.groupBy(*RUN).agg(F.min("ts_ms").alias("ts_ms"))
    jumps = pieces.written(_next_openings(times, window_ms).filter("following IS NOT NULL"), "jumps-0")
    n = 0
    while not jumps.isEmpty():
        reached = found.join(jumps, [*RUN, "ts_ms"]).select(*RUN, F.col("following").alias("ts_ms"))
        found = pieces.written(found.unionByName(reached).distinct(), f"found-{n + 1}")
        onward = jumps.select(*RUN, F.col("ts_ms").alias("following"), F.col("following").alias("onward"))
        jumps = pieces.written(jumps.join(onward, [*RUN, "following"]).select(*RUN, "ts_ms", F.col("onward").alias("following")), f"jumps-{n + 1}")
        pieces.drop(f"jumps-{n}", f"found-{n}")
        n += 1
    pieces.drop(f"jumps-{n}")
    return found.withColumnRenamed("ts_ms", "start")


def rate_limit(requests: DataFrame, limits: dict[str, int] | int, window_ms: int) -> DataFrame:
    """Add ``admitted`` and ``retry_after`` (seconds) to ``requests(request_id, kind, client, ts_ms)``.

    Rejected requests neither count nor extend the window; requests without a client pass uncounted.
    Only runs of time buckets in which a window may overflow are looked at closely: there openings are found (see above),
    each request is matched to its window by time bucket and compared with the window's limit-th request. Ranks beyond
    the limit are pruned before the shuffle as long as the limit is within the planner's bound for that (1,000 unless
    set otherwise). Jobs run while the result is built.
    """
    if isinstance(limits, int):
        limit = str(limits)
    else:
        limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    top = max(limits.values()) if isinstance(limits, dict) else limits
    pieces = Pieces(requests.sparkSession, "rate")
    nobody = "client IS NULL OR client = ''"
    known = requests.filter(f"NOT ({nobody})").selectExpr("request_id", *KEY, "ts_ms", f"ts_ms div {window_ms} AS bucket")
    buckets = pieces.written(_buckets(known, window_ms, limit), "buckets")
    crowded = buckets.filter("busy").select(*KEY, "bucket", "run")
    calm = join_dimension(known, crowded.withColumn("hit", F.lit(True)), [*KEY, "bucket"]).filter("hit IS NULL")
    passed = calm.unionByName(requests.filter(nobody).select("request_id", *KEY, "ts_ms"), allowMissingColumns=True).selectExpr(
        "request_id", *KEY, "ts_ms", "true AS admitted", "CAST(NULL AS BIGINT) AS retry_after"
    )
    if crowded.isEmpty():
        return passed
    busy = pieces.written(join_dimension(known, crowded, [*KEY, "bucket"], how="inner").select("request_id", *RUN, "ts_ms", "bucket"), "busy")
    starts = _window_starts(pieces, busy, window_ms)
    # A request's window opened in its own bucket or in the one before.
    starts = starts.selectExpr(*RUN, "start", f"explode(array(start div {window_ms}, start div {window_ms} + 1)) AS bucket")
    windows = starts.groupBy(*RUN, "bucket").agg(F.expr("array_sort(collect_list(start)) AS starts"))
    rows = join_dimension(busy, windows, [*RUN, "bucket"], how="inner").selectExpr(
        "request_id", *KEY, "ts_ms", "array_max(filter(starts, s -> s <= ts_ms)) AS start"
    )
    # The limit-th request of each window; the constant rank bound is pushed below the shuffle.
    nth = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY kind, client, start ORDER BY ts_ms, request_id) AS nth"
    ).filter(f"nth <= {top}").filter(f"nth <= {limit}")
    last = nth.groupBy(*KEY, "start").agg(F.expr("max(struct(ts_ms, request_id)) AS last"))
    judged = join_dimension(rows, last, [*KEY, "start"]).selectExpr(
        "request_id", *KEY, "ts_ms", "struct(ts_ms, request_id) <= last AS admitted",
        f"CAST(greatest(1, ceil((start + {window_ms} - ts_ms) / 1000D)) AS BIGINT) AS wait",
    )
    judged = judged.selectExpr("request_id", *KEY, "ts_ms", "admitted", "CASE WHEN NOT admitted THEN wait END AS retry_after")
    return judged.unionByName(passed)


def session_cost(requests: DataFrame, gap_ms: int, allowance: int, cost: str = "1L") -> DataFrame:
    """Cost per client session; a gap of ``gap_ms`` or more starts a new session.

    Requests are first folded into buckets of one gap length: two requests of a bucket are closer than
    the gap, so they share a session. What the per-client window then sees is bounded by the log's time
    range, however many requests a client makes.
    """
    buckets = requests.groupBy("client", F.expr(f"ts_ms div {gap_ms}").alias("bucket")).agg(
        F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.sum(F.expr(cost)).alias("cost"),
        F.count("*").alias("n"),
    )
    w = "OVER (PARTITION BY client ORDER BY bucket)"
    flagged = buckets.selectExpr("*", f"CASE WHEN first - lag(last) {w} < {gap_ms} THEN 0 ELSE 1 END AS opens")
    numbered = flagged.selectExpr("*", f"sum(opens) {w} AS session_no")
    agg = numbered.groupBy("client", "session_no").agg(
        F.min("first").alias("start_ms"), F.max("last").alias("end_ms"), F.sum("n").alias("n_requests"),
        F.sum("cost").alias("cost"),
    )
    return agg.withColumn("over_allowance", F.col("cost") > allowance)
