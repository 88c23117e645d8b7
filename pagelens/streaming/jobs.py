"""Structured Streaming forms: continuous manifest, stateful rate limiting, request volume."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import RATE_WINDOW_MS
from ..sources import derived as D
from ..sources.shared import shared_folder

def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a file stream, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{table}.parquet"
    # A plain path must be a folder; a pattern is listed first and takes both.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.removesuffix("t") + "[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events")


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    root = f"{shared_folder(spark)}/pagelens/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def drained(spark: SparkSession, source: DataFrame, late: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run an append-mode query until what the source holds now is done, all of it, and read what it wrote.

    ``source`` has an event time ``ts``; ``build`` makes the query from it, with a watermark ``late`` behind. The watermark
    stays behind the last row, so results would wait for later rows. Once the source is drained, a closing row far in the
    future moves the watermark past all of them, in a second run of the same query.
    """
    out, checkpoint = _folders(spark, name)
    closing = f"{out.removesuffix('/out')}/closing"
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    spark.createDataFrame([], source.schema).write.parquet(closing)
    rows = source.unionByName(spark.readStream.schema(source.schema).parquet(closing)).withWatermark("ts", late)
    # The closing row goes behind the watermark. Filters are pushed through a watermark where they don't ask for its
    # time, and would take the closing row away before it; so every column asks for it.
    end_of_time = "TIMESTAMP'9000-01-01 00:00:00'"
    rows = rows.filter(f"ts IS NULL OR ts < {end_of_time}")
    query = build(rows.selectExpr(*("ts" if c == "ts" else f"IF(ts >= {end_of_time}, NULL, `{c}`) AS `{c}`" for c in rows.columns)))

    def run() -> None:
        query.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    run()
    fields = ", ".join(f"{end_of_time} AS ts" if f.name == "ts" else f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in source.schema)
    spark.sql(f"SELECT {fields}").write.mode("append").parquet(closing)
    run()
    return spark.read.schema(query.schema).parquet(out)


_MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"


def request_volume(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests per hour and kind; to be run in update mode, or in append mode, where an hour waits for the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("kind"))
    return agg.agg(F.count("*").alias("n")).selectExpr(f"{_MILLIS.format('w.start')} AS window_ms", "kind", "n")


def upserted(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain an update-mode query into a table of its changes and read the last state of each key, open windows included.

    Each batch replaces its own partition, so a batch that runs again counts once; the latest batch of a key wins.
    """
    spark = stream.sparkSession
    out, checkpoint = _folders(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(out)
    values = [c for c in stream.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def sessions(requests: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions per client of a watermarked stream: windows that grow with each request closer than the gap, and merge."""
    known = requests.filter("client IS NOT NULL")
    # Windows that touch are merged, so a window is one microsecond shorter than the gap.
    agg = known.groupBy(F.session_window("ts", f"{1000 * gap_ms - 1} microseconds").alias("w"), "client").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_requests"))
    return agg.selectExpr("client", f"{_MILLIS.format('first')} AS start_ms", f"{_MILLIS.format('last')} AS end_ms", "n_requests")


def sessions_once(spark: SparkSession, source: DataFrame, gap_ms: int, late: str = "1 day") -> DataFrame:
    return drained(spark, source.select("client", "ts"), late, lambda rows: sessions(rows, gap_ms), "stream-sessions")


def manifest_stream(pages: DataFrame, out: str, checkpoint: str):
    """Continuous manifest: every batch of new pages runs the batch plan.

    A page is one row, so nothing crosses batches. The batch number is part of the path, so a batch
    that is run again after a failure replaces its own output.
    """
    from ..plans.pipeline import extract_manifest

    def write(batch: DataFrame, batch_id: int) -> None:
        extract_manifest(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def manifest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table_stream(spark, sf_dir, "pages").select("page_id", "url", F.expr(D.CRAWL_HTML).alias("html"))
    out, checkpoint = _folders(spark, "stream-manifest")
    manifest_stream(pages, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


_VERDICT = T.StructType(
    [
        T.StructField("request_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("client", T.StringType()),
        T.StructField("ts_ms", T.LongType()), T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.LongType()),
    ]
)
_LONGS, _STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_PLACE = T.StructType([T.StructField("slot", T.LongType()), T.StructField("piece", T.LongType())])
_PENDING = T.StructType([T.StructField("ts_ms", _LONGS), T.StructField("ids", _LONGS), T.StructField("kinds", _STRINGS), T.StructField("clients", _STRINGS)])
_PIECES = T.StructType([T.StructField("n", T.LongType())])
_WINDOWS = T.StructType([T.StructField("kinds", _STRINGS), T.StructField("clients", _STRINGS), T.StructField("starts", _LONGS), T.StructField("counts", _LONGS)])


class Limiter(StatefulProcessor):
    """Judge of a bucket of (kind, client) pairs, each in event order whatever the order of arrival.

    Calls between Python and the state store cost more than judging a request, so clients share buckets, and calls are as
    many as pieces of input and time slots, not as clients. Requests wait in a map by time slot and piece of input; a timer
    at the end of each slot fires once the watermark has passed it, when no earlier request can come any more, and the slot
    is judged in order of time and request. What outlives a slot are the windows still open at its end: start and count of
    each client. One slot of a bucket and its open windows are in memory.
    """

    def __init__(self, limit: int, window_ms: int, slot_ms: int):
        self.limit, self.window_ms, self.slot_ms = limit, window_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _PLACE, _PENDING)
        self.pieces = handle.getValueState("pieces", _PIECES)
        self.windows = handle.getValueState("windows", _WINDOWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (n,), slots = self.pieces.get() or (0,), set()
        for piece in rows:
            for slot, part in piece.groupby(piece["ts_ms"] // self.slot_ms):
                # A new entry for each piece: what waits already is not written again.
                self.pending.updateValue((int(slot), n), tuple(part[c].tolist() for c in ("ts_ms", "request_id", "kind", "client")))
                slots.add(int(slot))
            n += 1
        self.pieces.update((n,))
        for slot in slots:
            self.handle.registerTimer((slot + 1) * self.slot_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer takes all slots that the watermark has passed, oldest first; later ones find them gone.
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[int, list[int]] = {}
        for slot, piece in self.pending.keys():
            if (slot + 1) * self.slot_ms <= now:
                due.setdefault(slot, []).append(piece)
        if not due:
            return
        kinds, clients, starts, counts = self.windows.get() or ([], [], [], [])
        windows = {(k, c): (s, n) for k, c, s, n in zip(kinds, clients, starts, counts)}
        verdicts: list[tuple] = []
        for slot in sorted(due):
            requests = []
            for piece in due[slot]:
                requests += zip(*self.pending.getValue((slot, piece)))
                self.pending.removeKey((slot, piece))
            verdicts += self.judged(sorted(requests, key=lambda r: r[:2]), windows)
            # Later requests come at the slot's end or after it, so a window that is over by then opens anew.
            end = (slot + 1) * self.slot_ms
            windows = {k: w for k, w in windows.items() if w[0] + self.window_ms > end}
            if len(verdicts) >= 10_000:
                yield self._frame(verdicts)
                verdicts = []
        if verdicts:
            yield self._frame(verdicts)
        self.windows.update(([k for k, _ in windows], [c for _, c in windows], [s for s, _ in windows.values()], [n for _, n in windows.values()]))

    def judged(self, requests: list[tuple], windows: dict[tuple, tuple[int, int]]) -> Iterator[tuple]:
        """Verdicts of requests ``(ts, id, kind, client)`` in order; ``windows`` are moved on."""
        for ts, request, kind, client in requests:
            start, count = windows.get((kind, client), (None, 0))
            if start is None or ts - start >= self.window_ms:
                start, count = ts, 0
            admitted = count < self.limit
            windows[kind, client] = start, count + admitted
            yield request, kind, client, ts, admitted, None if admitted else max(1, -(-(start + self.window_ms - ts) // 1000))

    @staticmethod
    def _frame(verdicts: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(verdicts, columns=_VERDICT.names)
        frame["retry_after"] = frame["retry_after"].astype("Int64")
        return frame

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rate_limited(requests: DataFrame, limit: int, window_ms: int = RATE_WINDOW_MS, slot_ms: int = 6 * 3_600_000, buckets: int = 1024) -> DataFrame:
    """Streaming form of ``operators.rate.rate_limit`` over ``(request_id, kind, client, ts_ms, ts)`` with a watermark on ts.

    Requests without a client pass uncounted, at once. Requests behind the watermark when they come are dropped.
    The state is kept by ``buckets`` of clients, whose number stays for the life of a checkpoint. Needs the RocksDB state store.
    """
    free = requests.filter("client IS NULL OR client = ''").selectExpr(
        "request_id", "kind", "client", "ts_ms", "true AS admitted", "CAST(NULL AS BIGINT) AS retry_after"
    )
    known = requests.filter("client IS NOT NULL AND client <> ''")
    by_bucket = known.withColumn("bucket", F.pmod(F.xxhash64("kind", "client"), F.lit(buckets))).groupBy("bucket")
    judged = by_bucket.transformWithStateInPandas(Limiter(limit, window_ms, slot_ms), _VERDICT, "Append", "eventTime")
    return judged.unionByName(free)


def rate_limit_once(spark: SparkSession, source: DataFrame, limit: int, window_ms: int, late: str = "1 day") -> DataFrame:
    """Judge what a stream of ``(request_id, kind, client, ts)`` holds now, all of it, and read the verdicts."""
    rows = source.selectExpr("CAST(request_id AS BIGINT) AS request_id", "kind", "client", "ts")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return drained(spark, rows, late, lambda r: rate_limited(r.withColumn("ts_ms", F.expr(_MILLIS.format("ts"))), limit, window_ms), "stream-rate")
    finally:
        spark.conf.set(provider, before)


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as requests; the same users as in the batch query have no client."""
    client = "CASE WHEN user_id % 50 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS client"
    return event_stream(spark, sf_dir).selectExpr("event_id AS request_id", "event_type AS kind", client, "ts")
