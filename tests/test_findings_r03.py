"""Faults found on larger tables and odd layouts."""

import os

import pandas as pd

from pagelens.plans import registry
from pagelens.sources.image_files import image_prefixes, write_image_archives
from pagelens.streaming import jobs as S


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://a.example/{i}", "<html><head></head><article></article></html>") for i in (4, 8)], "page_id bigint, url string, html string")
    pages.repartition(2).write.parquet(str(tmp_path / "folder/pages.parquet"))
    got = S.manifest_once(spark, str(tmp_path / "folder"))
    assert {r.page_id for r in got.select("page_id").distinct().collect()} == {4, 8}
    assert S.manifest_once(spark, "/root/testdata/sf0.001").select("page_id").distinct().count() > 2


def test_image_archives_are_few_and_read_like_files(spark, tmp_path):
    rows = spark.range(0, 4100, 1, 2).selectExpr("concat(id, '.png') AS name", "CAST(concat(unhex('89504E470D0A1A0A'), CAST(repeat(' ', CAST(id AS INT)) AS BINARY)) AS BINARY) AS content")
    folder = str(tmp_path / "images")
    write_image_archives(rows, folder, per_archive=1000)
    (tmp_path / "images/_7-0").write_bytes(b"an archive that was not finished")
    assert len(os.listdir(folder)) == 7 and sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 4100 * 300
    got = image_prefixes(spark, folder, 64, archives=True)
    assert got.rdd.getNumPartitions() == 6
    found = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content)) for r in got.collect()}
    assert found == {f"{i}.png": (8 + i, (bytes.fromhex("89504E470D0A1A0A") + b" " * i)[:64]) for i in range(4100)}
    write_image_archives(rows, folder, per_archive=1000)
    assert got.count() == 4100
    assert [r.length for r in got.filter("path LIKE '%/4099.png'").collect()] == [4107]


class Store:
    """State of one bucket in memory, counting calls."""

    def __init__(self):
        self.calls, self.map, self.values, self.timers = 0, {}, {}, set()

    def getMapState(self, name, key, value):
        return self

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = value

        return Value()

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def keys(self):
        return list(self.map)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_limiter_calls_the_state_by_slots_not_by_clients():
    """Many clients in two pieces; a window that is open over the end of a slot, and over two firings of timers."""
    store, judge = Store(), S.Limiter(1, 1300, 600)
    judge.init(store)
    clients = [str(i) for i in range(3000)]
    piece = lambda ts, first: pd.DataFrame({"request_id": range(first, first + 3000), "kind": "scan", "client": clients, "ts_ms": ts})
    assert list(judge.handleInputRows((0,), iter([piece(100, 0), piece(50, 3000), piece(700, 6000)]), store)) == []
    store.watermark = 1200
    first = pd.concat(judge.handleExpiredTimer((0,), store, None))
    assert list(judge.handleExpiredTimer((0,), store, None)) == [] and not store.map
    list(judge.handleInputRows((0,), iter([piece(1349, 9000), piece(1400, 12000)]), store))
    store.watermark = 1800
    second = pd.concat(judge.handleExpiredTimer((0,), store, None))
    got = pd.concat([first, second]).set_index("request_id")
    assert len(got) == 15000 and got["admitted"].to_dict() == {i: 3000 <= i < 6000 or i >= 12000 for i in range(15000)}
    assert got.loc[0, "retry_after"] == 2 and got.loc[12000, "retry_after"] is pd.NA
    assert store.calls < 50 and set(store.values["windows"][2]) == {1400}


def test_manifest_has_tasks_and_buckets_as_pages_ask_for(spark, tmp_path, monkeypatch):
    """Windows over the table have a task a bucket, each bucket is one file, and their number follows the pages."""
    monkeypatch.setattr(registry, "PAGES_PER_BUCKET", 5)
    html = "<html><head></head><article></article></html>"
    spark.createDataFrame([(i, f"https://a.example/{i}", html) for i in range(62)], "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    table = registry.man(spark, str(tmp_path))
    files = [os.path.basename(f) for f in table.inputFiles()]
    assert len(files) <= 13 == registry.buckets(spark, str(tmp_path)) and len({f.split("_")[1] for f in files}) == len(files)
    per_page = table.groupBy("page_id").count()
    assert per_page.rdd.getNumPartitions() == 13 and per_page.filter("count > 5").count() == 62 - len([i for i in range(62) if i % 11 == 3])
