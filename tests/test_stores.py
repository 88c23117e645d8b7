"""The image-prefix source and the manifest store."""

import os

import pytest

from pagelens.operators import enrich as E
from pagelens.sources.image_files import PrefixReader, image_prefixes
from pagelens.sources.manifest_store import part_of, read_manifest, write_batch


@pytest.fixture
def images(tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000012C000000C8")
    for name, content in {"a/one.png": png + b"x" * 10_000, "a/two.png": png, "b/three.gif": bytes.fromhex("47494638396105000600"), "b/empty.bin": b"", "_hidden": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "b/huge.png", "wb") as file:  # far larger than memory, of which 64 bytes are read
        file.write(png)
        file.truncate(1 << 40)
    return tmp_path


def test_prefixes_read_no_more_than_asked_for(spark, images):
    rows = image_prefixes(spark, str(images), 64, files_per_task=2)
    got = {os.path.relpath(r.path, images): (r.length, bytes(r.content)) for r in rows.collect()}
    assert {k: (n, len(c)) for k, (n, c) in got.items()} == {"a/one.png": (10_024, 64), "a/two.png": (24, 24), "b/three.gif": (10, 10), "b/empty.bin": (0, 0), "b/huge.png": (1 << 40, 64)}
    assert rows.rdd.getNumPartitions() == 3
    dims = {os.path.basename(r.path): (r.dims.state, r.dims.w, r.dims.h) for r in E.measure_prefixes(rows).collect()}
    assert dims["huge.png"] == ("known", 300, 200) and dims["three.gif"] == ("known", 5, 6) and dims["empty.bin"][0] == "failed"
    assert image_prefixes(spark, str(images / "a"), 8).filter("path LIKE '%one%'").count() == 1


def test_path_filters_reach_the_listing(spark, images):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = PrefixReader({"path": str(images)})
    assert list(reader.pushFilters([StringStartsWith(("path",), f"{images}/a/"), GreaterThan(("length",), 3), EqualTo(("path",), f"{images}/a/two.png")])) == [GreaterThan(("length",), 3)]
    assert [p.paths for p in reader.partitions()] == [[f"{images}/a/two.png"]]
    rows = image_prefixes(spark, str(images), 64).filter(f"startswith(path, '{images}/b/')")
    assert rows.count() == 3


SCHEMA = "page_id bigint, images string"


def test_batches_are_read_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"i{i}") for i in range(300)], SCHEMA)
    write_batch(rows, folder, "day1")
    write_batch(rows.filter("page_id < 100"), folder, "day2")
    for _ in range(2):
        write_batch(rows.filter("page_id >= 100 AND page_id < 110"), folder, "day2")
    got = read_manifest(spark, folder, SCHEMA)
    assert sorted((r.batch, r.page_id) for r in got.collect()) == [("day1", i) for i in range(300)] + [("day2", i) for i in range(100, 110)]
    assert [tuple(r) for r in read_manifest(spark, folder, SCHEMA, ["day2"], page=104).select("page_id", "images").collect()] == [(104, "i104")]


def test_unfinished_batches_are_not_read_and_others_pruned(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"i{i}") for i in range(50)], SCHEMA)
    write_batch(rows, folder, "good")
    rows.selectExpr("*", "'bad' AS batch", f"{part_of('page_id')} AS part").write.mode("append").partitionBy("batch", "part").parquet(f"{folder}/data")
    assert read_manifest(spark, folder, SCHEMA).count() == 50
    one = read_manifest(spark, folder, SCHEMA, ["good"], page=7)
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "images" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "batch" in filters and "part" in filters
    assert one.count() == 1
