"""The log-structured table: what is read, what is written, crashes, compaction, removal of old files."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources.log_table import LogTable
from lodestone.streaming import changes


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "file string, n int")


def files(root, what, version):
    return [p for p in pathlib.Path(root).glob(f"{what}/v={version}/bucket=*/*.parquet")]


def test_batches_equal_a_plain_replacement(spark, tmp_path):
    rng, t = random.Random(1), LogTable(spark, str(tmp_path / "t"), "file", buckets=4, most_deltas=2)
    now = {f"f{i}": [i] for i in range(40)}
    t.create(rows_of(spark, [(f, n) for f, ns in now.items() for n in ns]))
    states, compacted = [dict(now)], []
    for v in range(1, 6):
        new = {f"f{rng.randrange(50)}": [rng.randrange(99) for _ in range(rng.randrange(3))] for _ in range(6)}
        now |= new
        at = t.version() + 1
        t.commit(t.stage(at, rows_of(spark, [(f, n) for f, ns in new.items() for n in ns]), rows_of(spark, [(f, 0) for f in new])), "s", v)
        compacted += t.compact()
        assert sorted(map(tuple, t.read().collect())) == sorted((f, n) for f, ns in now.items() for n in ns)
        states.append(dict(now))
    assert compacted
    some = ["f1", "f7", "nowhere"]
    assert sorted(map(tuple, t.read(keys=some).collect())) == sorted((f, n) for f in some for n in now.get(f, []))
    assert sorted(map(tuple, t.read(0).collect())) == sorted((f, n) for f, ns in states[0].items() for n in ns)
    before = sorted(map(tuple, t.read().collect()))
    assert t.vacuum() and sorted(map(tuple, t.read().collect())) == before and t.vacuum() == []


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), "file", buckets=16)
    t.create(spark.range(1000).select(F.concat(F.lit("f"), "id").alias("file"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("n")))
    staged = t.stage(1, rows_of(spark, [("f7", 1), ("f7", 2)]), rows_of(spark, [("f7", 0)]))
    t.commit(staged, "s", 0)
    base, one = (sum(p.stat().st_size for p in files(tmp_path / "t", "rows", v)) for v in (0, 1))
    assert len(staged.rows) == len(staged.gone) == len(files(tmp_path / "t", "rows", 1)) == 1 and one < base / 10
    assert t.read().count() == 999 * 20 + 2 and sorted(r.n for r in t.read(keys=["f7"]).collect()) == [1, 2]
    # A key is read from its own bucket's files: the scan's partition filters name it.
    scans = [x for x in t.read(keys=["f7"])._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x]
    assert scans and all("PartitionFilters: [" in x and "bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


@pytest.mark.parametrize("when", ["before the record", "after the record"])
def test_crashes(spark, tmp_path, when):
    t = LogTable(spark, str(tmp_path / "t"), "file", buckets=4)
    t.create(rows_of(spark, [("a", 1), ("b", 2), (None, 3)]))
    staged = t.stage(1, rows_of(spark, [("a", 9)]), rows_of(spark, [("a", 0)]))
    if when == "after the record":
        t.commit(staged, "s", 5)
        assert t.knows("s", 5) and not t.knows("other", 5)
    again = LogTable(spark, str(tmp_path / "t"), "file", buckets=4)
    seen = {(r.file, r.n) for r in again.read().collect()}
    assert seen == ({("a", 1), ("b", 2), (None, 3)} if when == "before the record" else {("a", 9), ("b", 2), (None, 3)})
    again.commit(again.stage(again.version() + 1, rows_of(spark, [("b", 7)]), rows_of(spark, [("b", 0), (None, 0)])), "s", 6)
    assert {(r.file, r.n) for r in again.read().collect()} == {("a", 1 if when == "before the record" else 9), ("b", 7)}


def test_empty_tables(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), "file", buckets=4)
    assert t.version() is None
    t.create(rows_of(spark, []))
    assert t.read().collect() == [] and t.read().columns == ["file", "n"]
    t.commit(t.stage(1, rows_of(spark, []), rows_of(spark, [("x", 0)])), "s", 0)
    assert t.read().collect() == []


def test_index_sync_writes_one_file_of_many(spark, tmp_path):
    sync = changes.IndexSync(spark, str(tmp_path / "ix"), lambda f: f.select("file", F.explode(F.split("text", ";")).alias("chunk")))
    sync.build(spark.range(1000).select(F.col("id").cast("string").alias("file"), F.lit("x").alias("chunk")))
    sync.on_batch(spark.createDataFrame([("5", "updated", "a;b")], "file string, type string, text string"), 0)
    assert len(files(tmp_path / "ix" / "chunks", "rows", 1)) == 1 and sync.read().count() == 1001
