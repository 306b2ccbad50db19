"""A sorted map in runs against one on the driver, and which runs a lookup reads."""

import random
import re
from bisect import bisect_left, bisect_right

import pytest

from lodestone.operators import sorted_runs
from lodestone.operators.sorted_runs import SortedRuns


def made(spark, path, entries, run_rows, kind="long"):
    m = SortedRuns(spark, str(path))
    m.create(spark.createDataFrame(entries, f"k {kind}, v string, at int"), "k", "v", "at", run_rows)
    return m


def test_lookups_equal_a_sorted_list(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(2000), f"v{i}", i) for i in range(1500)] + [(None, "none", 0)]
    kept = {k: v for k, v, _ in rows if k is not None}
    keys = sorted(kept)
    m = made(spark, tmp_path / "m", rows, 100)
    assert m.fences().count() > 5
    assert [(r["key"], r.value, r.place) for r in m.entries().orderBy("place").collect()] == [(k, kept[k], i) for i, k in enumerate(keys)]
    asked = [(i, x) for i, x in enumerate([-5, 0, 5000, None, 7, 7, *(rng.randrange(-10, 2010) for _ in range(300))])]
    got = {r.id: r for r in m.find(spark.createDataFrame(asked, "id int, key long"), "key").collect()}
    assert len(got) == len(asked)
    for i, x in asked:
        r = got[i]
        assert r["key"] == x
        if x is None:
            assert (r.floor, r.value, r.position) == (None, None, None)
            continue
        at = bisect_right(keys, x) - 1
        floor = keys[at] if at >= 0 else None
        assert (r.floor, r.value, r.position) == (floor, kept.get(floor), at if floor == x else -bisect_left(keys, x) - 1)


def test_only_the_runs_needed_are_read(spark, tmp_path):
    m = made(spark, tmp_path / "m", [(i, str(i), 0) for i in range(5000)], 100)
    assert m.fences().count() > 20
    found = m.find(spark.createDataFrame([(17,), (18,)], "x long"), "x")
    assert [(r.x, r.floor) for r in found.orderBy("x").collect()] == [(17, 17), (18, 18)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run#\d+ = \d+", plan) or re.search(r"run#\d+ IN \(\d+\)", plan)
    assert not re.search("CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("kind,rows,x,want", [
    ("string", [("b", "1", 0), ("d", "2", 0)], "c", ("b", "1", -2)),
    ("double", [(1.5, "1", 0), (float("nan"), "2", 0)], float("nan"), (None, None, None)),
    ("long", [], 4, (None, None, -1)),
    ("long", [(4, None, 0), (4, None, 0)], 4, (4, None, 0)),
])
def test_kinds_and_odd_maps(spark, tmp_path, kind, rows, x, want):
    m = made(spark, tmp_path / "m", rows, 10, kind)
    r = m.find(spark.createDataFrame([(x,)], f"floor_of {kind}"), "floor_of").first()
    assert (r.floor, r.value, r.position) == want


def sizes(df):
    return [len(p) for p in df.rdd.glom().collect()]


def test_runs_are_sorted_in_parts_that_are_not_joined_again(spark, tmp_path):
    m = made(spark, tmp_path / "m", [(i, str(i), 0) for i in range(5000)], 100)
    cores = spark.sparkContext.defaultParallelism
    assert max(sizes(m.entries())) < 2 * 5000 / cores
    found = m.find(spark.range(3000).selectExpr("id as x"), "x")
    assert found.count() == 3000 and found.where("floor <> x or value <> x or position <> x").count() == 0
    assert max(sizes(found)) < 2 * 3000 / cores
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 and len(re.findall(r"\bWindow \[", plan)) == 1 and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("entries", [0, 300])
def test_keys_of_one_run_are_dealt_into_shares(spark, tmp_path, monkeypatch, entries):
    monkeypatch.setattr(sorted_runs, "PART_ROWS", 500, raising=False)
    m = made(spark, tmp_path / "m", [(i, str(i), 0) for i in range(entries)], 100)
    asked = spark.range(10_000).selectExpr("id", "id % 7 + 300 as x", "map(id, 'm') as m")  # all beyond the last entry
    found = m.find(asked, "x")
    want = (299, "299", -301) if entries else (None, None, -1)
    assert {(r.floor, r.value, r.position) for r in found.collect()} == {want}
    assert sorted(r.id for r in found.select("id").collect()) == list(range(10_000))
    assert max(sizes(found)) < 2000
