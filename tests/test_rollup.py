"""The stored rollup against a full one after every batch, and how far changes climb."""

import random

from lodestone.operators import aggregates as agg
from lodestone.operators import rollup

LEAVES = "path string, state string, duration double"
STATES = ["skipped", "passed", "failed", "errored", "running"]


def full(spark, leaves):
    df = spark.createDataFrame([(p, *v) for p, v in leaves.items()], LEAVES)
    return sorted((r.node, r.state, round(r.duration, 4)) for r in agg.rollup_states(df).collect())


def kept(t):
    return sorted((r.node, r.state, round(r.duration, 4)) for r in t.read().collect())


def test_batches_equal_a_full_rollup(spark, tmp_path):
    rng = random.Random(4)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 3))) + f"/leaf{rng.randrange(30)}"
    leaves = {path().lstrip("/"): (rng.choice(STATES), rng.randrange(1000) / 8) for _ in range(60)}
    t = rollup.Rollup(spark, str(tmp_path / "r"), buckets=4, most_deltas=2)
    t.create(spark.createDataFrame([(p, *v) for p, v in leaves.items()], LEAVES))
    assert kept(t) == full(spark, leaves)
    for batch in range(3):
        changes = {path().lstrip("/"): (rng.choice(STATES), rng.randrange(1000) / 8) for _ in range(6)}
        gone = rng.sample(sorted(leaves), 3)
        leaves |= changes
        for p in gone:
            leaves.pop(p)
            changes[p] = (None, None)
        df = spark.createDataFrame([(p, *v) for p, v in changes.items()], LEAVES)
        assert t.update(df, "s", batch) and kept(t) == full(spark, leaves)
        assert not t.update(df, "s", batch)
    assert kept(rollup.Rollup(spark, str(tmp_path / "r"), buckets=4)) == full(spark, leaves)


def test_a_change_reads_its_own_ancestors_and_stops(spark, tmp_path):
    leaves = {f"r{i}/s{j}/t{k}": ("passed", 1.0) for i in range(8) for j in range(8) for k in range(8)}
    leaves["r0/s0/t0"] = ("failed", 1.0)
    t = rollup.Rollup(spark, str(tmp_path / "r"), buckets=8)
    t.create(spark.createDataFrame([(p, *v) for p, v in leaves.items()], LEAVES))
    one = lambda p, s, d=1.0: spark.createDataFrame([(p, s, d)], LEAVES)
    t.update(one("r0/s0/t1", "failed"), "s", 0)  # its parent has failed already
    assert t.read_rows == [1]
    t.update(one("r3/s3/t3", "failed"), "s", 1)
    assert t.read_rows == [1, 1]
    t.update(one("r3/s4/t4", "passed", 3.0), "s", 2)  # only the sums climb
    assert t.read_rows == [1, 1]
    t.update(one("r3/s4/t4", "passed", 3.0), "s", 3)  # nothing changes
    assert t.read_rows == []
    leaves |= {"r0/s0/t1": ("failed", 1.0), "r3/s3/t3": ("failed", 1.0), "r3/s4/t4": ("passed", 3.0)}
    assert kept(t) == full(spark, leaves)


def test_empty_and_odd_leaves(spark, tmp_path):
    t = rollup.Rollup(spark, str(tmp_path / "r"), buckets=2)
    t.create(spark.createDataFrame([], LEAVES))
    assert kept(t) == []
    t.update(spark.createDataFrame([("a", "passed", None), ("b/c", "failed", 2.0), ("b/c", "passed", 1.0), (None, "failed", 1.0)], LEAVES), "s", 0)
    assert kept(t) == [("a", "passed", 0.0), ("b", "failed", 3.0), ("b/c", "failed", 3.0)]
    t.update(spark.createDataFrame([("b/c", None, None), ("nowhere/x", None, None)], LEAVES), "s", 1)
    assert kept(t) == [("a", "passed", 0.0)]
