"""Interval joins by dyadic blocks against brute force, and how many rows they make."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import joins


def cut(spark, spans):
    return spark.createDataFrame(spans, "s long, e long").withColumn("b", joins.blocks(F.col("s"), F.col("e"))).collect()


def test_blocks_cover_each_place_once(spark):
    rng = random.Random(1)
    spans = [(s, s + rng.randrange(-2, 70)) for s in (rng.randrange(-100, 100) for _ in range(300))] + [(0, 0), (-1, 0), (5, 4)]
    for r in cut(spark, spans):
        held = sorted(x for b in r.b for x in range(b.no << b.level, (b.no + 1) << b.level))
        assert held == list(range(r.s, r.e + 1))


def test_long_spans_make_few_rows(spark):
    ends = [(0, 10**9), (1, 10**9 + 6), (-(10**9), 10**9), (123_456_789, 10**15 + 7), (-(2**61), 2**61)]
    for r in cut(spark, ends):
        assert sum(1 << b.level for b in r.b) == r.e - r.s + 1 and len(r.b) <= 2 * (r.e - r.s + 1).bit_length()
    assert all(len(r.b) <= 60 for r in cut(spark, ends[:3]))


@pytest.mark.parametrize("first", [False, True])
def test_innermost_against_brute_force(spark, first):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), s, s + rng.choice([0, 1, 5, 40, 10**9]), i) for i, s in enumerate(rng.randrange(-60, 60) for _ in range(120))] + [("a", None, 5, 900), ("a", 5, None, 901), (None, 0, 9, 902), ("b", 9, 3, 903)]
    points = [(i, rng.choice("abc"), rng.randrange(-70, 70)) for i in range(200)] + [(300, "a", None), (301, None, 3), (302, "b", 10**9)]
    s, p = spark.createDataFrame(spans, "g string, s long, e long, o int"), spark.createDataFrame(points, "id int, g string, pos long")
    want = set()
    for i, g, x in points:
        own = [(-(a if not first else 0), o) for h, a, e, o in spans if g is not None and g == h and None not in (x, a, e) and a <= x <= e]
        if own:
            want.add((i, min(own)[1]))
    got = joins.innermost(p, s, "g", "pos", ["id"], "s", "e", "o", first=first)
    assert got.columns == ["id", "g", "pos", "s", "e", "o"] and {(r.id, r.o) for r in got.collect()} == want


def test_deep_nesting_does_not_multiply(spark):
    """1,000 spans around 1,000 points: a point meets one span a level, not each."""
    s = spark.range(1000).select(F.lit(1).alias("g"), (-F.col("id")).alias("s"), (F.lit(10**6) + F.col("id")).alias("e"), F.col("id").alias("o"))
    p = spark.range(1000).select(F.col("id"), F.lit(1).alias("g"), F.col("id").alias("pos"))
    got = joins.innermost(p, s, "g", "pos", ["id"], "s", "e", "o")
    assert {r.s for r in got.collect()} == {0}
    best = joins._in_blocks(s, F.col("s"), F.col("e")).groupBy("g", "_level", "_no").count()
    assert joins._asking(p, "pos", best).join(best, ["g", "_level", "_no"]).count() <= 30 * 1000
    assert "sequence(0" in got._jdf.queryExecution().optimizedPlan().toString()  # of levels, not of places


def test_overlaps_and_within_against_brute_force(spark):
    rng = random.Random(3)
    made = lambda n: [(i, rng.randrange(2), s, s + rng.choice([0, 1, 3, 30, 10**9, -4])) for i, s in enumerate(rng.randrange(-50, 50) for _ in range(n))]
    a, b = made(90), made(70)
    x, y = spark.createDataFrame(a, "i int, g int, s long, e long"), spark.createDataFrame(b, "j int, g int, s2 long, e2 long")
    want = sorted((i, j, max(s, t), min(e, f)) for i, g, s, e in a for j, h, t, f in b if g == h and s < e and t < f and max(s, t) < min(e, f))
    assert sorted((r.i, r.j, r.lo, r.hi) for r in joins.overlaps(x, y, ("s", "e"), ("s2", "e2"), "g").collect()) == want
    inside = sorted((i, j) for i, g, s, _ in a for j, h, t, f in b if g == h and t <= s <= f)
    assert sorted((r.i, r.j) for r in joins.within(x, y, "g", "s", F.col("s2"), F.col("e2")).collect()) == inside


def test_only_spans_with_a_point_are_cut(spark):
    """100,000 spans, five of which hold a point: the others have no block."""
    i = F.col("id")
    spans = spark.range(100_000).select((i % 3).alias("g"), (i * 40).alias("s"), (i * 40 + 30 + i % 7).alias("e"), i.alias("o"))
    spans = spans.unionByName(spark.createDataFrame([(0, -5000, 9_000_000, -1), (1, 7, 3, -2), (1, None, 5, -3)], "g long, s long, e long, o long"))
    points = spark.createDataFrame([(1, 0, 0), (2, 1, 70), (3, 1, 71), (4, 2, 111), (5, 0, -5000), (6, 0, -5001), (7, 0, 9_000_000), (8, 2, None)], "id long, g long, pos long")
    held = joins._holding(points, spans, "g", "pos", "s", "e")
    assert sorted(r.o for r in held.collect()) == [-1, 0, 1, 2]
    got = {r.id: r.o for r in joins.innermost(points, spans, "g", "pos", ["id"], "s", "e", "o").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: -1, 7: -1}
