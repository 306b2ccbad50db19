"""The graph index: recall and products, updates against what is left, odd vectors, cells and parts."""

import pathlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph_index as gi
from lodestone.operators import ranking

VECTORS = "chunk_id string, v array<float>"


def exact(x, q, k=10):
    return np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]


def recall(found, best):
    return np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(found.tolist(), best.tolist())])


def clustered(rng, n, dims=32, centres=60):
    c = rng.normal(size=(centres, dims))
    return gi.matrix((c[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, dims))).tolist(), dims)


@pytest.mark.parametrize("kind", ["random", "clustered", "copies"])
def test_shard_finds_near_ones_with_few_products(kind):
    rng = np.random.default_rng(1)
    x = gi.matrix(rng.normal(size=(6000, 32)).tolist(), 32) if kind == "random" else clustered(rng, 6000)
    if kind == "copies":
        x[:2000] = x[0]  # a third of all rows
    s, q = gi.Shard.build([str(i) for i in range(len(x))], x), x[2000::40]
    at, score = s.search(q, 10)
    best = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    assert np.mean(score >= best[:, -1:] - 1e-5) >= 0.9 and s.products < 0.15 * len(q) * len(x)
    assert all(len({i for i in row if i >= 0}) == (row >= 0).sum() for row in at)


def test_updates_equal_a_rebuild_in_recall():
    rng = np.random.default_rng(2)
    x = clustered(rng, 3000)
    ids = [str(i) for i in range(len(x))]
    s = gi.Shard.build(ids[:2000], x[:2000])
    for lo in range(2000, 2400, 100):
        s = s.update(ids[lo : lo + 100], x[lo : lo + 100], {str(i) for i in range(lo - 2000, lo - 1950)})
    assert s.dead.any()  # the graph went on, it wasn't built anew
    live = [i for i, d in zip(s.ids, s.dead) if not d]
    assert sorted(live, key=int) == [str(i) for i in [*(i for i in range(2000) if not (i < 400 and i % 100 < 50)), *range(2000, 2400)]]
    left = x[[int(i) for i in live]]
    q = left[::20]
    best = exact(left, q)
    one = recall(np.vectorize(lambda n: live.index(s.ids[n]))(s.search(q, 10)[0]), best)
    two = recall(gi.Shard.build(live, left).search(q, 10)[0], best)
    assert one >= 0.9 and one > two - 0.03
    # Many changes at once build it anew, without waypoints.
    assert not s.update(ids[2400:], x[2400:], set()).dead.any()
    moved = s.update(["5"], x[2999:], set())
    assert sum(i == "5" and not d for i, d in zip(moved.ids, moved.dead)) == 1 and moved.ids[int(moved.search(x[2999:], 1)[0][0, 0])] == "5"


def test_small_and_empty_shards():
    none = gi.Shard.build([], np.zeros((0, 4), np.float32))
    assert (none.search(np.ones((2, 4), np.float32), 3)[0] == -1).all()
    one = none.update(["a"], gi.matrix([[1, 0, 0, 0]], 4), set())
    assert one.search(gi.matrix([[1, 1, 0, 0]], 4), 3)[0].tolist() == [[0, -1, -1]]
    assert (one.update([], np.zeros((0, 4), np.float32), {"a"}).search(np.ones((1, 4), np.float32), 1)[0] == -1).all()


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 2.0]), ("c", None), ("d", []), ("e", [float("nan"), 1.0]), ("f", [1.0, None]), ("g", [0.0, 0.0, 0.0]), (None, [1.0]), ("b", [0.0, 2.0]), ("h", [float("inf"), 1.0])]
    v = spark.createDataFrame(rows, VECTORS).withColumn("cell", F.lit("x")).withColumn("shard", F.lit("y"))
    q = spark.createDataFrame([(1, [5.0, 1.0]), (2, None), (3, []), (4, [0.0, 1.0, 0.0, 9.0]), (5, [float("nan")])], "query_id int, q array<float>")
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 5)) for r in ranking.ann_top_k(q, v, 2).collect()}
    assert got == {(1, 1): ("a", round(5 / 26**0.5, 5)), (1, 2): ("b", round(1 / 26**0.5, 5)), (4, 1): ("b", 1.0), (4, 2): ("a", 0.0)}
    assert ranking.ann_top_k(q, v.limit(0), 2).count() == 0 == ranking.ann_top_k(q.limit(0), v, 2).count()


def test_saved_index_over_cells_and_parts(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = clustered(rng, 2000, 16, 12)
    x[:700] = x[0]
    v = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], VECTORS)
    index = gi.GraphIndex(spark, str(tmp_path / "ix"))
    index.create(v, shard_rows=200)
    sizes = [len(r.ids) for r in index.shards.read().select("ids").collect()]
    assert sum(sizes) == 2000 and len(sizes) >= 10 and max(sizes) < 400  # the cell of the copies is dealt into parts
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(700, 2000, 13)], "query_id int, q array<float>")
    best = {int(i): set(b) for i, b in zip(range(700, 2000, 13), exact(x, x[700::13]).tolist())}
    found = index.search(q, 10).collect()
    assert sum(int(r.chunk_id) in best[r.query_id] for r in found) >= 0.9 * 10 * len(best)
    before = {p for p in pathlib.Path(tmp_path / "ix").rglob("*.parquet")}
    far = (-x[900]).tolist()
    assert index.update(spark.createDataFrame([("new", far), ("950", far), ("none", None)], VECTORS), spark.createDataFrame([("951",), ("nowhere",)], "chunk_id string"), "s", 1)
    wrote = {p for p in pathlib.Path(tmp_path / "ix").rglob("*.parquet")} - before
    assert len({p.parent.name for p in wrote if "/rows/" in str(p)}) <= 4  # the cells of what came and went
    assert not index.update(spark.createDataFrame([("other", far)], VECTORS), None, "s", 1)
    again = gi.GraphIndex(spark, str(tmp_path / "ix"))
    near = [r.chunk_id for r in again.search(spark.createDataFrame([(1, far)], "query_id int, q array<float>"), 2).orderBy("rank").collect()]
    ids = [r.chunk_id for r in again.nodes().collect()]
    assert sorted(near) == ["950", "new"] and len(ids) == len(set(ids)) == 2000 and "951" not in ids and "none" not in ids and "other" not in ids


def test_an_index_tunes_itself_until_it_finds_nine_tenths(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = gi.matrix(rng.normal(size=(4000, 64)).tolist(), 64)  # no direction is nearer than others: neighbours lie in all cells
    v = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], VECTORS)
    index = gi.GraphIndex(spark, str(tmp_path / "ix"))
    index.create(v, shard_rows=150)
    own = range(0, 4000, 20)
    best = {i: set(b) for i, b in zip(own, exact(x, x[::20]).tolist())}
    q = spark.createDataFrame([(i, x[i].tolist()) for i in own], "query_id int, q array<float>")
    share = lambda **how: sum(int(r.chunk_id) in best[r.query_id] for r in index.search(q, 10, **how).collect()) / (10 * len(best))
    assert share(probes=gi.PROBES, frontier=gi.FRONTIER) < 0.9 <= share()


def test_links_are_made_in_bounded_memory():
    x = gi.matrix(np.random.default_rng(6).normal(size=(8000, 64)), 64)
    tracemalloc.start()
    gi.link(x, gi.LINKS)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_a_search_gives_a_task_one_shard_at_a_time(spark, tmp_path, monkeypatch):
    x = clustered(np.random.default_rng(7), 1200, 16, 12)
    v = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], VECTORS)
    index = gi.GraphIndex(spark, str(tmp_path / "ix"))
    index.create(v, shard_rows=300)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "query_id int, q array<float>")
    whole = {(r.query_id, r["rank"]): r.chunk_id for r in index.search(q, 5, probes=4, frontier=32).collect()}
    monkeypatch.setattr(gi, "TASK_QUERIES", 100)
    monkeypatch.setattr(gi, "TILE", 7)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in index.search(q, 5, probes=4, frontier=32).collect()} == whole and len(whole) == 6000
    assert "FlatMapCoGroups" in index.search(q, 5)._jdf.queryExecution().executedPlan().toString()
