"""Two sinks that stay alike through crashes, and ignore files as a table."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, stores

ROWS = "chunk_id string, doc_type string, n int"


def both(store):
    return [sorted((r.chunk_id, r.doc_type, r.n) for r in store.read(k).collect()) for k in range(2)]


@pytest.mark.parametrize("when", ["files of the first", "record of the first", "files of the second"])
def test_sinks_after_a_crash(spark, tmp_path, when, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    store = stores.DualStore(spark, str(tmp_path / "r"), str(tmp_path / "l"))
    assert store.write(rows(("a", "code_chunk", 1), ("b", "doc_chunk", 2)), "s", 0) == store.sinks
    left = {"files of the first": 0, "record of the first": 1, "files of the second": 1}[when]
    real = stores.DualStore._record

    def record(self, sink, key):
        if sink == self.sinks[left] and when != "record of the first":
            raise RuntimeError("crash")
        real(self, sink, key)
        if when == "record of the first":
            raise RuntimeError("crash")

    monkeypatch.setattr(stores.DualStore, "_record", record)
    with pytest.raises(RuntimeError):
        store.write(rows(("c", "code_chunk", 3)), "s", 1)
    monkeypatch.setattr(stores.DualStore, "_record", real)
    # Rows that come out otherwise when they are made again don't part the sinks.
    store.write(rows(("c", "code_chunk", 4)), "s", 1)
    one, two = both(store)
    assert one == two == [("a", "code_chunk", 1), ("b", "doc_chunk", 2), ("c", "code_chunk", 3 if left else 4)]
    assert store.write(rows(("z", "code_chunk", 9)), "s", 1) == [] and both(store) == [one, two]
    assert [r.chunk_id for r in store.read(1, "doc_chunk").collect()] == ["b"]
    assert store.write(rows(("d", "code_chunk", 5)), "other", 1) == store.sinks and len(both(store)[0]) == 4


def test_ignore_table_against_the_rules_in_a_row(spark):
    rng = random.Random(1)
    names = ["a", "b", "out", "x.log", "y.tmp", "keep.log", "z"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(300)})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, folder int")
    patterns = ["*.log", "!keep.log", "out/", "/a", "b/*.tmp", "!b/y.tmp", "**/z", "a/**", "x.*", "# no", "", "!/out", "z", "?.log"]
    for _ in range(3):
        rules = {"": rng.sample(patterns, 5)} | {f: rng.sample(patterns, 3) for f in rng.sample(["a", "b", "out", "a/b", "a/out/b"], 3)}
        table = spark.createDataFrame([(f, "\n".join(x)) for f, x in rules.items()], "folder string, text string")
        want = files.drop_ignored(df, sorted(rules.items(), key=lambda r: (r[0].count("/") + bool(r[0]), r[0])))
        assert sorted(map(tuple, files.drop_ignored_by(df, table).collect())) == sorted(map(tuple, want.collect()))
    assert files.drop_ignored_by(df, table.limit(0)).count() == len(paths)
    assert files.drop_ignored_by(spark.createDataFrame([(None,)], "path string"), table).count() == 1


def test_thousands_of_ignore_files(spark):
    """Each folder has its own; the plan knows nothing of their number."""
    n = 3000
    df = spark.range(n).select(F.explode(F.array(*(F.format_string(t, "id") for t in ("d%1$d/skip%1$d.txt", "d%1$d/keep.txt", "d%1$d/sub/f%1$d.log")))).alias("path"))
    table = spark.range(n).select(F.format_string("d%d", "id").alias("folder"), F.format_string("skip%1$d.txt\nsub/", "id").alias("text"))
    kept = files.drop_ignored_by(df, table)
    assert {r.path for r in kept.collect()} == {f"d{i}/keep.txt" for i in range(n)}
    size = lambda t: len(files.drop_ignored_by(df, t)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(table) - size(table.limit(1))) < 2000
