"""The commit log data source: ranges, pushed filters, streams; and the timeline table function."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import timeline
from lodestone.sources import commit_log, files


def written(path, n, rng, first=0, mode="w"):
    """A log of n records, some odd; what it holds."""
    want = []
    with open(path, mode, newline="") as f:
        for i in range(first, first + n):
            end, name = rng.choice(["\n", "\r\n"]), "" if i % 17 == 5 else f"h{i}"
            message = rng.choice(["fix | it", "", "COMMIT|inner", "é漢😀", "x" * 300])
            f.write(f"COMMIT|{name}|a{i % 3}|2024-{i % 12 + 1:02d}-01|{message}{end}")
            own = []
            for k in range(rng.randrange(4)):
                added = rng.choice(["-", "3", "99999999999"])
                f.write(f"{added}\t{k}\tsrc/{i}\t{k}.py{end}")
                own.append((f"src/{i}\t{k}.py", 3 if added == "3" else 0, k))
            f.write(rng.choice(["", end, f"no detail{end}"]))
            if name:
                want.append((name, f"a{i % 3}", f"2024-{i % 12 + 1:02d}-01", message, tuple(own)))
    return want


def rows(df):
    return sorted((r.hash, r.author, r.date, r.message, tuple(map(tuple, r.files))) for r in df.collect())


@pytest.mark.parametrize("split", [1, 37, 1000, 10**9])
def test_ranges_give_each_record_once(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(commit_log, "READ", 64)
    rng = random.Random(1)
    want = written(tmp_path / "a.log", 40, rng) + written(tmp_path / "b.log", 3, rng, 100)
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "none.log").write_text("no records\nhere")
    (tmp_path / "_SUCCESS").write_text("COMMIT|no|a|b|c")
    parts = [p for path, size in commit_log.logs(str(tmp_path)) for p in commit_log._ranges(path, 0, size, split)]
    got = [(r["hash"], r["author"], r["date"], r["message"], tuple(tuple(f.values()) for f in r["files"])) for p in parts for r in commit_log.records(p)]
    assert sorted(got) == sorted(want)


def test_one_large_log_is_read_by_several_tasks(spark, tmp_path):
    commit_log.register(spark)
    want = written(tmp_path / "large.log", 3000, random.Random(2)) + written(tmp_path / "small.log", 2, random.Random(3), 5000)
    df = spark.read.format("commitlog").option("splitBytes", 20_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10 and rows(df) == sorted(want)
    by_file = files.read_git_log(spark, str(tmp_path))  # the same through Spark's text source
    assert sorted(r.hash for r in by_file.select("hash").collect()) == sorted(w[0] for w in want)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("commitlog").load(str(tmp_path / "nowhere")).collect()


def test_filters_are_pushed(spark, tmp_path):
    commit_log.register(spark)
    want = written(tmp_path / "a.log", 200, random.Random(4))
    load = lambda push: spark.read.format("commitlog").option("splitBytes", 3000).option("pushFilters", push).load(str(tmp_path / "a.log"))
    plain = load("false")
    for where, holds in (
        ("date >= '2024-06' and author = 'a1'", lambda w: w[2] >= "2024-06" and w[1] == "a1"),
        ("hash in ('h1', 'h7', 'none')", lambda w: w[0] in ("h1", "h7")),
        ("hash like 'h1%' and size(files) > 1", lambda w: w[0].startswith("h1") and len(w[4]) > 1),
        ("message = 'é漢😀' or date < '2024-02'", lambda w: w[3] == "é漢😀" or w[2] < "2024-02"),
    ):
        assert rows(load("true").where(where)) == rows(plain.where(where)) == sorted(w for w in want if holds(w))
    plan = load("true").where("date >= '2024-06' and author = 'a1'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)  # the reader does all of it
    reader = commit_log.FilteringReader(str(tmp_path), 100)
    odd = [commit_log.EqualTo(("files",), 1), commit_log.EqualTo(("hash",), 5)]
    assert list(reader.pushFilters([*odd, commit_log.EqualTo(("hash",), "h3")])) == odd and len(reader.keep) == 1


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    commit_log.register(spark)
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def drain():
        stream = spark.readStream.format("commitlog").option("splitBytes", 500).load(str(src))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    want = written(src / "a.log", 30, random.Random(5))
    drain()
    want += written(src / "a.log", 20, random.Random(6), 100, "a") + written(src / "b.log", 5, random.Random(7), 200)
    with open(src / "b.log", "a") as f:
        f.write("COMMIT|half|a|2024-01-01|not")  # its line has no end yet
    drain()
    assert rows(spark.read.parquet(out)) == sorted(want)
    with open(src / "b.log", "a") as f:
        f.write(" ended\n1\t2\tp\n")
    drain()
    drain()
    assert rows(spark.read.parquet(out)) == sorted([*want, ("half", "a", "2024-01-01", "not ended", (("p", 1, 2),))])


def test_timeline_pages(spark):
    timeline.register(spark)
    at = lambda d: datetime.datetime(2024, 1, d) if d else None
    data = [("u", at(3), "b", 1), ("u", at(3), "a", 2), ("u", at(3), "a", 3), ("u", at(5), "z", 4), ("u", at(1), "q", 5), ("u", None, "n", 6), ("v", at(2), None, 7), (None, at(2), "x", 8)]
    items = spark.createDataFrame([(*r, "more") for r in data], "uri string, ts timestamp_ntz, source string, item int, label string")
    page = lambda n, ts, s: sorted((r.uri or "", r.place, r.item) for r in spark.sql(f"SELECT * FROM timeline(TABLE({{items}}), {n}, {ts}, {s})", items=items).collect())
    assert page("NULL", "NULL", "NULL") == [("", 1, 8), ("u", 1, 4), ("u", 2, 1), ("u", 3, 3), ("u", 4, 2), ("u", 5, 5), ("u", 6, 6), ("v", 1, 7)]
    assert page(2, "TIMESTAMP_NTZ'2024-01-03'", "'b'") == [("", 1, 8), ("u", 1, 3), ("u", 2, 2), ("v", 1, 7)]
    assert page(0, "NULL", "NULL") == [] and set(spark.sql("SELECT * FROM timeline(TABLE({items}), 1, NULL, NULL)", items=items).columns) == {*items.columns, "place"}
    assert spark.sql("SELECT * FROM timeline(TABLE({items}), 1, NULL, NULL)", items=items.limit(0)).count() == 0
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM timeline(TABLE({items}), 1, NULL, NULL)", items=items.drop("ts")).collect()


def test_a_large_log_is_written_in_parts(spark, tmp_path):
    """One log of 5,000 records: no task sorts or holds it all, on the way out or back in."""
    n = F.col("id")
    lines = spark.range(15000).select(F.lit(0).alias("log"), n.alias("line_no"), F.when(n % 3 == 0, F.format_string("COMMIT|h%d|a|d|m|n\r", n)).otherwise(F.format_string("%d\t2\tp%d\tq\r", n % 3, n)).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_log(lines, str(tmp_path / "out"), F.floor(F.col("line_no") / 3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("log=0/*.txt"))
    assert len(parts) > 1 and max(p.stat().st_size for p in parts) < sum(p.stat().st_size for p in parts) / 2
    got = files.read_git_log(spark, str(tmp_path / "out"))
    rows = got.collect()
    assert {r.hash for r in rows} == {f"h{i}" for i in range(0, 15000, 3)} and len(rows) == 5000
    assert all(r.message == "m|n" and [(f.path, f.added) for f in r.files] == [(f"p{int(r.hash[1:]) + i}\tq", i) for i in (1, 2)] for r in rows)


def test_text_before_the_first_header(spark, tmp_path):
    (tmp_path / "a.log").write_text("warning: shallow|x\n1\t2\tno\nCOMMIT|h1|a|d|m\n3\t4\tp")
    (tmp_path / "b.log").write_text("nothing here")
    (tmp_path / "c.log").write_text("COMMIT|h2")
    got = sorted((r.hash, r.author, r.message, len(r.files)) for r in files.read_git_log(spark, str(tmp_path)).collect())
    assert got == [("h1", "a", "m", 1), ("h2", None, "", 0)]
