"""Keyed state over live streams: against batch results, through restarts, timers and odd rows."""

import time
import uuid

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog, streams_catalog
from lodestone.streaming import changes, state

RING = "k string, at long, v double"
ROWS = [[("a", 1, 1.0), ("a", 2, None), ("b", 1, 5.0), (None, 9, 9.0)], [("a", 4, 4.0), ("a", 3, 3.0)], [("b", 2, 6.0), ("a", 5, 5.0), (None, 10, 8.0)]]


def run(spark, tmp_path, schema, batches, make, mode, pick=lambda df, i: None):
    """One start of the stream for each batch of rows: state has to come back from the checkpoint."""
    out = []

    def keep(df, i):
        out.extend((i, *r) for r in df.collect())

    at = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        with state.state_store(spark):
            q = make(stream).writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return out


def test_ring_survives_restarts(spark, tmp_path):
    out = run(spark, tmp_path, RING, ROWS, lambda s: state.ring_stream(s, "k", "at", "v", 3), "update")
    last = {}
    for batch, k, at, v, seen, place in out:
        last.setdefault(k, {}).setdefault(batch, []).append((place, at, v, seen))
    got = {k: sorted(b[max(b)]) for k, b in last.items()}
    assert got == {
        "a": [(0, 3, 3.0, 5), (1, 4, 4.0, 5), (2, 5, 5.0, 5)],
        "b": [(0, 1, 5.0, 2), (1, 2, 6.0, 2)],
        None: [(0, 9, 9.0, 2), (1, 10, 8.0, 2)],
    }


def test_ring_holds_a_bounded_number_of_rows(spark, tmp_path):
    out = run(spark, tmp_path, RING, [[("a", i, float(i)) for i in range(5000)], [("a", 5000, 1.0)]], lambda s: state.ring_stream(s, "k", "at", "v", 2), "update")
    assert [r[1:] for r in out] == [("a", 4998, 4998.0, 5000, 0), ("a", 4999, 4999.0, 5000, 1), ("a", 4999, 4999.0, 5001, 0), ("a", 5000, 1.0, 5001, 1)]


def test_deltas_go_out_once_when_their_transaction_ends(spark, tmp_path):
    rows = [[("a", 1, 1.0, False), ("b", 1, 7.0, True), ("a", 2, 2.0, False)], [("a", 4, 10.0, False), ("a", 3, None, True)], [("a", 5, 0.5, True), ("c", 1, 1.0, False), ("c", 2, 1.0, None)]]
    out = run(spark, tmp_path, "k string, at long, d double, e boolean", rows, lambda s: state.delta_stream(s, "k", "at", "d", "e"), "append")
    assert sorted(r[1:] for r in out) == [("a", 1, 1.0, 1.0), ("a", 2, 2.0, 3.0), ("a", 3, 0.0, 3.0), ("a", 4, 10.0, 13.0), ("a", 5, 0.5, 13.5), ("b", 1, 7.0, 7.0)]
    assert {r[0] for r in out if r[1:3] == ("a", 4)} == {2}


def test_a_transaction_that_never_ends_goes_out_after_its_wait(spark, tmp_path):
    schema, at, out = "k string, at long, d double, e boolean", str(tmp_path), []
    spark.createDataFrame([("a", 1, 1.0, False), ("a", 2, 2.0, False)], schema).coalesce(1).write.parquet(f"{at}/in")
    stream = state.delta_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), "k", "at", "d", "e", 2000)
    with state.state_store(spark):
        q = stream.writeStream.foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", f"{at}/log").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not out and not q.exception():
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(out) == [("a", 1, 1.0, 1.0), ("a", 2, 2.0, 3.0)]


@pytest.mark.parametrize("name", ["live_ring", "live_deltas"])
def test_a_part_of_a_stream_is_no_result(spark, sf_dir, tmp_path, monkeypatch, name):
    """Time that is up after the first batch, as it may be with a large table."""

    def is_up(q, holds, seconds=30):
        while q.isActive and not any(tmp_path.glob("*/out/b=0/_SUCCESS")):
            time.sleep(0.02)
        return holds()

    monkeypatch.setattr(streams_catalog, "scratch", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    monkeypatch.setattr(changes, "wait_for", is_up)
    got = catalog.QUERIES[name](spark, sf_dir).select("user_id", "event_id").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
        want = con.execute(f"SELECT user_id, event_id FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_stream_that_fails_is_no_result(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i,)], "i long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    bad = F.when(F.col("i") == 1, F.raise_error(F.lit("odd row"))).cast("string")
    with pytest.raises(Exception, match="odd row"):
        streams_catalog._each_batch(spark, stream.withColumn("x", bad), "failing", "append")


class Store:
    """A state store in memory that counts calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def getValueState(self, name, *_):
        return Cell(self, name, None)

    getListState = getValueState

    def getMapState(self, name, *_):
        raise AssertionError("a call for each slot")


class Cell:
    def __init__(self, store, name, _):
        self.store, self.name = store, name

    def _call(self):
        self.store.calls += 1
        return self.store.values

    def exists(self):
        return self.name in self._call()

    def get(self):
        return self._call().get(self.name)

    def update(self, value):
        self._call()[self.name] = value

    def appendList(self, rows):
        self._call().setdefault(self.name, []).extend(rows)

    def clear(self):
        self._call().pop(self.name, None)


def test_a_key_costs_one_read_and_one_write(monkeypatch):
    ring, deltas, types = Store(), Store(), {"at": "long", "v": "double", "d": "double"}
    r, d = state._Ring("k", "at", "v", 5, types, None), state._Deltas("k", "at", "d", "e", types, None)
    r.init(ring)
    d.init(deltas)
    for i in range(3):
        list(r.handleInputRows(("a",), iter([pd.DataFrame({"at": range(i * 9, i * 9 + 9), "v": 1.0})]), None))
        list(d.handleInputRows(("a",), iter([pd.DataFrame({"at": range(i * 9, i * 9 + 9), "d": 1.0, "e": [False] * 4 + [True] + [False] * 4})]), None))
    assert ring.calls == deltas.calls == 6
    monkeypatch.setattr(state, "BESIDE", 2)  # many changes move to the list, and come back before those beside the value
    long, out = state._Deltas("k", "at", "d", "e", types, None), []
    long.init(store := Store())
    for i in range(4):
        out += list(long.handleInputRows(("a",), iter([pd.DataFrame({"at": range(i * 2, i * 2 + 2), "d": [1.0, 2.0], "e": [False, i == 3]})]), None))
    assert [tuple(x) for x in out[0].itertuples(index=False)] == [("a", i, 1.0 + i % 2, float(i // 2 * 3 + 1 + i % 2 * 2)) for i in range(8)] and "held" not in store.values
