"""Keyed state of live streams: the last rows of each key, and changes held until their transaction ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that these processors need; a stream keeps the one it was started with."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class _Ring(StatefulProcessor):
    """The last ``n`` rows of a key, oldest first, with how many it has had, as one value: a key costs one read and one write of
    the store, as each is a call out of Python."""

    def __init__(self, key: str, order: str, value: str, n: int, types: dict[str, str], ttl_ms: int | None) -> None:
        self.key, self.order, self.value, self.n, self.types, self.ttl = key, order, value, n, types, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", f"seen long, ords array<{self.types[self.order]}>, vals array<{self.types[self.value]}>, written array<long>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (count, *before), new = self.ring.get() or (0, (), (), ()), []
        for pdf in rows:
            count += len(pdf)
            # Of a batch only its own last rows can stay; no more are held.
            new = sorted([*new, *pdf[[self.order, self.value]].itertuples(index=False, name=None)], key=lambda r: r[0])[-self.n:]
        now = 0 if self.ttl is None else timerValues.getCurrentProcessingTimeInMs()
        held = [*zip(*before), *((_plain(o), _plain(v), now) for o, v in new)][-self.n :]
        held = [h for h in held if self.ttl is None or h[2] + self.ttl > now]  # a row goes by its own age
        self.ring.update((count, *([h[i] for h in held] for i in range(3))))
        yield pd.DataFrame({
            self.key: [key[0]] * len(held), "seen": [count] * len(held), "place": range(len(held)),
            self.order: [h[0] for h in held], self.value: [h[1] for h in held],
        })

    def close(self) -> None:
        pass


#: Changes of a key that wait beside its value; more are moved to a list, which is appended to and never rewritten.
BESIDE = 256


class _Deltas(StatefulProcessor):
    """Changes of a key wait until a row ends their transaction; then they go out at once with the value they led to. The value
    and the last changes are one value of the store, so most keys cost one read and one write."""

    def __init__(self, key: str, order: str, delta: str, ends: str, types: dict[str, str], wait_ms: int | None) -> None:
        self.key, self.order, self.delta, self.ends, self.types, self.wait = key, order, delta, ends, types, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"ord {self.types[self.order]}, delta double")
        self.value = handle.getValueState("value", f"value double, listed boolean, ords array<{self.types[self.order]}>, deltas array<double>")

    def _read(self) -> tuple[float, bool, list[tuple]]:
        """The value, whether some changes wait in the list, and those that wait after them."""
        value, listed, ords, deltas = self.value.get() or (0.0, False, (), ())
        return value, listed, [*zip(ords, deltas)]

    def _write(self, value: float, listed: bool, after: list[tuple]) -> None:
        if len(after) > BESIDE:
            self.held.appendList(after)
            listed, after = True, []
        self.value.update((value, listed, [o for o, _ in after], [d for _, d in after]))

    def _out(self, key: tuple, rows: list[tuple], value: float) -> tuple[pd.DataFrame, float]:
        out = []
        for o, d in rows:
            value += d
            out.append((key[0], o, d, value))
        return pd.DataFrame(out, columns=[self.key, self.order, self.delta, "value"]), value

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(_plain(o), d, e) for pdf in rows for o, d, e in zip(pdf[self.order], pdf[self.delta], pdf[self.ends])]
        new.sort(key=lambda r: (r[0] is None, 0 if r[0] is None else r[0]))
        value, listed, after = self._read()
        after += [(o, 0.0 if pd.isna(d) else float(d)) for o, d, _ in new]
        ended = [i for i, (_, _, e) in enumerate(new) if e is True or e == True]  # noqa: E712
        if ended:
            at = len(after) - len(new) + ended[-1] + 1
            frame, value = self._out(key, [*(self.held.get() if listed else ()), *after[:at]], value)
            if listed:
                self.held.clear()
            listed, after = False, after[at:]
            yield frame
        self._write(value, listed, after)
        if self.wait is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if listed or after:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, listed, after = self._read()
        if listed or after:
            frame, value = self._out(key, [*(self.held.get() if listed else ()), *after], value)
            if listed:
                self.held.clear()
            self._write(value, False, [])
            yield frame

    def close(self) -> None:
        pass


def _plain(x):
    """A value as Python has it: pandas' own scalars and its nulls aren't known to the state store."""
    if x is None or x is pd.NaT or (isinstance(x, float) and pd.isna(x)):
        return None
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x.item() if hasattr(x, "item") else x


def _typed(types: dict[str, str], *columns: str, **more: str) -> StructType:
    return StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in ({c: types[c] for c in columns} | more).items()))


def _clock(ms: int | None) -> str:
    """A stream with a clock runs batch after batch as long as it lives, so an availableNow trigger would never end it."""
    return "None" if ms is None else "ProcessingTime"


def ring_stream(stream: DataFrame, key: str, order: str, value: str, n: int, ttl_ms: int | None = None) -> DataFrame:
    """(key, order, value, seen, place) in update mode: with each batch, the last ``n`` rows of every key it touched, oldest
    first, and how many rows the key has had. Rows of a batch are ordered by ``order``; a later batch comes after. State holds
    ``n`` rows a key and goes ``ttl_ms`` after its last write. A null key is a key."""
    types = dict(stream.dtypes)
    out = _typed(types, key, order, value, seen="long", place="int")
    return stream.select(key, order, value).groupBy(key).transformWithStateInPandas(_Ring(key, order, value, n, types, ttl_ms), out, "Update", _clock(ttl_ms))


def delta_stream(stream: DataFrame, key: str, order: str, delta: str, ends: str, wait_ms: int | None = None) -> DataFrame:
    """(key, order, delta, value): every change once its transaction has ended, that is, with the next row of its key in which ``ends``
    is true, or ``wait_ms`` after the key's last row. ``value`` is the running sum. Null deltas count as 0."""
    types = dict(stream.dtypes)
    out = _typed(types, key, order, **{delta: "double", "value": "double"})
    return stream.select(key, order, delta, ends).groupBy(key).transformWithStateInPandas(_Deltas(key, order, delta, ends, types, wait_ms), out, "Append", _clock(wait_ms))
