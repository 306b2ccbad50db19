"""Change streams: coalescing, quiet gaps, throttles, buffers, incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.log_table import LogTable, Staged
from ..sources.stores import replace_files


def coalesce(changes: DataFrame, path: str = "path", kind: str = "type") -> DataFrame:
    """(path, type) of a batch: once deleted, a path stays deleted."""
    return changes.groupBy(path).agg(F.when(F.bool_or(F.col(kind) == "deleted"), "deleted").otherwise("updated").alias(kind))


def debounce(df: DataFrame, ts: str, gap: str, *aggs: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, end, ...): what came without a quiet gap, as one row, by key or over the whole stream. A gap of exactly the
    length doesn't part."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)
    return out.withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w")


def watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as TIMESTAMP with a watermark (a watermark can't stand on TIMESTAMP_NTZ)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def throttle_times(times: list[float], delay: float) -> list[tuple[float, int]]:
    """(emitted at, events folded): the first at once, then at most one for each delay with what came meanwhile."""
    out: list[tuple[float, int]] = []
    until, held = None, 0
    for t in times:
        while until is not None and t >= until:
            if held:
                out.append((until, held))
                until, held = until + delay, 0
            else:
                until = None
        if until is None:
            out.append((t, 1))
            until = t + delay
        else:
            held += 1
    return out + ([(until, held)] if held else [])


def anchored_times(times: list[float], delay: float) -> list[tuple[float, int]]:
    """(emitted at, events): a buffer that is emptied ``delay`` after its first event."""
    out: list[tuple[float, int]] = []
    for t in times:
        if out and t < out[-1][0]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((t + delay, 1))
    return out


def _by_key(f: Callable[[list[float], float], list[tuple[float, int]]], df: DataFrame, key: str, ts: str, delay: float) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = f(sorted(pdf["_t"].tolist()), delay)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), "at": [r[0] for r in rows], "n": [r[1] for r in rows]})

    return df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_t")).withColumn("_t", F.col("_t") / 1e6).groupBy(key).applyInPandas(run, f"{key} {kind}, at double, n long")


def throttle(df: DataFrame, key: str, ts: str, delay: float) -> DataFrame:
    """A recorded stream as a throttle would emit it, in seconds."""
    return _by_key(throttle_times, df, key, ts, delay)


def buffer_from_first(df: DataFrame, key: str, ts: str, delay: float) -> DataFrame:
    return _by_key(anchored_times, df, key, ts, delay)


def buffer_stream(stream: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """A live stream of (key, value string), a row per key and ``delay_ms`` from its first event: values joined, nulls left out."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "data": [held], "n": [n]})
            return
        for pdf in batches:
            held, n = held + "".join(pdf["value"].dropna()), n + len(pdf)
        if not state.exists:
            state.setTimeoutDuration(delay_ms)
        state.update((held, n))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, data string, n long", "held string, n long", "append", "ProcessingTimeTimeout")


def throttle_stream(stream: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """A live stream of (key, value double) throttled by key: (key, total, n). What comes first goes out at once, then at most one
    row a ``delay_ms`` with the sum of what came meanwhile. Null values count and add nothing."""

    def row(k: tuple, total: float, n: int) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "total": [float(total)], "n": [n]})

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            total, n = state.get
            if n:
                state.update((0.0, 0))
                state.setTimeoutDuration(delay_ms)
                yield row(k, total, n)
            else:
                state.remove()
            return
        new = pd.concat(list(batches))["value"]
        if state.exists:
            total, n = state.get
            state.update((total + float(new.sum()), n + len(new)))
            state.setTimeoutDuration(delay_ms)
        else:
            state.update((0.0, 0))
            state.setTimeoutDuration(delay_ms)
            yield row(k, new.sum(), len(new))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, total double, n long", "total double, n long", "append", "ProcessingTimeTimeout")


def ring(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key, oldest first in ``place``."""
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy(F.desc(order)))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).withColumn("place", F.row_number().over(w.orderBy(F.desc("_rn"))) - 1).drop("_rn")


def heartbeat(df: DataFrame, ts: str, every: str = "15 minutes") -> DataFrame:
    return df.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def apply_changes(chunks: DataFrame, changes: DataFrame, new: DataFrame) -> DataFrame:
    """An index after a batch: chunks of changed files go, chunks of updated ones come."""
    batch = coalesce(changes, "file")
    return replace_files(chunks, new.join(batch.where("type = 'updated'"), "file", "left_semi"), batch)


class IndexSync:
    """An index kept up to date by a change stream, as a log by file (see LogTable): a batch writes its own chunks and
    tombstones, whatever the index holds.

    A version is recorded with its stream and batch number: readers always see a whole version, a batch that is run again is
    known and does nothing, and a stream with a new checkpoint goes on from the current version, whatever its numbers. What a
    crash left unrecorded is written over.

    ``chunk`` gives (file, ..., chunk columns) of files (file, text); with a column ``ok`` it may say that a file failed: its old chunks
    stay, and the file waits in the version's dead-letter table until the next batch tries it again.
    """

    _FAILED = "file string, text string"

    def __init__(self, spark: SparkSession, root: str, chunk: Callable[[DataFrame], DataFrame], active: Callable[[], bool] = lambda: True, **how) -> None:
        self.spark, self.root, self.chunk, self.active = spark, root, chunk, active
        self.table = LogTable(spark, f"{root}/chunks", "file", **how)
        self.events: list[tuple[str, int]] = []

    def version(self) -> int | None:
        return self.table.version()

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def failed(self, version: int | None = None) -> DataFrame:
        """(file, text): the dead letters, those of the last batch up to a version."""
        last = [r.version for r in self.table.log(version) if r.kind != "compact"][-1]
        return self.spark.read.schema(self._FAILED).parquet(f"{self.root}/failed/v{last}")

    def build(self, chunks: DataFrame) -> None:
        self.spark.createDataFrame([], self._FAILED).write.mode("overwrite").parquet(f"{self.root}/failed/v0")
        self.table.create(chunks)
        self.events.append(("complete", 0))

    def _point(self, staged: Staged, stream: str, batch: int) -> None:
        self.table.commit(staged, stream, batch)

    def on_batch(self, changes: DataFrame, batch_id: int) -> None:
        """For foreachBatch: changes (file, type, text), with ``seq`` where a file may be updated more than once in a batch: the
        update with the largest counts."""
        base = self.version()
        if not self.active() or base is None:
            return
        stream = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        if self.table.knows(stream, batch_id):
            return
        changes = changes.persist()
        try:
            order = F.col("seq") if "seq" in changes.columns else F.lit(0)
            last = changes.where("type = 'updated'").groupBy("file").agg(F.max_by("text", order).alias("text"))
            batch = coalesce(changes.select("file", "type"), "file")
            again = self.failed(base).join(batch, "file", "left_anti")
            tried = last.join(batch.where("type = 'updated'"), "file", "left_semi").unionByName(again)
            new = self.chunk(tried)
            bad = new.where("not ok").select("file").distinct() if "ok" in new.columns else self.spark.createDataFrame([], "file string")
            done = batch.select("file").unionByName(again.select("file")).join(bad, "file", "left_anti")
            good = new.where("ok").drop("ok") if "ok" in new.columns else new
            tried.join(bad, "file", "left_semi").write.mode("overwrite").parquet(f"{self.root}/failed/v{base + 1}")
            staged = self.table.stage(base + 1, good.join(bad, "file", "left_anti"), done)
        finally:
            changes.unpersist()
        self._point(staged, stream, batch_id)
        self.table.compact()
        self.events.append(("incrementalSync", base + 1))


class IndexEvents(StreamingQueryListener):
    """A stream's life as index events: progress with the batch, then complete, or error with what was thrown."""

    def __init__(self) -> None:
        self.events: list[tuple[str, object]] = []

    def onQueryStarted(self, event) -> None:
        self.events.append(("started", event.name))

    def onQueryProgress(self, event) -> None:
        self.events.append(("progress", event.progress.batchId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.events.append(("error", event.exception) if event.exception else ("complete", None))


def retry_failed(files: DataFrame, parse: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of parse (file, ok, ...); files that failed are given to ``again``."""
    first = parse(files)
    failed = files.join(first.where("not ok").select("file"), "file", "left_semi")
    return first.where("ok").unionByName(again(failed))


def reduce_scopes(df: DataFrame, scope: str, value: str) -> DataFrame:
    """Events in a scope fold to one sum; those outside any stand alone."""
    inside = df.where(F.col(scope).isNotNull()).groupBy(scope).agg(F.sum(value).alias(value))
    return inside.unionByName(df.where(F.col(scope).isNull()).select(scope, value))


def replay(log: DataFrame, after: int) -> DataFrame:
    """What a sink that is attached late still has to get, in order."""
    return log.where(F.col("seq") > after).orderBy("seq")


def deltas(versions: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """(key, version, value, delta) for each changed version of a value."""
    w = Window.partitionBy(key).orderBy(version)
    d = versions.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
    return d.where("delta <> 0")


def wait_for(query, holds: Callable[[], bool], seconds: float = 30) -> bool:
    """Waits, while a streaming query runs, until a condition holds or time is up; a failed query raises."""
    import time

    end = time.time() + seconds
    while time.time() < end and not holds():
        if query.exception():
            raise query.exception()
        time.sleep(0.2)
    return holds()


def serve_while_loading(read_new: Callable[[], DataFrame], old: DataFrame) -> DataFrame:
    """The new table once it can be read, until then the old one."""
    try:
        return read_new()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return old
        raise
