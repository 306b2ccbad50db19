"""Tables that hold chunks, vectors and graphs."""

from __future__ import annotations

import json
import posixpath
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sparse_map

DOC_TYPES = ("code_chunk", "git_commit", "doc_chunk")


def doc_type(c: Column) -> Column:
    """Unknown types are code."""
    return F.when(c.isin(*DOC_TYPES[1:]), c).otherwise(DOC_TYPES[0])


def store_path(base: str, name: str, old_hash: str, exists) -> str:
    """The store's folder: by name, else by its old hash if that exists, else by name again."""
    named, hashed = posixpath.join(base, name), posixpath.join(base, old_hash)
    return named if exists(named) or not exists(hashed) else hashed


def local_records(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.coalesce("file_path", F.lit("unknown")).alias("file_path"), doc_type(F.col("doc_type")).alias("doc_type"), "text_content", F.to_json("metadata").alias("metadata"), "embedding")


def remote_records(chunks: DataFrame) -> DataFrame:
    """Dense and sparse vectors of each chunk."""
    sparse = sparse_map(chunks, "chunk_id", "text_content").withColumnRenamed("sparse", "sparse_vector")
    return local_records(chunks).withColumnRenamed("embedding", "dense_vector").join(sparse, "chunk_id")


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by doc_type, so that a route reads only its part."""
    records.write.mode(mode).partitionBy("doc_type").parquet(path)


def dual_write(records: DataFrame, remote: str, local: str | None) -> None:
    """Both sinks from one computation of the rows."""
    records = records.persist()
    try:
        write_records(records, remote, "append")
        if local:
            write_records(records, local, "append")
    finally:
        records.unpersist()


class DualStore:
    """Records in two sinks, or one, batch by batch. A batch counts in a sink once its record is there, which is written after its
    files; a batch that is sent again writes only where the record is missing, from the sink that has it if there is one."""

    def __init__(self, spark: SparkSession, remote: str, local: str | None = None) -> None:
        self.spark, self.sinks = spark, [s for s in (remote, local) if s]

    def _has(self, sink: str) -> DataFrame:
        """(batch_key) of the batches that count."""
        try:
            return self.spark.read.schema("batch_key string").json(f"{sink}/log/*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "batch_key string")
            raise

    def _files(self, sink: str, key: str) -> str:
        return f"{sink}/data/batch_key={key}"

    def write(self, records: DataFrame, stream: str, batch: int) -> list[str]:
        """The sinks that were written."""
        key = f"{stream}-{batch}"
        done = [s for s in self.sinks if not self._has(s).where(F.col("batch_key") == key).isEmpty()]
        missing = [s for s in self.sinks if s not in done]
        for sink in missing:
            rows = self.spark.read.schema(records.schema).parquet(self._files(done[0], key)) if done else records
            write_records(rows.select(*records.columns), self._files(sink, key))
            self._record(sink, key)
            done.append(sink)
        return missing

    def _record(self, sink: str, key: str) -> None:
        self.spark.createDataFrame([(key,)], "batch_key string").coalesce(1).write.mode("overwrite").json(f"{sink}/log/{key}")

    def read(self, sink: int = 0, route: str = "all") -> DataFrame:
        """The records of the batches that count; a route reads its own part of each."""
        path = self.sinks[sink]
        df = self.spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").join(F.broadcast(self._has(path)), "batch_key", "left_semi").drop("batch_key")
        return df if route == "all" else df.where(F.col("doc_type") == route)


def read_records(spark: SparkSession, path: str, route: str = "all") -> DataFrame:
    df = spark.read.parquet(path)
    return df if route == "all" else df.where(F.col("doc_type") == route)


class JsonStore:
    """A JSON object of strings in one small file. Changes wait for flush(), or until the oldest is ``delay`` seconds old and
    another comes; ``now`` writes at once."""

    def __init__(self, spark: SparkSession, path: str, delay: float = 0.1) -> None:
        self.spark, self.path, self.delay, self.since = spark, path, delay, None
        try:
            rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).collect()
            self.values: dict[str, str] = dict(rows[0].m or {}) if rows else {}
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self.values = {}

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key, default)

    def set(self, key: str, value: str | None, now: bool = False) -> None:
        """A null value deletes the key."""
        if value is None:
            self.values.pop(key, None)
        else:
            self.values[key] = value
        self.since = self.since or time.monotonic()
        if now or time.monotonic() - self.since >= self.delay:
            self.flush()

    def flush(self) -> None:
        if self.since is not None:
            self.spark.createDataFrame([(json.dumps(self.values),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
            self.since = None


def replace_files(table: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """table without the rows of files (file), plus new."""
    return table.join(files.select("file").distinct(), "file", "left_anti").unionByName(new)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
