"""A table of rows by key that is kept up to date by writing only what changed.

Rows lie in hash buckets of their key. A version adds two small sets of files: the rows that came (a delta) and the
keys whose older rows no longer count (tombstones). A reader merges the files that its version has: a row counts if no
tombstone of its key is newer. Buckets that have gathered many deltas are compacted into a new base, one bucket
at a time, so what a batch writes grows with the batch and not with the table. A version exists once its
record is in the log, which is written last; files without a record are written over by the next try.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_RECORD = "version int, stream string, batch long, kind string, rows array<int>, gone array<int>, form string"


@dataclass
class Staged:
    """Files that wait for their record: buckets with rows and with tombstones."""

    version: int
    rows: list[int]
    gone: list[int]


class LogTable:
    """``key`` names the column by which rows are replaced; ``buckets`` is fixed when the table is made; a bucket with
    more than ``most_deltas`` deltas is compacted by compact()."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64, most_deltas: int = 8) -> None:
        self.spark, self.root, self.key, self.buckets, self.most_deltas = spark, root, key, buckets, most_deltas

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def log(self, version: int | None = None) -> list:
        """The records up to a version, in order: a row for each version, so it stays on the driver."""
        try:
            records = self.spark.read.schema(_RECORD).json(f"{self.root}/log/*").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((r for r in records if version is None or r.version <= version), key=lambda r: r.version)

    def version(self) -> int | None:
        return max((r.version for r in self.log()), default=None)

    def knows(self, stream: str, batch: int) -> bool:
        return any(r.stream == stream and r.batch == batch and r.kind == "batch" for r in self.log())

    def _put(self, df: DataFrame, what: str, version: int) -> list[int]:
        """Writes rows by bucket; the buckets that have any. A bucket with very many rows is written by several tasks."""
        path = f"{self.root}/{what}/v={version}"
        df.withColumn("bucket", self.bucket(F.col(self.key))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            return sorted(r.bucket for r in self.spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect())
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return []
            raise

    def stage(self, version: int, rows: DataFrame, gone: DataFrame | None = None) -> Staged:
        """Writes a version's rows, and the keys (a column ``key``) whose older rows they replace or that are removed."""
        return Staged(version, self._put(rows, "rows", version), [] if gone is None else self._put(gone.select(self.key).distinct(), "gone", version))

    def commit(self, staged: Staged, stream: str, batch: int, kind: str = "batch", form: str | None = None) -> None:
        record = (staged.version, stream, batch, kind, staged.rows, staged.gone, form)
        self.spark.createDataFrame([record], _RECORD).coalesce(1).write.mode("overwrite").json(f"{self.root}/log/v={staged.version}")

    def create(self, rows: DataFrame, stream: str = "build", batch: int = -1) -> None:
        """Version 0: every bucket's base."""
        self.stage(0, rows)
        self.commit(Staged(0, list(range(self.buckets)), []), stream, batch, "base", rows.schema.json())

    def files(self, version: int | None = None) -> tuple[dict[int, int], dict[int, list[int]], dict[int, list[int]]]:
        """By bucket: the version of its base, and those of its deltas' rows and tombstones since."""
        base, rows, gone = {}, {b: [] for b in range(self.buckets)}, {b: [] for b in range(self.buckets)}
        for r in self.log(version):
            if r.kind in ("base", "compact"):
                for b in r.rows:
                    base[b], rows[b], gone[b] = r.version, [], []
            else:
                for b in r.rows:
                    rows[b].append(r.version)
                for b in r.gone:
                    gone[b].append(r.version)
        return base, rows, gone

    def _load(self, what: str, form: StructType, versions: dict[int, list[int]]) -> DataFrame:
        """The files of (bucket, version) with the column v. A version all of whose buckets are wanted is read as one folder."""
        form = StructType([*form.fields]).add("v", "integer").add("bucket", "integer")
        by_version: dict[int, list[int]] = {}
        for b, vs in versions.items():
            for v in vs:
                by_version.setdefault(v, []).append(b)
        if not by_version:
            return self.spark.createDataFrame([], form)
        df = self.spark.read.schema(form).parquet(f"{self.root}/{what}")
        wanted = None
        for v, buckets in sorted(by_version.items()):
            one = F.col("v") == v if len(buckets) == self.buckets else (F.col("v") == v) & F.col("bucket").isin(buckets)
            wanted = one if wanted is None else wanted | one
        return df.where(wanted)

    def read(self, version: int | None = None, keys: list | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last, if none is named); with ``keys`` or ``buckets`` only those, from their files alone."""
        log = self.log(version)
        form = StructType.fromJson(json.loads(log[0].form))
        base, rows, gone = self.files(version)
        if keys is not None:
            buckets = sorted({r[0] for r in self.spark.createDataFrame([(k,) for k in keys], StructType([form[self.key]])).select(self.bucket(F.col(self.key))).collect()})
        only = range(self.buckets) if buckets is None else buckets
        own = self._load("rows", form, {b: [base[b], *rows[b]] for b in only if b in base})
        dead = {b: gone[b] for b in only if gone[b]}
        if dead:
            last = self._load("gone", StructType([form[self.key]]), dead).groupBy(F.col(self.key).alias("_key")).agg(F.max("v").alias("_gone"))
            own = own.join(last, own[self.key].eqNullSafe(F.col("_key")), "left").where("_gone is null or v >= _gone").drop("_key", "_gone")
        if keys is not None:
            own = own.where(F.col(self.key).isin(keys))
        return own.select(*(F.col(f"`{c}`") for c in form.names))

    def compact(self) -> list[int]:
        """Rewrites the buckets that have too many deltas, as one version; the buckets."""
        _, rows, gone = self.files()
        full = [b for b in range(self.buckets) if max(len(rows[b]), len(gone[b])) > self.most_deltas]
        if full:
            version = self.version() + 1
            self.stage(version, self.read(buckets=full))
            self.commit(Staged(version, full, []), "compact", version, "compact")
        return full

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes files that none of the last ``keep`` versions reads; their paths."""
        versions = [r.version for r in self.log()]
        live = set()
        for v in versions[-keep:]:
            base, rows, gone = self.files(v)
            live |= {("rows", b, x) for b in base for x in (base[b], *rows[b])} | {("gone", b, x) for b in gone for x in gone[b]}
        dead = []
        fs = None
        for r in self.log():
            for what, buckets in (("rows", r.rows), ("gone", r.gone)):
                for b in buckets:
                    if (what, b, r.version) not in live:
                        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}/v={r.version}/bucket={b}")
                        fs = fs or path.getFileSystem(self.spark._jsc.hadoopConfiguration())
                        if fs.delete(path, True):
                            dead.append(f"{what}/v={r.version}/bucket={b}")
        return dead
