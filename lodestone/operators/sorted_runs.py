"""One sorted map over many partitions: runs of keys in order, and a small table of where each begins."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows of a run, as far as MOST_RUNS allows; beyond that runs grow, so that the table of fences, which tasks get whole,
#: never has more rows than this. Up to PRUNED runs are named in the filter of a lookup's scan; for more, all are read.
RUN_ROWS, MOST_RUNS, PRUNED = 1_000_000, 10_000, 1_000

#: Rows of a part: a task sorts one part, which is this many rows and one share's at most, however large the map is. A share is
#: a run and fewer keys than it has entries, or than this. Parts are asked for by number, as adaptive execution would join them.
PART_ROWS = 500_000


class SortedRuns:
    """A sorted map from ``key`` (a number, string, date or time) to ``value``, stored under ``root``.

    Of rows with equal keys the one with the largest ``order`` counts. Rows with a null or NaN key take no part. An empty map
    finds nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def create(self, df: DataFrame, key: str, value: str, order: str, run_rows: int = RUN_ROWS) -> None:
        """Writes the map. Equal keys are merged before the shuffle; runs are ranges of keys, each sorted by its own task."""
        usable = df.where(F.col(key).isNotNull())
        if dict(df.dtypes)[key] in ("float", "double"):
            usable = usable.where(~F.isnan(key))
        last = usable.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order).alias("value"))
        last.write.mode("overwrite").parquet(f"{self.root}/merged")
        last = self.spark.read.parquet(f"{self.root}/merged")
        runs = min(MOST_RUNS, last.count() // run_rows + 1)
        ranged = last.repartitionByRange(runs, "key").sortWithinPartitions("key").withColumn("run", F.spark_partition_id())
        ranged.write.mode("overwrite").partitionBy("run").parquet(f"{self.root}/runs")
        fences = self._runs().groupBy("run").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fences.withColumn("start", before).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/fences")

    def _runs(self) -> DataFrame:
        merged = self.spark.read.parquet(f"{self.root}/merged").schema
        return self.spark.read.schema(merged.add("run", IntegerType())).parquet(f"{self.root}/runs")

    def fences(self) -> DataFrame:
        """(run, first, rows, start): a run's least key, its size, and how many keys come before it."""
        return self.spark.read.parquet(f"{self.root}/fences")

    def entries(self) -> DataFrame:
        """(key, value, place): places count from 0 over the whole map, each run by itself."""
        total = self.fences().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        part = self._part_rows(total)
        known = F.broadcast(self.fences().select("run", "start", F.floor(F.col("start") / part).cast("int").alias("part")))
        parts = self._runs().join(known, "run").repartitionById(total // part + 1, "part")
        place = F.row_number().over(Window.partitionBy("part", "run").orderBy("key")) - 1
        return parts.select("key", "value", (F.col("start") + place).alias("place"))

    def _part_rows(self, total: int) -> int:
        return min(PART_ROWS, total // self.spark.sparkContext.defaultParallelism + 1)

    def find(self, asked: DataFrame, key: str) -> DataFrame:
        """asked, row for row, with (floor, value, position): the entry with the greatest key up to the one asked for, and where
        that key stands, or -(place + 1) where it would. Null and NaN keys get nulls.

        The runs that keys fall into are found in the fences; a run and the keys asked of it are sorted together, so no key
        meets more than one entry, and other runs aren't read. If more keys than entries are asked of a run, beyond a part,
        they are dealt into shares by their rows' hash, and each share meets the whole run: all shares are no more than all
        entries and twice the keys.
        """
        kind = dict(asked.dtypes)[key]
        rows = asked.select(F.struct(*asked.columns).alias("asked"), F.col(key).alias("key"))
        usable = F.col("key").isNotNull() & (~F.isnan("key") if kind in ("float", "double") else F.lit(True))
        fences = self.fences().orderBy("first").collect()  # MOST_RUNS at most
        firsts, runs = [r["first"] for r in fences], [r.run for r in fences] or [-1]

        @F.pandas_udf("int")
        def run_of(keys: pd.Series) -> pd.Series:
            return pd.Series([runs[max(bisect_right(firsts, k) - 1, 0)] for k in keys], dtype="int32")

        as_stored = self._runs().schema["key"].dataType
        good = rows.where(usable).withColumn("key", F.col("key").cast(as_stored)).withColumn("run", run_of("key"))
        needed = {r.run: r["count"] for r in good.groupBy("run").count().collect()}
        placed, total = [], 0  # where a run's shares lie if all are laid end to end, and how long each is
        for run, held, start in [(r.run, r.rows, r.start) for r in fences] or [(-1, 0, 0)]:
            if n := needed.get(run):
                shares = n // max(PART_ROWS, held) + 1
                size = held + n // shares + 1
                placed.append((run, start, shares, total, size))
                total += shares * size
        part = self._part_rows(total)
        known = F.broadcast(self.spark.createDataFrame(placed, "run int, start long, shares int, at long, size long"))
        stored = self._runs()
        if len(needed) <= PRUNED:
            stored = stored.where(F.col("run").isin(*needed) if needed else F.lit(False))
        stored = stored.join(known, "run").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        hashed = F.xxhash64("key", *(F.col("asked")[c] for c, t in asked.dtypes if "map<" not in t))
        good = good.join(known, "run", "left").withColumn("share", F.pmod(hashed, "shares").cast("int"))
        at = F.floor((F.col("at") + F.col("share") * F.col("size")) / part).cast("int").alias("part")
        both = stored.select(at, "run", "share", "key", F.struct("value").alias("held"), "start").unionByName(good.select(at, "run", "share", "key", "asked"), allowMissingColumns=True)
        both = both.repartitionById(total // part + 1, "part")
        upto = Window.partitionBy("part", "run", "share").orderBy("key", F.col("held").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        entry = F.when(F.col("held").isNotNull(), F.struct("key", "held.value", "start"))
        both = both.select("*", F.last(entry, True).over(upto).alias("last"), F.count("held").over(upto).alias("upto"))
        got = both.where("asked is not null")
        there, place = F.col("last.key") == F.col("key"), F.coalesce(F.col("last.start"), F.lit(0)) + F.col("upto")
        found = got.select("asked.*", F.col("last.key").alias("floor"), F.col("last.value").alias("value"), F.when(there, place - 1).otherwise(-place - 1).alias("position"))
        rest = rows.where(~usable).select("asked.*")
        return found.unionByName(rest, allowMissingColumns=True)
