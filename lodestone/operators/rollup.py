"""A rollup of states that is kept up to date: counts of children by state, changed from the leaves upwards.

Every node above the leaves holds how many children it has in each state. A change of a leaf is a delta for its
parent: one child less in the old state, one more in the new. A parent whose own state stays hands on nothing but the
change of its sum. Nodes lie in a log by bucket, so a batch reads the buckets of the nodes it climbs through and
writes those nodes alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.log_table import LogTable
from .aggregates import STATE_PRIORITY

#: States from the highest priority down; of equal ones the first by name.
ORDER = tuple(sorted(STATE_PRIORITY, key=lambda s: (-STATE_PRIORITY[s], s)))
_NODE = "node string, parent string, depth int, state string, total decimal(38,6), counts map<string,bigint>"


def state_of(counts: Column) -> Column:
    """The state of highest priority that any child has."""
    return F.coalesce(*(F.when(F.coalesce(counts[s], F.lit(0)) > 0, s) for s in ORDER))


def _counts(state: str = "state", n: str = "n") -> Column:
    """Of rows (state, n): how many children have each state, without zeros."""
    return F.map_filter(F.map_from_entries(F.collect_list(F.struct(F.col(state), F.col(n)))), lambda k, v: v != 0)


class Rollup:
    """Stored nodes of paths such as ``a/b/c``. A leaf isn't above another leaf; states are those of STATE_PRIORITY."""

    def __init__(self, spark: SparkSession, root: str, sep: str = "/", **how) -> None:
        self.spark, self.sep = spark, sep
        self.table = LogTable(spark, root, "node", **how)
        self.read_rows: list[int] = []

    def _leaves(self, leaves: DataFrame) -> DataFrame:
        """leaves (path, state, duration) as nodes; of rows that share a path the one of highest priority, with the sum of all."""
        parts = F.split("path", self.sep)
        parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), self.sep))
        rank = reduce(lambda c, s: c.when(F.col("state") == s, ORDER.index(s)), ORDER[1:], F.when(F.col("state") == ORDER[0], 0))
        one = leaves.where("path is not null").groupBy("path").agg(F.min_by("state", rank).alias("state"), F.sum(F.col("duration").cast("decimal(30,6)")).cast("decimal(38,6)").alias("total"))
        return one.select(F.col("path").alias("node"), parent.alias("parent"), F.size(parts).alias("depth"), "state", F.coalesce("total", F.lit(0)).cast("decimal(38,6)").alias("total"), F.lit(None).cast("map<string,bigint>").alias("counts"))

    def create(self, leaves: DataFrame) -> None:
        """All nodes, level by level from the deepest."""
        own = self._leaves(leaves)
        own.write.parquet(at := scratch(self.spark, "leaves"))
        own = self.spark.read.schema(_NODE).parquet(at)
        deepest = own.agg(F.max("depth")).first()[0] or 0
        levels, below = [own], own.limit(0)
        for depth in range(deepest - 1, 0, -1):
            children = below.unionByName(own.where(F.col("depth") == depth + 1))
            sums = children.groupBy("parent", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
            below = self._parents(sums.groupBy("parent").agg(_counts().alias("counts"), F.sum("total").cast("decimal(38,6)").alias("total")), depth)
            levels.append(below)
        self.table.create(reduce(DataFrame.unionByName, levels))

    def _parents(self, df: DataFrame, depth: int) -> DataFrame:
        parts = F.split("node", self.sep)
        above = F.when(F.lit(depth) > 1, F.array_join(F.slice(parts, 1, depth - 1), self.sep))
        return df.withColumnRenamed("parent", "node").select("node", above.alias("parent"), F.lit(depth).alias("depth"), state_of(F.col("counts")).alias("state"), "total", "counts")

    def read(self) -> DataFrame:
        """(node, state, duration), those above the leaves and the leaves."""
        return self.table.read().select("node", "state", F.col("total").cast("double").alias("duration"))

    def _stored(self, nodes: DataFrame) -> DataFrame:
        """The stored rows of nodes, from their buckets alone."""
        buckets = [r[0] for r in nodes.select(self.table.bucket(F.col("node")).alias("b")).distinct().collect()]  # as many as the table has, at most
        return self.table.read(buckets=buckets).join(nodes.select("node").distinct(), "node", "left_semi")

    def update(self, changes: DataFrame, stream: str, batch: int) -> bool:
        """Leaves (path, state, duration) that are new or changed; a null state removes the leaf. A known batch does nothing.

        ``read_rows`` gets the number of stored nodes that each level looked up.
        """
        if self.table.knows(stream, batch):
            return False
        at = scratch(self.spark, "climb")
        new = self._leaves(changes)
        old = self._stored(new).select("node", F.col("state").alias("was"), F.col("total").alias("had"))
        moved = new.join(old, "node", "left").select(*new.columns, "was", F.coalesce("had", F.lit(0)).cast("decimal(38,6)").alias("had"))
        moved = moved.withColumn("total", F.when(F.col("state").isNotNull(), F.col("total")).otherwise(F.lit(0)).cast("decimal(38,6)"))
        moved = moved.where(~F.col("state").eqNullSafe(F.col("was")) | (F.col("total") != F.col("had")))
        moved.write.parquet(f"{at}/leaves")
        moved = self.spark.read.parquet(f"{at}/leaves")
        deepest = moved.agg(F.max("depth")).first()[0] or 0
        self.read_rows, levels, below = [], [moved], moved.limit(0)
        for depth in range(deepest - 1, 0, -1):
            children = below.unionByName(moved.where(F.col("depth") == depth + 1))
            change = F.explode(F.array(F.struct(F.col("was").alias("state"), F.lit(-1).alias("n")), F.struct(F.col("state"), F.lit(1).alias("n")))).alias("c")
            steps = children.where(~F.col("state").eqNullSafe(F.col("was"))).select("parent", change).select("parent", "c.*").where("state is not null")
            steps = steps.groupBy("parent", "state").agg(F.sum("n").alias("n")).where("n <> 0").groupBy("parent").agg(_counts().alias("step"))
            sums = children.groupBy("parent").agg(F.sum(F.col("total") - F.col("had")).cast("decimal(38,6)").alias("more"))
            delta = sums.join(steps, "parent", "left").withColumnRenamed("parent", "node")
            stored = self._stored(delta).select("node", F.col("state").alias("was"), F.col("total").alias("had"), "counts")
            both = delta.join(stored, "node", "left")
            none = F.create_map().cast("map<string,bigint>")
            counts = F.map_zip_with(F.coalesce("counts", none), F.coalesce("step", none), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
            had = F.coalesce("had", F.lit(0)).cast("decimal(38,6)")
            now = both.select(F.col("node").alias("parent"), F.map_filter(counts, lambda k, v: v != 0).alias("counts"), (had + F.col("more")).cast("decimal(38,6)").alias("total"), "was", had.alias("had"))
            was = now.select(F.col("parent").alias("node"), "was", "had")
            level = self._parents(now.select("parent", "counts", "total"), depth).join(was, "node")
            level.write.parquet(f"{at}/{depth}")
            level = self.spark.read.parquet(f"{at}/{depth}")
            self.read_rows.append(level.where("was is not null").count())
            levels.append(level)
            # Nothing climbs further where neither the state nor the sum has changed.
            below = level.where(~F.col("state").eqNullSafe(F.col("was")) | (F.col("total") != F.col("had")))
            if below.isEmpty() and moved.where(F.col("depth") <= depth).isEmpty():
                break
        every = reduce(DataFrame.unionByName, levels)
        version = self.table.version() + 1
        staged = self.table.stage(version, every.where("state is not null").drop("was", "had"), every)
        self.table.commit(staged, stream, batch)
        self.table.compact()
        return True
