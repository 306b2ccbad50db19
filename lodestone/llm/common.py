"""What the operators of this subpackage share: cutting lineage and ranking without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, use_checkpoints

#: ASCII white space, as the word contracts have it; a word is a run of anything else.
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from shared storage: survives lost executors."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows from a table in the shared folder, whose sizes the planner reads from its files; and the table's path."""
    df.write.parquet(path := scratch(df.sparkSession, "stored"))
    return df.sparkSession.read.parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return written(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *dfs: DataFrame) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_rank(df: DataFrame, keys: list[str], order: list[str], rows: int, out: str, per_bucket: int = 500) -> DataFrame:
    """Adds ``out``: a gapless 0-based rank within ``keys``.

    A window over a key that holds a large share of the rows would put them into one task. So the
    rows of a key are dealt into hash buckets of about ``per_bucket`` rows, ranked there, and moved
    up by the number of rows in the buckets before. ``rows`` is the expected number of rows of a
    key. Rows equal in ``order`` are interchangeable. ``df`` has to be read from storage: where very many rows
    are alike, so that a bucket is far over its size, its rows are told apart by their place in the files.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("long"))
    counts = cut(dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    hot = counts.where(F.col("_n") > 40 * per_bucket)
    if not hot.isEmpty():
        # At most one in 40 * per_bucket rows has such a bucket.
        parts = hot.select(*keys, "_bucket", F.ceil(F.col("_n") / per_bucket).alias("_parts"))
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_parts")
        dealt = dealt.join(F.broadcast(parts), [*keys, "_bucket"], "left")
        dealt = cut(dealt.withColumn("_bucket", F.when(F.col("_parts").isNull(), F.col("_bucket")).otherwise(F.lit(buckets) * (place + 1) + F.col("_bucket"))).drop("_parts"))
        counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return dealt.join(offsets, [*keys, "_bucket"]).withColumn(out, F.col("_before") + inside - 1).drop("_bucket", "_before")


def in_order(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based place of each row within ``keys``, by ``order``; rows equal in both are interchangeable.

    One range-partitioned sort by keys and order; a place is counted from the first row of its key in the partition, plus
    the key's rows in the partitions before. A key's rows, even if all alike, spread over as many partitions as they need.
    """
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("_tie")
    cols = [*keys, *order, "_tie"]
    rows = df.select("*", tie).repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
    rows = stored(rows.withColumn("_part", F.shiftright("_at", 33)))
    first = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select(*keys, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(first, [*keys, "_part"]).withColumn(out, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
