"""Order-aware operators: running means, islands, ranges, caps, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_mean(value: str, n: int, keys: list[str], order: list[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0))


def cumulative_mean(value: str, keys: list[str], order: list[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def debounce_delay(value: str, keys: list[str], order: list[str], lo: float, hi: float, n: int = 6) -> Column:
    """Mean of the last n, within bounds."""
    return F.least(F.greatest(sliding_mean(value, n, keys, order), F.lit(lo)), F.lit(hi))


def cap_per_group(df: DataFrame, query: str, group: str, rank: str, cap: int, k: int) -> DataFrame:
    """The first k rows of a query: first those within the cap of their group, then the others; all in rank order.

    Groups are compared in lower case with ``/``; the empty group has no cap. No more than k rows: all as they are.
    """
    name = F.lower(F.replace(F.coalesce(group, F.lit("")), F.lit("\\"), F.lit("/")))
    w = Window.partitionBy(query)
    df = df.withColumn("_g", name).withColumn("_n", F.count(F.lit(1)).over(w))
    df = df.withColumn("_in", F.row_number().over(Window.partitionBy(query, "_g").orderBy(rank)))
    over = F.when((F.col("_n") <= k) | (F.col("_g") == "") | (F.col("_in") <= cap), 0).otherwise(1)
    out = df.withColumn("_over", over).withColumn("pick", F.row_number().over(w.orderBy("_over", rank)))
    return out.where(F.col("pick") <= k).drop("_g", "_n", "_in", "_over")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def min_max(score: str, keys: list[str]) -> Column:
    """(s - min) / (max - min) within keys; where all are equal the score itself."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi <= lo, F.col(score)).otherwise((F.col(score) - lo) / F.when(hi > lo, hi - lo))


def fold_old_large(df: DataFrame, conv: str, turn: str, size: Column, foldable: Column, keep: int = 2, least: int = 2000) -> DataFrame:
    """``folded``: large foldable rows but the last ``keep`` of each conversation."""
    large = foldable & (size >= least)
    newest = F.row_number().over(Window.partitionBy(conv, large).orderBy(F.desc(turn)))
    return df.withColumn("folded", large & (newest > keep))


def streak(df: DataFrame, conv: str, turn: str, counted: Column, boundary: Column) -> DataFrame:
    """(conv, streak): counted rows since the last boundary."""
    last = F.max(F.when(boundary, F.col(turn))).over(Window.partitionBy(conv))
    tagged = df.withColumn("_last", last).withColumn("_c", counted)
    return tagged.groupBy(conv).agg(F.coalesce(F.sum(F.when(F.col("_c") & (F.col("_last").isNull() | (F.col(turn) > F.col("_last"))), 1)), F.lit(0)).alias("streak"))


def islands(df: DataFrame, keys: list[str], order: list, changed: Column, out: str = "island") -> DataFrame:
    """Numbers runs from 1: a run begins where ``changed`` holds, and at the start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_new", F.coalesce(changed, F.lit(True)).cast("int"))
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_lengths(df: DataFrame, keys: list[str], order: list, value: str, delta: str) -> DataFrame:
    """Runs of equal values with their sums; null values are dropped first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(df.where(F.col(value).isNotNull()).withColumn("_prev", F.lag(value).over(w)), keys, order, F.col("_prev") != F.col(value))
    return runs.groupBy(*keys, "island").agg(F.first(value).alias(value), F.sum(delta).alias(delta), F.count(F.lit(1)).alias("n"))


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching ranges as one. A null end comes after the ends of its start, a null start is a range of its own."""
    order = [F.asc_nulls_last(start), F.asc_nulls_last(end)]
    reach = F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(df.withColumn("_reach", reach), keys, order, F.col("_reach") < F.col(start))
    return runs.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def indexes_to_ranges(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Distinct integers as half-open ranges."""
    d = df.select(*keys, index).distinct()
    d = d.withColumn("_i", F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    return d.groupBy(*keys, "_i").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("_i")


def ranges_to_indexes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where("start < end").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("index"))


def consolidate(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Neighbours in the list with equal size as one range; gaps aren't looked at."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = islands(df.withColumn("_prev", F.lag("size").over(w)), keys, [order], F.col("_prev") != F.col("size"))
    return runs.groupBy(*keys, "island").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.first("size").alias("size"))


def group_matches(df: DataFrame, keys: list[str]) -> DataFrame:
    """``island``: matches whose first line is the last line of the match before share it."""
    # Asked for by number, parts aren't joined again: a task sorts a part, and joined ones grow with the table.
    df = df.repartition(16 * df.sparkSession.sparkContext.defaultParallelism, *keys)
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    return islands(df.withColumn("_prev", F.lag("end_line").over(w)), keys, ["start_line", "end_line"], F.col("_prev") != F.col("start_line")).drop("_prev")


def context_lines(lines: DataFrame, matches: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Lines around matches (line) that aren't matches themselves, each once."""
    near = matches.select(*keys, "line").distinct().withColumn("no", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)))
    own = matches.select(*keys, F.col("line").alias("no")).distinct()
    wanted = near.select(*keys, "no").distinct().join(own, [*keys, "no"], "left_anti")
    return lines.join(wanted, [*keys, "no"], "left_semi")


def equal_score_buckets(df: DataFrame, keys: list[str], score: str, item: str) -> DataFrame:
    """(keys, bucket, items): runs of equal score, best first."""
    b = df.withColumn("bucket", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(score))))
    return b.groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list(item)).alias("items"))


def one_per_folder(df: DataFrame, path: str, cap: int = 250) -> DataFrame:
    """The first path of each folder, shallowest first, at most ``cap``."""
    df = df.select(path).distinct().withColumn("depth", F.size(F.split(path, "/")) - 1).withColumn("folder", F.regexp_replace(path, "/?[^/]*$", ""))
    first = df.groupBy("depth", "folder").agg(F.min(path).alias(path))
    return first.orderBy("depth", "folder").limit(cap)


def all_adjacent(df: DataFrame, keys: list[str], order: list, holds) -> DataFrame:
    """(keys, ok): whether holds(previous, this) for every two neighbours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_ok", holds(lambda c: F.lag(c).over(w), F.col)).groupBy(*keys).agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("ok"))


def latency(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """current (the value), average of the last 100, initial (mean of the first 3, from the 4th on), high."""
    w = Window.partitionBy(*keys).orderBy(order)
    rn = F.row_number().over(w)
    first3 = F.avg(F.when(F.col("_rn") <= 3, F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_rn", rn)
    df = df.withColumn("average", F.avg(value).over(w.rowsBetween(-99, 0))).withColumn("initial", F.when(F.col("_rn") > 3, first3)).drop("_rn")
    cur = F.col(value)
    return df.withColumn("high", F.when(F.col("initial").isNull(), F.lit(False)).when(cur > 1500, True).when(cur > 500, cur > F.col("initial") * 2).otherwise(False))
