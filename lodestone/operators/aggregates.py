"""Aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .joins import ancestors
from .windows import islands


def group_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values) in order."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    return g.select(key, F.transform("_l", lambda x: x[value]).alias("values"))


def distinct_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's last value, at the place where the key first came."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def count_with_first(df: DataFrame, key: str, payload: str, ts: str, every: str | None = None) -> DataFrame:
    """Count by key with the first payload; ``every`` counts within windows of that length."""
    keys = [key] + ([F.window(ts, every).alias("w")] if every else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(payload, ts).alias(payload))


def top_sums(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    s = df.groupBy(key).agg(F.sum(value).alias(value))
    return s.orderBy(F.desc(value), key).limit(n)


def top_share(df: DataFrame, key: str, value: str, n: int = 5, least: float = 0.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """The n largest sums with their whole percentage of the total, of at least ``least`` percent; ``drop`` keys aren't listed."""
    s = df.groupBy(key).agg(F.sum(value).alias(value))
    total = s.agg(F.sum(value).alias("_t"))
    out = s.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col(value) / (F.col("_t") / 100)).cast("long")).drop("_t")
    return (out.where(~F.col(key).isin(*drop)) if drop else out).where(F.col("share") >= least).orderBy(F.desc(value), key).limit(n)


def heaviest_path(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """(node, path): from each start node, its heaviest caller again and again. edges (node, caller, time)."""
    best = edges.groupBy("node").agg(F.max_by("caller", F.struct("time", "caller")).alias("caller"))
    out = start.select("node", F.array("node").alias("path"))
    for _ in range(depth):
        nxt = best.select(F.col("node").alias("_at"), F.col("caller").alias("_next"))
        out = out.join(nxt, F.element_at("path", -1) == F.col("_at"), "left").select("node", F.when(F.col("_next").isNotNull() & ~F.array_contains("path", F.col("_next")), F.concat("path", F.array("_next"))).otherwise(F.col("path")).alias("path"))
    return out


def merge_symbols(df: DataFrame, file: str = "file") -> DataFrame:
    """Parts of a symbol (same type and name; unnamed: same start) as one, by start."""
    key = F.concat_ws("::", "symbol_type", F.coalesce(F.col("symbol_name"), F.col("start_line").cast("string")))
    return df.withColumn("_k", key).groupBy(file, "_k").agg(F.min_by("symbol_type", "start_line").alias("symbol_type"), F.min_by("symbol_name", "start_line").alias("symbol_name"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_k")


def repository_map(symbols: DataFrame, most: int = 50) -> DataFrame:
    """(file, text): up to ``most`` symbols with their lines."""
    item = F.struct("start_line", F.concat("symbol_type", F.lit(" "), F.coalesce("symbol_name", F.lit("(anonymous)")), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("line"))
    g = merge_symbols(symbols).groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return g.select("file", F.array_join(F.transform(F.slice("l", 1, most), lambda x: x["line"]), "\n").alias("text"))


def parent_chunks(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """(file, ord, group): consecutive chunks under one header whose joined length stays within ``most``.

    chunks (file, ord, header, text). The joined length leaves out the separator that the next chunk would add. Chunks of a file
    stream by in order, as lengths without their texts, and only the group that is open is remembered.
    """
    kind = chunks.schema["file"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, header, length = object(), 0, None, 0
        for b in batches:
            groups = []
            for f, h, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if f != at:
                    at, group, length = f, 0, n
                elif h != header or length + n > most:
                    group, length = group + 1, n
                else:
                    length += 2 + n
                header = h
                groups.append(group)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(groups, pa.int32())], names=["file", "ord", "group"])

    lengths = chunks.select("file", F.col("ord").cast("long"), F.coalesce("header", F.lit("")).alias("header"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    schema = StructType([StructField("file", kind), StructField("ord", LongType()), StructField("group", IntegerType())])
    return lengths.repartition("file").sortWithinPartitions("file", "ord").mapInArrow(run, schema)


def parent_texts(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """(parent_key, parent_text) of parent_chunks."""
    grouped = chunks.join(parent_chunks(chunks, most), ["file", "ord"])
    g = grouped.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    return g.select(F.concat(F.col("file").cast("string"), F.lit("::parent::"), F.col("group").cast("string")).alias("parent_key"), F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), 1, most).alias("parent_text"))


#: States of tests by priority.
STATE_PRIORITY = {"unset": 0, "skipped": 1, "passed": 2, "queued": 3, "failed": 4, "errored": 5, "running": 6}


def rollup_states(leaves: DataFrame, path: str = "path", sep: str = "/", only: DataFrame | None = None) -> DataFrame:
    """(node, state, duration) of every ancestor, or of those in ``only`` (node): the state of highest priority, and the sum of durations."""
    prio = F.element_at(F.create_map(*(F.lit(x) for kv in STATE_PRIORITY.items() for x in kv)), F.col("state"))
    up = leaves.withColumn("node", F.explode(ancestors(F.col(path), sep)))
    if only is not None:
        up = up.join(only, "node", "left_semi")
    return up.groupBy("node").agg(F.max_by("state", prio).alias("state"), F.sum("duration").alias("duration"))


def affected_nodes(changed: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """Ancestors of changed leaves: the only nodes to be rolled up again."""
    return changed.select(F.explode(ancestors(F.col(path), sep)).alias("node")).distinct()


def histogram_similarity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """1 - L1 distance of character counts over all characters."""
    def chars(df: DataFrame, n: str) -> DataFrame:
        return df.select(key, F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).groupBy(key, "c").agg(F.count(F.lit(1)).alias(n))

    both = chars(a, "x").join(chars(b, "y"), [key, "c"], "full_outer").fillna(0, ["x", "y"])
    return both.groupBy(key).agg((1 - F.sum(F.abs(F.col("x") - F.col("y"))) / F.sum(F.col("x") + F.col("y"))).alias("similarity"))


def match_count(ranges: Column) -> Column:
    """Matches count their ranges, context lines one."""
    return F.sum(F.when(ranges.isNull(), 1).otherwise(F.size(ranges)))


def group_sorted(df: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))


def consecutive_groups(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df.withColumn("_prev", F.lag(value).over(w)), keys, order, ~F.col("_prev").eqNullSafe(F.col(value))).drop("_prev")


def above_baseline(df: DataFrame, keys: list[str], value: str, baseline: str, times: float = 10) -> DataFrame:
    """Keys whose largest value is over so many times their baseline."""
    return df.groupBy(*keys).agg(F.max(value).alias("worst"), F.first(baseline).alias(baseline)).where(F.col("worst") > times * F.col(baseline))


def change_count(kind: Column, inner: Column) -> Column:
    return F.sum(F.when(kind.isin("delete", "insert"), 1).when(kind == "modified", inner).otherwise(0))


def fold_arrays(values: Column, zero: Column, merge) -> Column:
    """A reducer over an array: merge(previous, next)."""
    return F.aggregate(values, zero, merge)


def bit_set(df: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """Small integers (0 to 63) as the bits of one long."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit).cast("int"))
    return df.groupBy(*keys).agg(F.bit_or(one).alias("bits"))


def bits_have(bits: Column, bit: int) -> Column:
    return F.getbit(bits, F.lit(bit)) == 1


def append_if_absent(df: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """Distinct items of each key in the order in which they first came."""
    first = df.groupBy(*keys, item).agg(F.min(order).alias(order))
    return group_sorted(first, keys, order, item)


def signed_set(defaults: list[str], signed: Column) -> Column:
    """(defaults + added) - removed; ``-x`` removes x; lower case, distinct, sorted."""
    low = F.transform(signed, F.lower)
    added, removed = F.filter(low, lambda x: ~x.startswith("-")), F.transform(F.filter(low, lambda x: x.startswith("-")), lambda x: F.substring(x, 2, 1 << 30))
    return F.array_sort(F.array_except(F.array_union(F.array(*(F.lit(d.lower()) for d in defaults)).cast("array<string>"), added), removed))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def slice_array(a: Column, start: int, end: int | None = None) -> Column:
    """Half-open, negative places count from the end, places outside are moved inside."""
    n = F.size(a)
    at = lambda i: F.least(F.greatest(F.lit(i) + (n if i < 0 else 0), F.lit(0)), n)
    lo, hi = at(start), n if end is None else at(end)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def structural_key(c: Column) -> Column:
    """128 bits, equal for equal structures."""
    return F.md5(F.to_json(F.struct(c)))


def map_key(c: Column) -> Column:
    """As above for maps, entries in any order."""
    return F.md5(F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("m"))))
