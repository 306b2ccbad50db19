"""Mixing sources to target weights: whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, cut, fresh

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 0
#: Up to so many sources, their rates are sent to every task; above, they are joined by shuffle.
FEW_SOURCES = 10_000
#: Rows alike in everything are written out by so many at a time.
CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def numbered(totals: DataFrame) -> DataFrame:
    """totals with ``n``: the place of its source by code point from 0, null last.

    Sources are sorted by ranges; the driver sees one number for each range.
    """
    order = [F.col("source").isNull(), F.col("source")]
    parts = cut(totals.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before = [sum(counts.get(q, 0) for q in range(p)) for p in range(max(counts, default=0) + 1)]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("n", F.get(F.array(*map(F.lit, before)), F.col("_part")) + inside - 1).drop("_part")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with ``target`` and ``rate``.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size and the excess goes to the others by weight,
    which ends with target = min(most * size, level * weight). The level rises round by round, as those above
    their stop are held at it, until none is above: two sums a round, however many sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    df = cut(numbered(totals).select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("stop")))
    total, w_open, n_open = df.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("w"), F.count(F.lit(1))).first()
    level = total / w_open if w_open else None
    while level is not None:
        under = F.lit(level) * F.col("w") < F.col("stop")
        held, w_open, n = df.agg(F.coalesce(F.sum(F.when(~under, F.col("stop"))), F.lit(0)), F.sum(F.when(under, F.col("w"))), F.count_if(under)).first()
        if n == n_open:
            break
        level, n_open = (total - held) / w_open if w_open else None, n
    stop = F.col("stop").cast("double")
    df = df.withColumn("target", stop if level is None else F.least(stop, F.lit(level) * F.col("w")))
    return df.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def draw(doc_id: Column, digest: Column, occurrence: Column, seed: int = SEED) -> Column:
    """A number in [0, 1): eight hex digits of an MD5 over the seed, the document's id and text, and which of
    the rows alike in both this is. So rows without an id, or that share one, don't share their draws."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, occurrence.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def copies_of(rate: Column, drawn: Column) -> Column:
    """floor(rate), and one more where the draw falls below the fraction."""
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def joined(left: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """left with the columns of its source; null sources match each other."""
    right = per_source.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if few else right
    return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _sized(docs: DataFrame) -> DataFrame:
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _digest(F.col("text")).alias("digest"), word_count(F.col("text")).alias("size")))


def _rates(sized: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, bool]:
    """(source, source_size, target, rate), and whether there are few."""
    of = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    return of, of.count() <= FEW_SOURCES


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each of docs.

    size is the number of words (null text: 0). copies is floor(rate), plus one where the row's draw
    falls below the rate's fraction; never above ``most``. Sources without words take nothing. Rows alike in
    id, source and text each have a draw of their own. An empty table gives no rows.
    """
    sized = _sized(docs)
    of, few = _rates(sized, weights, most)
    alike = sized.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("_n"))
    alike = cut(alike)
    each = alike.where(F.col("_n") <= CHUNK).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    many = alike.where(F.col("_n") > CHUNK)
    if not many.isEmpty():
        parts = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long")))).repartition("doc_id", "digest", "_from")
        each = each.unionByName(parts.withColumn("_at", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_n")) - 1))).drop("_from"))
    out = joined(each, of, few)
    copies = copies_of(F.col("rate"), draw(F.col("doc_id"), F.col("digest"), F.col("_at"), seed))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _occurrence(docs: DataFrame, sized: DataFrame, out: str) -> DataFrame:
    """docs with ``out``: which of the rows alike in id, source and text a row is.

    Only rows that have such others are numbered: inside each partition, then on from the partitions before, so that a
    row that comes very often isn't gathered in one task.
    """
    alike = sized.groupBy("doc_id", "source", "digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    alike = cut(alike.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("digest").alias("_text")))
    if alike.isEmpty():
        return docs.withColumn(out, F.lit(0).cast("long"))
    own, part, before = (fresh(n, docs) for n in ("_own", "_part", "_before"))
    keyed = docs.withColumn(own, F.struct(F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("s"), _digest(F.col("text")).alias("t")))
    same = keyed[f"{own}.i"].eqNullSafe(alike["_id"]) & keyed[f"{own}.s"].eqNullSafe(alike["_of"]) & (keyed[f"{own}.t"] == alike["_text"])
    single = keyed.join(alike, same, "left_anti").withColumn(out, F.lit(0).cast("long"))
    several = cut(keyed.join(alike, same, "left_semi").withColumn(part, F.spark_partition_id()))
    counts = several.groupBy(own, part).agg(F.count(F.lit(1)).alias(before))
    counts = counts.withColumn(before, F.sum(before).over(Window.partitionBy(own).orderBy(part)) - F.col(before))
    inside = F.row_number().over(Window.partitionBy(own, part).orderBy(F.lit(0)))
    several = several.withColumn(out, inside).join(counts, [own, part]).withColumn(out, F.col(out) - 1 + F.col(before))
    return single.select(*docs.columns, out).unionByName(several.select(*docs.columns, out))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it; rows with 0 copies are gone."""
    sized = _sized(docs)
    of, few = _rates(sized, weights, most)
    source, rate, copies, at = (fresh(n, docs) for n in ("_source", "_rate", "_copies", "_at"))
    of = of.select(F.col("source").alias(source), F.col("rate").alias(rate))
    each = _occurrence(docs, sized, at)
    both = each.join(F.broadcast(of) if few else of, each["source"].cast("string").eqNullSafe(of[source]))
    drawn = draw(F.col("doc_id").cast("long"), _digest(F.col("text")), F.col(at), seed)
    both = both.withColumn(copies, copies_of(F.col(rate), drawn)).where(F.col(copies) > 0)
    return both.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
