"""Lookups and joins: interval, as-of, longest prefix, semi, anti, three-way merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, fallback: str) -> DataFrame:
    """left with ``value`` of its key, else its own ``fallback``."""
    found = right.select(F.col(key), F.col(value).alias("_found"))
    return left.join(found, key, "left").withColumn(value, F.coalesce("_found", fallback)).drop("_found")


def blocks(start: Column, end: Column) -> Column:
    """A closed interval of whole numbers cut into blocks of lengths that are powers of two, each at a multiple of its length:
    array<struct<level,no>>, at most two a level, whatever the interval's length. An empty interval has none."""
    lo, hi = start.cast("long"), end.cast("long") + 1
    top = F.floor(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double"))).cast("int")
    down, up = (lambda x, k: F.call_function("shiftright", x, k)), (lambda x, k: -F.call_function("shiftright", -x, k))

    def of(k: Column) -> Column:
        a, b = up(lo, k), down(hi, k)
        block = lambda no: F.struct(k.alias("level"), no.alias("no"))
        return F.array(F.when((a < b) & (a % 2 != 0), block(a)), F.when((a < b) & (b % 2 != 0), block(b - 1)))

    cut = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), of)), lambda x: x.isNotNull())
    return F.when(lo < hi, cut).otherwise(F.array().cast("array<struct<level:int,no:bigint>>"))


def _in_blocks(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """spans with a row for each block (_level, _no)."""
    return spans.withColumn("_block", F.explode(blocks(start, end))).withColumns({"_level": F.col("_block.level"), "_no": F.col("_block.no")}).drop("_block")


def _asking(points: DataFrame, point: str, cut: DataFrame) -> DataFrame:
    """points with a row for each block that holds them, of the levels (63 at most) that cut has."""
    levels = cut.select("_level").distinct()
    return points.crossJoin(F.broadcast(levels)).withColumn("_no", F.call_function("shiftright", F.col(point).cast("long"), F.col("_level")))


def within(points: DataFrame, spans: DataFrame, group: str, point: str, start: Column, end: Column) -> DataFrame:
    """Points with each span (closed, of whole numbers) of their group that holds them: an equi-join on blocks, each pair once."""
    cut = _in_blocks(spans, start, end)
    return _asking(points, point, cut).join(cut, [group, "_level", "_no"]).drop("_level", "_no")


def _holding(points: DataFrame, spans: DataFrame, group: str, point: str, start: str, end: str) -> DataFrame:
    """The spans that hold a point of their group.

    A group's line is cut into cells as long as the longest span, so what a span holds lies in the cell where it starts or in
    the next: spans have one row, points two. From a cell's end to its start, each span meets the last point before it.
    """
    longest = F.greatest(F.max(F.col(end).cast("long") - F.col(start).cast("long")), F.lit(1))
    bits = spans.agg((F.coalesce(F.floor(F.log2(longest.cast("double"))), F.lit(0)) + 1).cast("int").alias("_bits"))
    cell = lambda at: F.call_function("shiftright", at, F.col("_bits"))
    at = F.col(point).cast("long")
    asked = points.select(F.col(group).alias("_g"), at.alias("_at")).distinct().crossJoin(F.broadcast(bits))
    asked = asked.withColumn("_cell", F.explode(F.array(cell(F.col("_at")), cell(F.col("_at")) - 1))).select("_g", "_cell", "_at", F.lit(0).alias("_kind"))
    whole = spans.crossJoin(F.broadcast(bits)).select(F.col(group).alias("_g"), cell(F.col(start).cast("long")).alias("_cell"), F.col(start).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*spans.columns).alias("_span"))
    back = Window.partitionBy("_g", "_cell").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = whole.unionByName(asked, allowMissingColumns=True).withColumn("_next", F.min(F.when(F.col("_kind") == 0, F.col("_at"))).over(back))
    return met.where((F.col("_kind") == 1) & (F.col("_next") <= F.col("_span")[end].cast("long"))).select("_span.*")


def innermost(points: DataFrame, spans: DataFrame, group: str, point: str, point_id: list[str], start: str, end: str, order: str, first: bool = False) -> DataFrame:
    """Points with the span of their group that holds them: the one that starts last (first: that comes first in ``order``).

    Only spans that hold a point are cut into blocks. A span holds every point of its blocks, so of all spans that have a block only
    the best is kept, and a point meets one a level, however deep spans are nested. Points without a span are dropped.
    """
    spans = _holding(points, spans, group, point, start, end)
    cut = _in_blocks(spans, F.col(start), F.col(end))
    rank = F.struct(*([] if first else [(-F.col(start).cast("long")).alias("start")]), F.col(order).alias("order"))
    rest = [c for c in spans.columns if c != group]
    best = cut.groupBy(group, "_level", "_no").agg(F.min_by(F.struct(*rest), rank).alias("_span"), F.min(rank).alias("_rank"))
    hit = _asking(points, point, cut).join(best, [group, "_level", "_no"])
    nearest = Window.partitionBy(*point_id).orderBy("_rank")
    return hit.withColumn("_rn", F.row_number().over(nearest)).where("_rn = 1").select(*(F.col(f"`{c}`") for c in points.columns), *(F.col(f"_span.`{c}`") for c in rest))


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left with ``out``: right's value at the last ``on`` at or before (forward: first at or after) its own, null if none.

    One union, one sort per key; of right rows at the same place the largest value counts. Rows of left stay.
    """
    a = left.withColumns({"_side": F.lit(1 if not forward else 0), out: F.lit(None).cast(right.schema[value].dataType)})
    r = right.groupBy(*keys, on).agg(F.max(value).alias(out))
    b = r.withColumn("_side", F.lit(0 if not forward else 1))
    w = Window.partitionBy(*keys).orderBy(on, "_side")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_own", F.lit(True))
    got = (F.first if forward else F.last)(out, ignorenulls=True).over(frame)
    return both.withColumn(out, got).where(F.col("_side") == (0 if forward else 1)).drop("_side", "_own")


def longest_prefix(left: DataFrame, path: str, folders: DataFrame, folder: str, ids: list[str], sep: str = "/") -> DataFrame:
    """left with the columns of the longest of folders (a path above its own, or its own): ancestors, then an equi-join."""
    parts = F.split(F.col(path), sep)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    hit = left.withColumn("_p", F.explode(above)).join(folders.withColumnRenamed(folder, "_p"), "_p")
    rest = [c for c in folders.columns if c != folder]
    return hit.groupBy(*ids).agg(F.max("_p").alias(folder), *(F.max_by(c, F.length("_p")).alias(c) for c in rest))


def category_sums(nodes: DataFrame, categories: DataFrame, sep: str = "/") -> DataFrame:
    """Self time by the category of the longest fitting path, else by the node's label."""
    named = longest_prefix(nodes, "url", categories, "prefix", ["node_id"], sep).select("node_id", "category")
    return nodes.join(named, "node_id", "left").groupBy(F.coalesce("category", "label").alias("category")).agg(F.sum("self_time").alias("self_time"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): removed is only before, added only after."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("side", F.lit("removed")).unionByName(a.join(b, keys, "left_anti").withColumn("side", F.lit("added")))


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def overlaps(a: DataFrame, b: DataFrame, a_cols: tuple[str, str], b_cols: tuple[str, str], group: str) -> DataFrame:
    """Pairs of half-open ranges of a group that overlap, with the overlap (lo, hi), each pair once: one of both begins in the
    other, or both begin together."""
    left, right = a.where(F.col(a_cols[0]) < F.col(a_cols[1])), b.where(F.col(b_cols[0]) < F.col(b_cols[1]))
    begun = within(right, left, group, b_cols[0], F.col(a_cols[0]), F.col(a_cols[1]) - 1)
    later = within(left, right, group, a_cols[0], F.col(b_cols[0]) + 1, F.col(b_cols[1]) - 1)
    both = begun.unionByName(later)
    return both.withColumn("lo", F.greatest(a_cols[0], b_cols[0])).withColumn("hi", F.least(a_cols[1], b_cols[1]))


def intersect_range(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    lo, hi = F.greatest(s1, s2), F.least(e1, e2)
    empty = (s1 >= e2) | (s2 >= e1) | (hi <= lo)
    return F.struct(F.when(empty, 0).otherwise(lo).alias("start"), F.when(empty, 0).otherwise(hi).alias("end"))


def complement_range(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """What of the first range lies before and after the second, without empty parts."""
    first = F.struct(s1.alias("start"), F.least(s2, e1).alias("end"))
    second = F.struct(F.greatest(e2, s1).alias("start"), e1.alias("end"))
    return F.filter(F.array(first, second), lambda r: r["start"] < r["end"])


def three_way_merge(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str, remote_wins: bool = False) -> DataFrame:
    """(key, local_action, remote_action, conflict): what to do on each side; rows with nothing to do are left out.

    A row that local removed and remote updated comes back. What both changed differently, and what local
    updated and remote removed, is a conflict; with ``remote_wins`` there are none, remote's change holds.
    """
    side = lambda df, n: df.select(key, F.col(value).alias(n), F.lit(True).alias(f"has_{n}"))
    df = side(base, "b").join(side(local, "l"), key, "full_outer").join(side(remote, "r"), key, "full_outer")
    has = {n: F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in "blr"}
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))

    def change(n: str) -> Column:
        return F.when(has["b"] & ~has[n], "removed").when(~has["b"] & has[n], "added").when(has["b"] & has[n] & ~same("b", n), "updated").otherwise("same")

    df = df.withColumn("lc", change("l")).withColumn("rc", change("r"))
    lc, rc, differ = F.col("lc"), F.col("rc"), ~same("l", "r")
    nothing = F.lit(None).cast("string")
    if remote_wins:
        local_action = F.when((rc == "removed") & has["l"], "removed").when((rc == "added") & (lc == "added"), F.when(differ, "updated")).when(rc == "added", "added").when(rc == "updated", "updated").otherwise(nothing)
        remote_action = F.when((lc == "added") & (rc != "added"), "added").when((lc == "updated") & (rc != "removed") & (rc != "updated"), "updated").when((lc == "removed") & has["r"], "removed").otherwise(nothing)
        conflict = F.lit(False)
        # Equal tables have nothing to do, whatever the base says.
    else:
        conflict = ((lc == "updated") & (rc == "removed")) | (lc.isin("updated", "added") & (lc == rc) & differ)
        local_action = F.when(conflict, nothing).when((lc == "removed") & (rc == "updated"), "added").when((rc == "removed") & (lc == "same"), "removed").when((rc == "updated") & (lc == "same"), "updated").when((rc == "added") & ~has["l"], "added").otherwise(nothing)
        remote_action = F.when(conflict, nothing).when((lc == "removed") & (rc == "same"), "removed").when((lc == "updated") & (rc == "same"), "updated").when((lc == "added") & ~has["r"], "added").otherwise(nothing)
    out = df.select(key, local_action.alias("local_action"), remote_action.alias("remote_action"), conflict.alias("conflict"))
    return out.where("local_action is not null or remote_action is not null or conflict")


def ancestors(path: Column, sep: str = "/", own: bool = True) -> Column:
    parts = F.split(path, sep)
    n = F.size(parts) - (0 if own else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), sep))).otherwise(F.array().cast("array<string>"))


def has_key_or_parent(keys: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """Keys (arrays) of which a prefix, or all, is in tree."""
    prefixes = keys.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size(key)), lambda i: F.slice(key, 1, i))))
    return prefixes.join(tree.select(F.col(key).alias("_p")).distinct(), "_p", "left_semi").select(key).distinct()


def has_key_or_children(keys: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """Keys that are a prefix of, or equal to, something in tree."""
    prefixes = tree.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(key)), lambda i: F.slice(key, 1, i))).alias(key)).distinct()
    return keys.join(prefixes, key, "left_semi")


def delete_recursive(tree: DataFrame, key: str, prefix: list[str]) -> DataFrame:
    return tree.where(~(F.slice(key, 1, len(prefix)) == F.array(*map(F.lit, prefix))))


def remap_index(indexes: DataFrame, edits: DataFrame, group: str = "doc") -> DataFrame:
    """(group, index, new_index): shifted by the edits (start, end, length) that end before it; null inside an edit.

    Edits of a group lie apart. Edits' running shift and the indexes meet in one sort by place: no index meets every edit.
    """
    grown = F.col("length") - (F.col("end") - F.col("start"))
    ends = edits.select(group, F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("index"), grown.cast("long").alias("_shift"), F.lit(None).cast("long").alias("_until"))
    starts = edits.select(group, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("index"), F.lit(0).cast("long").alias("_shift"), F.col("end").cast("long").alias("_until"))
    own = indexes.select(group, "index").distinct().select(group, F.col("index").alias("_at"), F.lit(2).alias("_kind"), F.col("index").cast("long"), F.lit(0).cast("long").alias("_shift"), F.lit(None).cast("long").alias("_until"))
    w = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(starts).unionByName(own).withColumn("_shift", F.sum("_shift").over(w)).withColumn("_until", F.max("_until").over(w))
    inside = F.coalesce(F.col("index") < F.col("_until"), F.lit(False))
    return both.where("_kind = 2").select(group, "index", F.when(~inside, F.col("index") + F.col("_shift")).alias("new_index"))


#: Stands for no distance.
FAR = 2 << 20


def word_distance(words: DataFrame, anchors: DataFrame, ranges: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, word, distance): enclosing ranges between a word's nearest anchor at or before its place and the place.

    words (id, doc, word, pos), anchors (doc, word, pos), ranges (doc, start, end; half-open). Keywords and words without an
    anchor are FAR. Anchors meet only the ranges that hold them.
    """
    near = asof(words.select("id", "doc", "word", "pos"), anchors.withColumn("anchor", F.col("pos")), ["doc", "word"], "pos", "anchor", "anchor")
    spans = ranges.where("start < end").select("doc", "start", "end")
    left = within(near.where("anchor is not null"), spans, "doc", "anchor", F.col("start"), F.col("end") - 1).where("end <= pos")
    counts = left.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("d"))
    return near.join(counts, "id", "left").select("id", "word", F.when(F.col("word").isin(*keywords) | F.col("anchor").isNull(), FAR).otherwise(F.coalesce("d", F.lit(0))).alias("distance"))


#: Kinds of symbols that hold others, the length from which a chunk isn't expanded, and the note between both texts.
CONTAINERS, EXPAND_BELOW = ("class", "struct", "namespace", "interface", "enum", "union"), 500
EXPAND_NOTE = "\n\n// --- matched symbol (%s: %s) ---\n\n"


def expand_chunks(chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, text): short code chunks with the text of the innermost container symbol that holds their first line.

    chunks (chunk_id, file, doc_type, symbol_type, symbol_name, start_line, text), symbols (file, symbol_type, start_line, end_line,
    ord), files (file, text). Containers themselves, other types, long chunks, and chunks whose container already
    shows them or is blank, stay as they are.
    """
    short = (F.col("doc_type") == "code_chunk") & (F.length("text") < EXPAND_BELOW) & F.col("start_line").isNotNull() & ~F.coalesce(F.col("symbol_type").isin(*CONTAINERS), F.lit(False))
    holders = symbols.where(F.col("symbol_type").isin(*CONTAINERS)).select("file", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), "ord")
    inner = innermost(chunks.where(short).select("chunk_id", "file", "start_line"), holders, "file", "start_line", ["chunk_id"], "_s", "_e", "ord")
    lines = F.split(F.col("_file_text"), "\n")
    around = inner.join(files.select("file", F.col("text").alias("_file_text")), "file").select("chunk_id", F.trim(F.array_join(F.slice(lines, F.col("_s").cast("int"), F.greatest(F.col("_e") - F.col("_s") + 1, F.lit(0)).cast("int")), "\n")).alias("_around"))
    own = F.trim("text")
    note = F.format_string(EXPAND_NOTE, F.coalesce("symbol_type", F.lit("")), F.coalesce("symbol_name", F.lit("unknown")))
    grown = F.when(F.col("_around").isNull() | (F.col("_around") == "") | F.col("_around").contains(own), F.col("text")).otherwise(F.concat("_around", note, own))
    return chunks.join(around, "chunk_id", "left").select("chunk_id", grown.alias("text"))
