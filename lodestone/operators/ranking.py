"""Top-k, fusion, reranking, paging, retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import bucket_bytes, overlap, rerank_tokens
from ..session import scratch, use_checkpoints
from .graph_index import GraphIndex
from .windows import min_max


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The k best of each key, ties by the smaller ``tie``; the limit is pushed below the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn(out, rn).where(F.col(out) <= k)


#: So many queries are scored against every row at once; more are taken in blocks of that number. Scores that a task holds at a time.
FEW_QUERIES, TILE_SCORES = 2_000, 1 << 20
#: Buckets of so many queries are multiplied as a matrix, the most common of them up to that number; the others by their postings.
COMMON, MOST_COMMON = 16, 1_024


def _matrix(lists: list, dims: int | None = None) -> np.ndarray:
    """A row for each list, padded with zeros or cut to ``dims``; nulls are zeros."""
    dims = max([0, *(len(x) for x in lists if x is not None)]) if dims is None else dims
    out = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        if x is not None:
            out[i, : min(len(x), dims)] = x[:dims]
    return out


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places


def _best_by_blocks(queries: DataFrame, rows: DataFrame, k: int, few: int, prepare: Callable, score: Callable) -> DataFrame:
    """(query_id, chunk_id, score, rank): of queries (query_id, x) and rows (chunk_id, y), the k best scores of each query, ties by chunk.

    Queries are taken in blocks of ``few``; a block is made ready by prepare(xs) and goes to the tasks. score(ready, ys) gives a matrix
    with a row for each y, NaN for none. Rows are scored in tiles of TILE_SCORES at most, whatever a batch holds; a tile hands on k of each
    query, and none below the k-th score that its task has seen, so nothing else is shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // few))
    (qid, _), (cid, _) = (list(df.schema.fields) for df in (queries, rows))
    schema = StructType([StructField("query_id", qid.dataType), StructField("chunk_id", cid.dataType), StructField("score", DoubleType())])
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = part.collect()
        ids, ready = [r[0] for r in asked], prepare([r[1] for r in asked])

        def run(batches: Iterator[pa.RecordBatch], ids=ids, ready=ready) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            asked_by, floor = pa.array(ids, out.field(0).type), np.full(len(ids), -np.inf)
            step = max(1, TILE_SCORES // max(1, len(ids)))
            for tile in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows if ids and k > 0 else 0, step)):
                chunks = tile.column(0).to_pylist()
                place = np.empty(len(chunks), int)
                place[sorted(range(len(chunks)), key=lambda i: (chunks[i] is not None, chunks[i]))] = np.arange(len(chunks))
                scores = score(ready, tile.column(1).to_pylist())
                none = np.isnan(scores)
                scores[none] = -np.inf
                if len(scores) > k:
                    floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=0)[k - 1])
                r, q = np.nonzero((scores >= floor) & ~none)
                s = scores[r, q]
                order = np.lexsort((place[r], -s, q))
                r, q, s = r[order], q[order], s[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([asked_by.take(pa.array(q[best])), tile.column(0).take(pa.array(r[best])).cast(out.field(1).type), pa.array(s[best])], schema=out)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, ["query_id"], "score", "chunk_id", k)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, few: int = FEW_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact, by dot product over the shorter length, to nine places. queries (query_id, q),
    vectors (chunk_id, v); a null vector has the score 0."""

    def score(q: np.ndarray, vs: list) -> np.ndarray:
        return _rounded(_matrix(vs, q.shape[1]) @ q.T, 9)

    return _best_by_blocks(queries.select("query_id", "q"), vectors.select("chunk_id", "v"), k, few, _matrix, score)


def sparse_top_k(queries: DataFrame, chunks: DataFrame, k: int, few: int = FEW_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the dot product of sparse vectors, to six places; only chunks that share a bucket.

    queries (query_id, text) and chunks (chunk_id, text) are encoded in their own rows, once: however common a bucket, no join meets it.
    """

    def prepare(coded: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        who, bucket, count, tops = _uncoded(coded)
        kinds, at, n = np.unique(bucket, return_inverse=True, return_counts=True)
        dense = np.full(len(kinds), -1)
        common = np.argsort(-n, kind="stable")[:MOST_COMMON]
        common = common[n[common] >= COMMON]
        dense[common] = np.arange(len(common))
        counted, often = np.zeros((len(common), len(tops))), dense[at] >= 0
        counted[dense[at[often]], who[often]] = count[often]
        at, who, count = at[~often], who[~often], count[~often]
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(kinds) + 1))
        return tops, kinds, dense, counted, ends, np.stack([who[order], count[order]])

    def score(ready: tuple, coded: list) -> np.ndarray:
        # Counts are multiplied and divided by the largest at the end, so that sums are whole numbers.
        tops, kinds, dense, counted, ends, postings = ready
        row, bucket, count, own_tops = _uncoded(coded)
        at = np.minimum(np.searchsorted(kinds, bucket), max(len(kinds) - 1, 0))
        known = kinds[at] == bucket if len(kinds) else np.zeros(len(bucket), bool)
        row, at, count = row[known], at[known], count[known]
        often = dense[at] >= 0
        own = np.zeros((len(coded), len(counted)))
        own[row[often], dense[at[often]]] = count[often]
        out = own @ counted
        row, at, count = row[~often], at[~often], count[~often]
        n = ends[at + 1] - ends[at]
        place = np.arange(n.sum()) + np.repeat(ends[at] - (np.cumsum(n) - n), n)
        who, of = postings[:, place]
        out += np.bincount(np.repeat(row, n) * len(tops) + who, np.repeat(count, n) * of, out.size).reshape(out.shape)
        out /= tops[None, :] * own_tops[:, None]
        return np.where(out > 0, _rounded(out, 6), np.nan)

    asked, rows = queries.select("query_id", bucket_bytes("text").alias("x")), chunks.select("chunk_id", bucket_bytes("text").alias("y"))
    if queries.count() > few:  # every block reads the rows anew
        rows.write.parquet(at := scratch(chunks.sparkSession, "coded"))
        rows = chunks.sparkSession.read.schema(rows.schema).parquet(at)
    return _best_by_blocks(asked, rows, k, few, prepare, score)


def _uncoded(coded: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as bucket_bytes() gives them: the text, bucket and count of each entry, and the largest count of each text (1 at least)."""
    each = [np.frombuffer(c, "<i4").reshape(2, -1) for c in coded]
    both = np.concatenate([np.zeros((2, 0), "<i4"), *each], axis=1).astype(np.int64)
    return np.repeat(np.arange(len(each)), [x.shape[1] for x in each]), both[0], both[1], np.array([x[1].max(initial=1) for x in each], float)


def ann_top_k(queries: DataFrame, vectors: DataFrame, k: int, **how) -> DataFrame:
    """(query_id, chunk_id, score, rank): approximate, by cosine, through graphs of near neighbours (see GraphIndex). queries
    (query_id, q), vectors (chunk_id, v); those without a direction take no part."""
    index = GraphIndex(vectors.sparkSession, scratch(vectors.sparkSession, "graphs"))
    index.create(vectors)
    kind = vectors.schema["chunk_id"].dataType
    if index.shards.version() is None:
        return queries.select("query_id", F.lit(None).cast(kind).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return index.search(queries, k, **how).withColumn("chunk_id", F.col("chunk_id").cast(kind))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score) from rank lists (query_id, chunk_id, rank): sum of 1 / (k + rank), ranks from 1."""
    return lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def rerank(hits: DataFrame, k: int, vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """hits (query_id, query_text, chunk_id, text, score, rank) ranked anew by both scores; no more than k: as they are."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    words = overlap(rerank_tokens(F.col("query_text")), rerank_tokens(F.col("text")))
    df = hits.withColumn("_n", n).withColumn("_norm", min_max("score", ["query_id"])).withColumn("_kw", words)
    df = df.withColumn("score", F.when(F.col("_n") <= k, F.col("score")).otherwise(vector_weight * F.col("_norm") + keyword_weight * F.col("_kw")))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("_n") > k, -F.col("score")), "rank"))
    return df.withColumn("rank", rn).where(F.col("rank") <= F.greatest(F.lit(k), F.lit(0))).drop("_n", "_norm", "_kw")


def by_route(hits: DataFrame, route: str, k: int, kind: str = "doc_type") -> DataFrame:
    """The k best hits of each query whose type is the route's; the route ``all`` takes every type."""
    kept = hits if route == "all" else hits.where(F.col(kind) == route)
    return top_k(kept, ["query_id"], "score", "chunk_id", k)


def path_tier(path: Column, last: tuple[str, ...]) -> Column:
    """0 below src, 2 below a vendored folder, else 1."""
    parts = F.transform(F.filter(F.split(path, r"[/\\]"), lambda p: p != ""), F.lower)
    return F.when(F.get(parts, F.lit(0)) == "src", 0).when(F.exists(parts, lambda p: p.isin(*last)), 2).otherwise(1)


def global_place(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with ``out``: the place in the order of the whole table, from 0.

    Rows are sorted into ranges and numbered in each; the driver sees one count a range.
    """
    use_checkpoints(df.sparkSession)
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before = F.array(*(F.lit(sum(n for q, n in counts.items() if q < p)).cast("long") for p in range(max(counts, default=0) + 1)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(out, F.get(before, F.col("_part")) + inside - 1).drop("_part")


def page(df: DataFrame, order: list, size: int, keys: list[str] | None = None) -> DataFrame:
    """df with ``page`` and ``item`` numbers from 0, within each key, or over the whole table."""
    if not keys:
        df = global_place(df, order, "_rn")
        return df.withColumn("page", F.floor(F.col("_rn") / size)).withColumn("item", F.col("_rn") % size).drop("_rn")
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_rn", rn).withColumn("page", F.floor(F.col("_rn") / size)).withColumn("item", F.col("_rn") % size).drop("_rn")


def after_cursor(df: DataFrame, ts: Column, source: Column, cursor: tuple | None, limit: int) -> DataFrame:
    """The next rows of a list that falls by time, then source: keyset paging."""
    if cursor:
        df = df.where((ts < F.lit(cursor[0])) | ((ts == F.lit(cursor[0])) & (source < F.lit(cursor[1]))))
    return df.orderBy(ts.desc(), source.desc()).limit(limit)


#: Orders of a result list: folders first where rows say so, then these.
ORDERS = {"default": ["path"], "count asc": ["count", "path"], "count desc": ["-count", "path"], "type": ["ext", "path"], "file name": ["name", "path"], "modified": ["-modified", "path"]}


def order_results(df: DataFrame, by: str) -> DataFrame:
    first = [F.desc("is_folder")] if "is_folder" in df.columns else []
    return df.orderBy(*first, *(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[by]))


def order_cells(df: DataFrame) -> DataFrame:
    """By cell, content before web view, then place."""
    return df.orderBy("cell", F.col("webview").asc_nulls_first(), "start")


def cap_result_text(lines: Column, most_lines: int = 50, most_chars: int = 8000) -> Column:
    """Lines joined, at most so many and then so many characters, with a note where something is left out."""
    cut = F.array_join(F.slice(lines, 1, most_lines), "\n")
    cut = F.concat(cut, F.when(F.size(lines) > most_lines, F.concat(F.lit("\n... "), (F.size(lines) - most_lines).cast("string"), F.lit(" more lines"))).otherwise(""))
    return F.when(F.length(cut) > most_chars, F.concat(F.substring(cut, 1, most_chars), F.lit("\n... cut"))).otherwise(cut)


def recent(df: DataFrame, keys: list[str], item: str, ts: str, n: int = 5) -> DataFrame:
    """The n most recently used items of each key, newest first in ``rank``."""
    last = df.groupBy(*keys, item).agg(F.max(ts).alias(ts))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), item))).where(F.col("rank") <= n)


def limit_by_level(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Distinct ranges (start, end) of the shallow nesting levels that together stay within ``most``.

    Ranges of a key nest or lie apart (they may touch). A range's level is the number of ranges that hold it: those begun before it
    less those ended, in one sort of both ends.
    """
    own = df.select(*keys, "start", "end").distinct()
    opened = own.select(*keys, "start", "end", F.col("start").alias("_at"), F.lit(1).alias("_kind"), (-F.col("end")).alias("_long"), F.lit(1).alias("_step"))
    closed = own.select(*keys, "start", "end", F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_long"), F.lit(-1).alias("_step"))
    before = Window.partitionBy(*keys).orderBy("_at", "_kind", "_long").rowsBetween(Window.unboundedPreceding, -1)
    level = opened.unionByName(closed).withColumn("level", F.coalesce(F.sum("_step").over(before), F.lit(0))).where("_kind = 1").select(*keys, "start", "end", "level")
    counts = level.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("sum", F.sum("n").over(Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))
    return level.join(counts.where(F.col("sum") <= most).select(*keys, "level"), [*keys, "level"])


def sort_lines(df: DataFrame, line: str, descending: bool = False) -> DataFrame:
    c = F.collate(F.col(line), "UNICODE")
    return df.orderBy(c.desc() if descending else c.asc())


def expired(df: DataFrame, keys: list[str], ts: str, oldest: Column, keep: int = 10) -> DataFrame:
    """Rows to delete: older than ``oldest``, but never so many that fewer than ``keep`` remain; the newest stay."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return df.withColumn("_rn", rn).where((F.col(ts) < oldest) & (F.col("_rn") > keep)).drop("_rn")


def beyond_last(df: DataFrame, keys: list[str], name: str, keep: int) -> DataFrame:
    """All but the last ``keep`` by name."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(name)))).where(F.col("_rn") > keep).drop("_rn")


def trim_lru(df: DataFrame, ts: str, limit: int) -> DataFrame:
    """Where there are ``limit`` rows or more, the newest half of the limit."""
    return df.orderBy(F.desc(ts)).limit(limit // 2) if df.limit(limit).count() >= limit else df


def rank_providers(df: DataFrame, keys: list[str]) -> DataFrame:
    """By score, built-in last, newest first; an exclusive provider scores 1000 and all others 0."""
    w = Window.partitionBy(*keys)
    any_ex = F.coalesce(F.bool_or("exclusive").over(w), F.lit(False))
    score = F.when(any_ex, F.when(F.col("exclusive"), 1000).otherwise(0)).otherwise(F.col("score"))
    df = df.withColumn("score", score).where("score > 0")
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "builtin", F.desc("time"))))


def search_position(values: DataFrame, value: str, x: float) -> DataFrame:
    """Where x stands in the sorted values, or -(place + 1) if it isn't there."""
    return values.agg(F.when(F.coalesce(F.bool_or(F.col(value) == x), F.lit(False)), F.sum((F.col(value) < x).cast("int"))).otherwise(-F.coalesce(F.sum((F.col(value) < x).cast("int")), F.lit(0)) - 1).alias("position"))


def sorted_map(df: DataFrame, keys: list[str], key: str, value: str, order: str, before=None) -> DataFrame:
    """(keys, entries): a map of each key's last value by ``order``, iterated in order of its own key, or by a comparator
    before(a, b) over entries (negative, zero or positive)."""
    last = df.groupBy(*keys, key).agg(F.max_by(value, order).alias(value))
    entries = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(key, value))).alias("entries"))
    return entries if before is None else entries.withColumn("entries", F.array_sort("entries", before))


def floor_entry(entries: Column, key: str, x: Column) -> Column:
    """The last entry of a sorted map whose key is at most x; null if there is none."""
    return F.try_element_at(F.filter(entries, lambda e: e[key] <= x), F.lit(-1))


#: Kinds of change in the order in which they apply at one place.
CHANGE_ORDER = {"delete": 0, "modified": 1, "unchanged": 1, "insert": 2}


def order_changes(df: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Cell changes by place, deletions before changes before insertions, then by ``ties``."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in CHANGE_ORDER.items() for x in kv)), F.col("type"))
    return df.orderBy(F.coalesce("modified_index", "original_index"), kind, "original_index", *(ties or []))


def recommend(deps: DataFrame, selected: DataFrame, seeds: int = 3, per_seed: int = 6, most: int = 5) -> DataFrame:
    """deps (seed_ord, dep_ord, path): first of each path from the first seeds, without selected, in order."""
    df = deps.where((F.col("seed_ord") < seeds) & (F.col("dep_ord") < per_seed)).join(selected, "path", "left_anti")
    first = df.groupBy("path").agg(F.min(F.struct("seed_ord", "dep_ord")).alias("at"))
    return first.orderBy("at", "path").limit(most).select("path", "at.seed_ord", "at.dep_ord")
