"""Exact top-k inner products, block at a time.

Vectors are made integer, and terms are their dimensions. Documents are range-partitioned by an order in
which near vectors lie together and cut into blocks: a forward index (the matrix of the block's integers)
and the least and largest value of each term. For a query, the sum of its terms' largest contributions
bounds every score in a block. Blocks are scored in falling order of that bound, in waves: after each wave
the query's k-th best score is known over all blocks, and only blocks whose bound still reaches it are
sent to it. Queries travel in tiles of near queries, bounds in packs of blocks, so a task's memory is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 1024
#: Rows of a block, queries of a tile, blocks whose bounds travel together.
BLOCK_ROWS, TILE_QUERIES, PACK_BLOCKS = 256, 512, 1024
#: Blocks a query takes in each wave before the last, which takes what is left.
WAVES = (4,)
#: The order is fitted on about so many vectors at most (it decides how much is pruned, never the result).
SAMPLE_ROWS, MOST_CELLS = 20_000, 1024
_RANGES = "no long, n int, least_id long, ids binary, x binary, hi binary, lo binary"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component), a row for each row of df. Rows whose id or vector is null, or
    that hold a null or non-finite component, are left out; rows that share an id all stay."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A row for each list, padded with zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b exactly: through doubles where every partial sum fits one, else in 64-bit integers."""
    if not a.size or not b.size or a.shape[-1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def bounds_of(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """What no score of a query (row) in a block (column) exceeds: its terms' largest contributions, summed."""
    return _products(np.maximum(q, 0), hi.T) + _products(np.minimum(q, 0), lo.T)


def _centroids(vectors: DataFrame, n: int, dims: int, cells: int, sample: int, rounds: int = 8) -> np.ndarray:
    """k-means on a bounded sample, chosen by hash of the id."""
    share = min(1.0, sample / max(1, n))
    part = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("vec_id", "x").limit(2 * sample).toArrow()
    x = _matrix(part.column("x").combine_chunks(), dims).astype(np.float64)
    if not len(x):
        return np.zeros((1, dims))
    c = x[np.random.default_rng(1).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
    return c


def _placed(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """vectors with the columns of the near order: the cell, then the strongest term of what the cell leaves and its sign."""
    dims = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims).astype(np.float64)
            cell = (x @ c.T - (c * c).sum(1) / 2).argmax(1) if dims else np.zeros(len(x), np.int64)
            rest = x - c[cell]
            top = np.abs(rest).argmax(1) if dims else np.zeros(len(x), np.int64)
            sign = np.sign(rest[np.arange(len(x)), top]) if dims else 0 * top
            yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array((2 * top + (sign > 0)).astype(np.int32))], names=["vec_id", "x", "cell", "near"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, x array<long>, cell int, near int")


def _ranges(placed: DataFrame, n: int, rows: int, dims: int) -> DataFrame:
    """The near order cut into ranges of ``rows`` rows: ids, matrix, and the terms' largest and least values.

    Ids are part of the order, so that vectors that are all alike still spread over tasks.
    """
    def made(no: int, ids: np.ndarray, x: np.ndarray) -> tuple:
        return no, len(ids), int(ids.min()), ids.tobytes(), x.tobytes(), x.max(0).tobytes(), x.min(0).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, no = np.zeros(0, np.int64), np.zeros((0, dims), np.int64), TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        names = [c.split()[0] for c in _RANGES.split(", ")]

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows_], kind) for k, kind in enumerate(kinds)], names=names)

        for b in batches:
            ids, x = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([x, _matrix(b.column(1), dims)])
            whole = len(ids) // rows * rows
            if whole:
                yield out([made(no + i // rows, ids[i : i + rows], x[i : i + rows]) for i in range(0, whole, rows)])
                no, ids, x = no + whole // rows, ids[whole:], x[whole:]
        if len(ids):
            yield out([made(no, ids, x)])

    parts = max(1, -(-n // (rows * 16)))
    return placed.repartitionByRange(parts, "cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id").select("vec_id", "x").mapInArrow(run, _RANGES)


def _packs(blocks: DataFrame, count: int, dims: int) -> tuple[DataFrame, int]:
    """(pack, nos, least_ids, hi, lo): the bounds of about PACK_BLOCKS blocks in a row, and the number of packs."""
    packs = max(1, -(-count // PACK_BLOCKS))

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).combine_chunks() for c in t.column_names}
        join = lambda c: b"".join(cols[c].to_pylist())
        return pa.table({"pack": cols["pack"][:1], "nos": [cols["no"].to_numpy().tobytes()], "least_ids": [cols["least_id"].to_numpy().tobytes()], "hi": pa.array([join("hi")], pa.binary()), "lo": pa.array([join("lo")], pa.binary())})

    own = blocks.select(F.pmod(F.xxhash64("no"), F.lit(packs)).cast("int").alias("pack"), "no", "least_id", "hi", "lo")
    return own.groupBy("pack").applyInArrow(run, "pack int, nos binary, least_ids binary, hi binary, lo binary"), packs


#: A query's state: the k-th best so far (score, id), and the block reached in falling order of bounds.
_STATE = ("kth", "kth_id", "at", "at_no")
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _asked(tiles: DataFrame, state: DataFrame | None) -> DataFrame:
    """Tiles with their queries' states: array<struct<i,kth,kth_id,at,at_no>>, null before the first wave."""
    if state is None:
        return tiles.withColumn("state", F.lit(None).cast("array<struct<i:int,kth:bigint,kth_id:bigint,at:bigint,at_no:bigint>>"))
    return tiles.join(state.groupBy("no").agg(F.collect_list(F.struct("i", *_STATE)).alias("state")), "no", "left")


def _reaching(asked: DataFrame, packs: DataFrame, n_packs: int, dims: int, take: int | None) -> DataFrame:
    """(tile, block, i, bound, kth, kth_id): the blocks that may still hold something for a query, at most ``take`` of a
    pack, with the k-th best that has to be beaten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, nos = np.frombuffer(r["x"], np.int64).reshape(r["n"], dims), np.frombuffer(r["nos"], np.int64)
                hi, lo, ids = (np.frombuffer(r[c], np.int64) for c in ("hi", "lo", "least_ids"))
                bound = bounds_of(q, hi.reshape(len(nos), dims), lo.reshape(len(nos), dims))
                kth, kth_id, at, at_no = (np.full(len(q), v) for v in (_LOW, _HIGH, _HIGH, _LOW))
                for s in r["state"] or []:
                    kth[s["i"]], kth_id[s["i"]], at[s["i"]], at_no[s["i"]] = (s[c] for c in _STATE)
                kth, kth_id, at, at_no = (v[:, None] for v in (kth, kth_id, at, at_no))
                # A block whose bound equals the k-th score may still hold a smaller id.
                open_ = ((bound < at) | ((bound == at) & (nos > at_no))) & ((bound > kth) | ((bound == kth) & (ids < kth_id)))
                if take is None:
                    i, block = np.nonzero(open_)
                else:
                    order = np.lexsort((np.broadcast_to(nos, bound.shape), -bound, ~open_), axis=1)[:, :take]
                    i, block = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
                    keep = open_[i, block]
                    i, block = i[keep], block[keep]
                for lo_ in range(0, len(i), 50_000):
                    part = slice(lo_, lo_ + 50_000)
                    own = i[part]
                    cols = (np.full(len(own), r["no"]), nos[block[part]], own.astype(np.int32), bound[own, block[part]], kth[own, 0], kth_id[own, 0])
                    yield pa.record_batch([pa.array(c) for c in cols], names=["tile", "block", "i", "bound", "kth", "kth_id"])

    met = asked.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)))).join(packs, "pack")
    return met.select("no", "n", "x", "state", "nos", "least_ids", "hi", "lo").mapInArrow(run, "tile long, block long, i int, bound long, kth long, kth_id long")


def _scored(wanted: DataFrame, tiles: DataFrame, blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """(tile, i, query_id, vec_id, score): of each wanted block (tile, block, who) the k best of each query in ``who`` that beat its
    k-th best so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                asked = sorted(r["who"], key=lambda w: w["i"])
                who = np.array([w["i"] for w in asked])
                q_ids, ids = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "ids"))
                q, x = np.frombuffer(r["q"], np.int64).reshape(len(q_ids), dims)[who], np.frombuffer(r["x"], np.int64).reshape(len(ids), dims)
                for i, w, s in zip(who, asked, _products(q, x.T)):
                    other = np.flatnonzero((ids != q_ids[i]) & ((s > w["kth"]) | ((s == w["kth"]) & (ids < w["kth_id"]))))
                    best = other[np.lexsort((ids[other], -s[other]))[:k]]
                    out += [(r["tile"], int(i), int(q_ids[i]), int(ids[j]), int(s[j])) for j in best]
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3)
            yield pa.record_batch([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["tile", "i", "query_id", "vec_id", "score"])

    both = wanted.join(blocks.select(F.col("no").alias("block"), "ids", "x"), "block").join(tiles.select(F.col("no").alias("tile"), F.col("ids").alias("q_ids"), F.col("x").alias("q")), "tile")
    return both.select("tile", "who", "q_ids", "q", "ids", "x").mapInArrow(run, "tile long, i int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, tile_queries: int = TILE_QUERIES, waves: tuple[int, ...] = WAVES, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors and queries, both (vec_id, x, any more).

    Every row but those with the query's own id is a candidate; fewer than k candidates give them all. Of
    queries that share an id the smallest vector asks; candidates that share an id all count, the ties among
    them in any order. Vectors of unlike length are compared as if padded with zeros. No vectors or no
    queries give no rows. Scores are exact while they fit 64 bits. ``stats`` gets the number of products
    taken (``scored``) and that of all (``all``).
    """
    vectors, queries = cut(vectors.select("vec_id", "x")), cut(queries.groupBy("vec_id").agg(F.min("x").alias("x")))
    spark, m = vectors.sparkSession, queries.count()
    n, dims = vectors.unionByName(queries).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    n -= m
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    c = _centroids(vectors, n, dims, min(MOST_CELLS, max(1, n // block_rows)), SAMPLE_ROWS)
    blocks, tiles = cut(_ranges(_placed(vectors, c), n, block_rows, dims)), cut(_ranges(_placed(queries, c), m, tile_queries, dims).select("no", "n", "ids", "x"))
    packs, n_packs = _packs(blocks, blocks.count(), dims)
    packs = cut(packs)
    best = Window.partitionBy("tile", "i").orderBy(F.desc("score"), "vec_id")
    found, state, products = None, None, 0
    for take in (*waves, None):
        reach = _reaching(_asked(tiles, state), packs, n_packs, dims, take)
        if take is not None:
            first = F.row_number().over(Window.partitionBy("tile", "i").orderBy(F.desc("bound"), "block"))
            reach = reach.withColumn("place", first).where(F.col("place") <= take)
        reach = cut(reach.select("tile", "block", "i", "bound", "kth", "kth_id"))
        if reach.isEmpty():
            break
        if stats is not None:
            products += reach.join(blocks.select(F.col("no").alias("block"), "n"), "block").agg(F.sum("n")).first()[0]
        got = _scored(reach.groupBy("tile", "block").agg(F.collect_list(F.struct("i", "kth", "kth_id")).alias("who")), tiles, blocks, dims, k)
        found = got if found is None else found.unionByName(got)
        found = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        if take is None:
            break
        last = reach.groupBy("tile", "i").agg(F.min(F.struct(F.col("bound").alias("at"), (-F.col("block")).alias("no"))).alias("last"))
        kth = found.where(F.col("rank") == k).select("tile", "i", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
        state = last.join(kth, ["tile", "i"], "left").select(F.col("tile").alias("no"), "i", F.coalesce("kth", F.lit(int(_LOW))).alias("kth"), F.coalesce("kth_id", F.lit(int(_HIGH))).alias("kth_id"), F.col("last.at").alias("at"), (-F.col("last.no")).alias("at_no"))
        # Queries that took nothing in this wave have no block left.
        gone = found.select("tile", "i").distinct().join(last, ["tile", "i"], "left_anti")
        state = cut(state.unionByName(gone.select(F.col("tile").alias("no"), "i", F.lit(int(_HIGH)).alias("kth"), F.lit(int(_LOW)).alias("kth_id"), F.lit(int(_LOW)).alias("at"), F.lit(int(_HIGH)).alias("at_no"))))
        found = found.drop("rank")
    if stats is not None:
        stats |= {"scored": products, "all": n * m}
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")
