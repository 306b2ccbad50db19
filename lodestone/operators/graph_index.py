"""Approximate search by graphs of near neighbours, kept up to date by key.

Vectors are dealt into shards: the nearest of some centroids, and a part of it where very many vectors have the
same. A shard is one row: its vectors as a matrix, and graphs in layers. The lowest layer has every node, each
further one about a sixteenth of the one below. A layer's node has links to its nearest neighbours and to
those it is a neighbour of. A search goes down from the few nodes on top; on each layer it follows the links of the
best node not followed yet, until none in a bounded frontier is left. All queries of a tile move through a shard together.

How many cells and how wide a frontier a search needs depends on the vectors: an index measures it once it is made, by
the recall of a few of its own vectors against an exact search over all of them.

An update rewrites only the shards it falls into: new nodes are searched for in the graph and linked, removed ones stay
as waypoints that are never found, until a shard has too many of them and is built anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.log_table import LogTable

#: Links of a node to nearest neighbours (it has up to twice as many with those from others), least frontier of a search,
#: rows of a shard, centroids that a query looks into at least, queries of a tile, queries that a task gets with a shard.
LINKS, FRONTIER, SHARD_ROWS, PROBES, TILE, TASK_QUERIES = 16, 12, 20_000, 12, 1000, 20_000
#: An index is tuned by so many of its vectors to this recall at ten, with the least of these frontiers that reaches it.
TUNED_BY, RECALL, FRONTIERS = 200, 0.95, (12, 16, 24, 32, 48, 64, 96, 128)
#: Products that are held at a time while links are made.
HELD = 4_000_000
#: Nodes of a top layer, the share of removed nodes at which a shard is built anew, the frontier on layers above the lowest.
TOP, WORN, UPPER = 32, 0.25, 4
#: Centroids are fitted on about so many vectors at most.
SAMPLE = 20_000
SHARD = "shard long, dims int, ids array<string>, vectors binary, dead binary, layers array<struct<nodes:binary,links:binary>>"


def usable(v: Column) -> Column:
    """Null and empty vectors, and those that hold nulls or no finite numbers, have no direction: they take no part."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def matrix(lists: Sequence, dims: int) -> np.ndarray:
    """Unit vectors, padded with zeros or cut to ``dims``; a vector of zeros stays."""
    out = np.zeros((len(lists), dims), np.float32)
    for row, x in zip(out, lists):
        row[: min(len(x), dims)] = x[:dims]
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def column_matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """``matrix`` of an Arrow column without nulls; of lists of one length no Python objects are made."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    if (pc.list_value_length(lists).to_numpy(zero_copy_only=False) == dims).all():
        return _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims))
    return matrix(lists.to_numpy(zero_copy_only=False), dims)


def layer_of(chunk_id: str) -> int:
    """How many layers above the lowest a node has: one in 16, one in 256, ..."""
    h, n = zlib.crc32(chunk_id.encode()), 0
    while n < 6 and h % 16 == 0:
        h, n = h // 16, n + 1
    return n


def link(x: np.ndarray, links: int) -> np.ndarray:
    """A row of neighbours for each vector, -1 where there are fewer: its nearest, and those whose nearest it is, the nearer ones first."""
    n, k = len(x), min(links, len(x) - 1)
    out = np.full((n, 2 * links), -1, np.int32)
    if k < 1:
        return out
    near, step = np.empty((n, k), np.int32), max(1, min(1024, HELD // n))
    for lo in range(0, n, step):
        s = x[lo : lo + step] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        np.negative(s, out=s)
        best = np.argpartition(s, k - 1, axis=1)[:, :k].astype(np.int32)
        near[lo : lo + step] = np.take_along_axis(best, np.argsort(np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    out[:, :k] = near
    own, other = np.repeat(np.arange(n), k), near.ravel()
    back = ~(near[other] == own[:, None]).any(1)  # links that the other end doesn't have yet
    own, other = own[back], other[back]
    closeness, step = np.empty(len(own), np.float32), max(1, HELD // x.shape[1])
    for lo in range(0, len(own), step):
        closeness[lo : lo + step] = np.einsum("ij,ij->i", x[own[lo : lo + step]], x[other[lo : lo + step]])
    order = np.lexsort((own, -closeness, other))
    own, other = own[order], other[order]
    place = np.arange(len(other)) - np.searchsorted(other, other) + k
    fits = place < 2 * links
    out[other[fits], place[fits]] = own[fits]
    return out


def parts_of(links: np.ndarray) -> np.ndarray:
    """The smallest node that each is connected with."""
    own, other = np.repeat(np.arange(len(links)), links.shape[1]), links.ravel()
    own, other = own[other >= 0], other[other >= 0]
    part = np.arange(len(links))
    while True:
        new = part.copy()
        np.minimum.at(new, own, part[other])
        np.minimum.at(new, other, part[own])
        new = new[new]
        if (new == part).all():
            return part
        part = new


class Shard:
    """A shard as arrays. ``products`` counts the vectors that searches have compared."""

    def __init__(self, ids: list[str], x: np.ndarray, dead: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.x, self.dead, self.layers, self.products = ids, x, dead, layers, 0

    @staticmethod
    def build(ids: list[str], x: np.ndarray) -> Shard:
        s = Shard(ids, x, np.zeros(len(ids), bool), [])
        s.layers = [(np.arange(len(ids), dtype=np.int32), link(x, LINKS))]
        s.raise_layers()
        return s

    def raise_layers(self) -> None:
        """The layers above the lowest, each by itself: together they are a fifteenth of it. A part of a layer that nothing
        links to the rest, as a group of copies, has a node above in any case, so that a search can go down to it."""
        height, self.layers = np.array([layer_of(i) for i in self.ids]), self.layers[:1]
        for n in range(1, 7):
            below, links = self.layers[-1]
            if len(below) <= TOP:
                break
            part, high = parts_of(links), height[below] >= n
            alone = np.setdiff1d(part, part[high])
            nodes = below[high | np.isin(np.arange(len(below)), alone)]
            if len(nodes) == len(below):
                break
            self.layers.append((nodes, link(self.x[nodes], LINKS)))

    @staticmethod
    def read(row: dict) -> Shard:
        n = len(row["ids"])
        layers = [(np.frombuffer(p["nodes"], "<i4"), np.frombuffer(p["links"], "<i4").reshape(-1, 2 * LINKS)) for p in row["layers"]]
        return Shard(list(row["ids"]), np.frombuffer(row["vectors"], "<f4").reshape(n, row["dims"]), np.frombuffer(row["dead"], bool), layers)

    def row(self, shard: int) -> dict:
        layers = [{"nodes": n.astype("<i4").tobytes(), "links": e.astype("<i4").tobytes()} for n, e in self.layers]
        return {"shard": shard, "dims": self.x.shape[1], "ids": self.ids, "vectors": self.x.astype("<f4").tobytes(), "dead": self.dead.tobytes(), "layers": layers}

    def _compare(self, q: np.ndarray, who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.products += len(nodes)
        return np.einsum("ij,ij->i", q[who], self.x[nodes])

    def _walk(self, q: np.ndarray, level: int, starts: np.ndarray, frontier: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores): the frontier of each query on a layer, best first; starts and nodes are numbers of the layer, -1 for none."""
        nodes, links = self.layers[level]
        m, width = len(q), frontier + links.shape[1]
        seen = np.zeros((m, len(nodes)), bool)
        held, score = np.full((m, width), -1, np.int32), np.full((m, width), -np.inf, np.float32)
        done = np.ones((m, width), bool)

        def meet(rows: np.ndarray, found: np.ndarray) -> None:
            """Compares what the queries in rows haven't seen, and keeps the best."""
            fresh = found >= 0
            fresh[fresh] = ~seen[np.broadcast_to(rows[:, None], found.shape)[fresh], found[fresh]]
            r, c = np.nonzero(fresh)
            at = found[r, c]
            seen[rows[r], at] = True
            part = np.full(found.shape, -np.inf, np.float32)
            part[r, c] = self._compare(q, rows[r], nodes[at])
            w = found.shape[1]
            held[rows, frontier : frontier + w], score[rows, frontier : frontier + w], done[rows, frontier : frontier + w] = np.where(fresh, found, -1), part, ~fresh
            best = np.argsort(-score[rows, : frontier + w], axis=1, kind="stable")[:, :frontier]
            for a in (held, score, done):
                a[rows, :frontier] = np.take_along_axis(a[rows], best, 1)
            score[rows, frontier:] = -np.inf

        for lo in range(0, starts.shape[1], links.shape[1]):
            meet(np.arange(m), starts[:, lo : lo + links.shape[1]])
        while True:
            open_ = np.where(done[:, :frontier], -np.inf, score[:, :frontier])
            pick = open_.argmax(1)
            rows = np.flatnonzero(open_[np.arange(m), pick] > -np.inf)
            if not len(rows):
                return held[:, :frontier], score[:, :frontier]
            done[rows, pick[rows]] = True
            meet(rows, links[held[rows, pick[rows]]])

    def search(self, q: np.ndarray, k: int, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, scores) of the k best of each query that aren't removed; -1 where there are fewer."""
        if not len(self.ids) or not len(q):
            return np.full((len(q), k), -1, np.int32), np.full((len(q), k), -np.inf, np.float32)
        top = self.layers[-1][0]
        at = np.broadcast_to(np.arange(min(len(top), 2 * TOP), dtype=np.int32), (len(q), min(len(top), 2 * TOP)))
        for level in range(len(self.layers) - 1, -1, -1):
            wide = max(frontier, k) if level == 0 else UPPER
            at, score = self._walk(q, level, at.copy(), wide)
            if level:
                nodes, below = self.layers[level][0], self.layers[level - 1][0]
                at = np.where(at >= 0, np.searchsorted(below, nodes[at]), -1).astype(np.int32)
        score = np.where((at < 0) | self.dead[at], -np.inf, score)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
        return np.where(score > -np.inf, at, -1), score

    def update(self, ids: list[str], x: np.ndarray, removed: set[str]) -> Shard:
        """The shard with nodes added (in place of any with the same id) and removed."""
        gone = removed | set(ids)
        dead = self.dead | np.array([i in gone for i in self.ids], bool)
        live = np.flatnonzero(~dead)
        if len(ids) > WORN * len(live) or dead.sum() > WORN * len(dead):
            dims = max(self.x.shape[1] if len(live) else 0, x.shape[1])
            both = np.zeros((len(live) + len(ids), dims), np.float32)
            both[: len(live), : self.x.shape[1]], both[len(live) :, : x.shape[1]] = self.x[live], x
            return Shard.build([*(self.ids[i] for i in live), *ids], both)
        old, n = self.layers[0][1], len(self.ids)
        out = Shard(self.ids + ids, np.concatenate([self.x, _fitted(x, self.x.shape[1])]), np.concatenate([dead, np.zeros(len(ids), bool)]), [])
        links = np.concatenate([old, np.full((len(ids), 2 * LINKS), -1, np.int32)])
        before = Shard(self.ids, self.x, np.zeros(n, bool), self.layers)  # removed nodes are waypoints, also for links
        near = np.concatenate([before.search(out.x[lo : lo + TILE], LINKS, 4 * LINKS)[0] for lo in range(n, n + max(len(ids), 1), TILE)])
        among = link(out.x[n:], LINKS)[:, :LINKS] if len(ids) > 1 else np.full((len(ids), LINKS), -1, np.int32)
        for j in range(len(ids)):
            own = n + j
            found = np.concatenate([near[j][near[j] >= 0], n + among[j][among[j] >= 0]])
            found = found[np.argsort(-(out.x[found] @ out.x[own]), kind="stable")][:LINKS]
            links[own, : len(found)] = found
            for other in found.tolist():
                held = np.append(links[other][links[other] >= 0], own)
                if len(held) > 2 * LINKS:  # the farthest goes
                    held = np.delete(held, np.argmin(out.x[held] @ out.x[other]))
                links[other] = np.concatenate([held, np.full(2 * LINKS - len(held), -1)])
        out.layers = [(np.arange(n + len(ids), dtype=np.int32), links)]
        out.raise_layers()
        return out


def _fitted(x: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(x), dims), np.float32)
    out[:, : x.shape[1]] = x[:, :dims]
    return out


def centroids_of(vectors: DataFrame, cells: int, dims: int, rounds: int = 8) -> np.ndarray:
    """k-means on a bounded sample, the SAMPLE smallest by hash of the id."""
    rows = vectors.select("chunk_id", "v").orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).collect() if cells > 1 else []
    if not rows:
        return np.zeros((1, dims), np.float32)
    x = matrix([r.v for r in rows], dims)
    c = x[np.random.default_rng(1).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
    return c


def _nearness(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return x @ c.T - (c * c).sum(1) / 2


def _near(c: np.ndarray, probes: int):
    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        m = _nearness(matrix(v, c.shape[1]), c)
        return pd.Series(list(np.argsort(-m, axis=1, kind="stable")[:, :probes].astype("int32")))

    return cells


def _ready(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("chunk_id").isNotNull() & usable(F.col("v"))).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("v").cast("array<float>").alias("v"))


class GraphIndex:
    """A saved index: root/centroids, and a log of shards by cell, so that an update writes only the cells it falls into."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.shards = LogTable(spark, f"{root}/shards", "cell", most_deltas=4)

    def create(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        """From vectors (chunk_id, v); no usable vectors leave no index. Of rows that share an id the one with the largest vector counts, as a node's id is its key."""
        rows = _ready(vectors).groupBy("chunk_id").agg(F.max("v").alias("v"))
        n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        if not n:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            return
        c = centroids_of(rows, -(-n // shard_rows), dims)
        self.spark.createDataFrame([(i, x.tolist(), shard_rows, dims) for i, x in enumerate(c)], "cell int, centre array<float>, shard_rows int, dims int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")
        placed = rows.withColumn("cell", _near(c, 1)(F.col("v"))[0])
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("chunk_id", F.lit(3)), "parts"))

        def build(t: pa.Table) -> pa.Table:
            ids = t.column("chunk_id").to_pylist()
            return _table([Shard.build(ids, column_matrix(t.column("v"), dims)).row(t.column("shard")[0].as_py())])

        self.shards.create(dealt.groupBy("shard").applyInArrow(build, SHARD).withColumn("cell", F.shiftright("shard", 32).cast("int")))
        self.tune()

    def tune(self, k: int = 10, recall: float = RECALL) -> tuple[int, int]:
        """(probes, frontier): the cheapest with which TUNED_BY of the vectors, by hash of the id, find so much of what an exact
        search over all vectors gives them beside themselves; the most there is, if none do. Searches use it from now on.

        Every shard is read once. What it has among a query's nearest, and which frontiers find that, is known from the shard
        alone, so only the best of all shards are looked at together.
        """
        c, _, dims = self._centres()
        asked = self.nodes().orderBy(F.xxhash64("chunk_id", F.lit(7)), "chunk_id").limit(TUNED_BY).collect()
        own, q = [r.chunk_id for r in asked], matrix([r.v for r in asked], dims)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                s = Shard.read(row)
                exact = np.where(s.dead, -np.inf, q @ s.x.T)
                n = min(k + 1, len(s.ids))
                best = np.argpartition(-exact, n - 1, axis=1)[:, :n] if n else np.empty((len(q), 0), int)
                found = np.stack([(best[:, :, None] == s.search(q, k + 1, f)[0][:, None, :]).any(2) for f in FRONTIERS], -1)
                held = np.take_along_axis(exact, best, 1)
                i, j = np.nonzero(held > -np.inf)
                keep = [at for at, (a, b) in enumerate(zip(i, best[i, j])) if s.ids[b] != own[a]]
                i, j = i[keep], j[keep]
                yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(np.full(len(i), row["cell"], np.int32)), pa.array(held[i, j].astype(np.float64)), pa.array(found[i, j].tolist(), pa.list_(pa.bool_()))], names=["query", "cell", "score", "found"])

        first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
        best = self.shards.read().mapInArrow(run, "query int, cell int, score double, found array<boolean>").withColumn("n", first).where(F.col("n") <= k).collect()
        probes, frontier = [min(PROBES << i, len(c)) for i in range(32) if i == 0 or PROBES << (i - 1) < len(c)], FRONTIERS
        choice = (probes[-1], frontier[-1])
        if best:
            rank = np.argsort(np.argsort(-_nearness(q, c), axis=1, kind="stable"), axis=1)
            at, found = rank[[r["query"] for r in best], [r.cell for r in best]], np.array([r.found for r in best])
            good = [(p, f) for p in probes for i, f in enumerate(frontier) if (found[:, i] & (at < p)).mean() >= recall]
            choice = min(good, key=lambda x: (x[0] * x[1], x), default=choice)
        else:
            choice = (probes[0], FRONTIER)
        self.spark.createDataFrame([choice], "probes int, frontier int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/tuned")
        return choice

    def nodes(self) -> DataFrame:
        """(chunk_id, cell, v): the vectors that can be found."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                s = Shard.read(row | {"layers": []})
                live = np.flatnonzero(~s.dead)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(live) + 1, dtype=np.int32) * s.x.shape[1]), pa.array(s.x[live].ravel()))
                yield pa.record_batch([pa.array([s.ids[i] for i in live], pa.string()), pa.array(np.full(len(live), row["cell"], np.int32)), v], names=["chunk_id", "cell", "v"])

        return self.shards.read().select("cell", "dims", "ids", "vectors", "dead").mapInArrow(run, "chunk_id string, cell int, v array<float>")

    def _centres(self) -> tuple[np.ndarray, int, int]:
        rows = self.spark.read.parquet(f"{self.root}/centroids").orderBy("cell").collect()
        return np.array([r.centre for r in rows], np.float32), rows[0].shard_rows, rows[0].dims

    def search(self, queries: DataFrame, k: int, probes: int | None = None, frontier: int | None = None, stats: bool = False) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, q) by cosine; with ``stats``, (products) of each shard's tasks.

        A query visits the shards of its ``probes`` nearest cells; both numbers are as the index was tuned, unless given. A
        shard meets its queries as one group, or several if they are very many. Queries without a direction find nothing.
        Longer or shorter vectors are cut or padded to the index's length.
        """
        c, _, dims = self._centres()
        tuned = self.spark.read.parquet(f"{self.root}/tuned").first()
        probes, frontier = probes or tuned.probes, frontier or tuned.frontier
        asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("q"))).select("query_id", F.col("q").cast("array<float>").alias("q"))
        asked = asked.withColumn("cell", F.explode(_near(c, probes)(F.col("q"))))
        kind = asked.schema["query_id"].dataType
        arrow_kind = to_arrow_type(kind)
        per_cell = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("parts"))
        shards = self.shards.read()
        met = shards.join(F.broadcast(per_cell), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = asked.join(F.broadcast(per_cell), "cell").withColumn("of_part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        dealt = dealt.join(F.broadcast(shards.select("cell", F.col("shard").alias("of"))), "cell").select("of", "of_part", "query_id", "q")
        names = ["query_id", "chunk_id", "score"]

        def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if shard.num_rows and asked.num_rows:
                s = Shard.read(shard.slice(0, 1).to_pylist()[0])
                for lo in range(0, asked.num_rows, TILE):
                    tile = asked.slice(lo, TILE)
                    at, score = s.search(column_matrix(tile.column("q"), dims), k, frontier)
                    r, j = np.nonzero(at >= 0)
                    if not stats:
                        out.append(pa.table([tile.column("query_id").cast(arrow_kind).take(pa.array(r)), pa.array([s.ids[n] for n in at[r, j]], pa.string()), pa.array(score[r, j].astype(np.float64))], names=names))
                if stats:
                    return pa.table({"products": pa.array([s.products], pa.int64())})
            if stats:
                return pa.table({"products": pa.array([], pa.int64())})
            return pa.concat_tables(out) if out else pa.table([pa.array([], arrow_kind), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)

        both = met.select("shard", "part", "dims", "ids", "vectors", "dead", "layers").groupBy("shard", "part").cogroup(dealt.groupBy("of", "of_part"))
        if stats:
            return both.applyInArrow(run, "products long")
        found = both.applyInArrow(run, f"query_id {kind.simpleString()}, chunk_id string, score double")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, stream: str = "update", batch: int | None = None) -> bool:
        """Adds vectors (chunk_id, v), in place of any with the same id, and removes ids (chunk_id); a batch that is known does nothing.

        An id may have lain in any cell, so removals are sent to the cells that hold it, found by a join of the ids alone.
        """
        version = self.shards.version() + 1
        batch = version if batch is None else batch
        if self.shards.knows(stream, batch):
            return False
        c, shard_rows, dims = self._centres()
        spark = self.spark
        new = _ready(added).groupBy("chunk_id").agg(F.max("v").alias("v")) if added is not None else spark.createDataFrame([], "chunk_id string, v array<float>")
        gone = new.select("chunk_id")
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col("chunk_id").cast("string"))).distinct()
        now = self.shards.read()
        held = now.select("cell", "shard", F.explode("ids").alias("chunk_id")).join(gone, "chunk_id")
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("parts"))
        placed = new.withColumn("cell", _near(c, 1)(F.col("v"))[0]).join(F.broadcast(sizes), "cell", "left").withColumn("shard", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.coalesce("parts", F.lit(1))))
        orders = placed.select("cell", "shard", "chunk_id", "v").unionByName(held.select("cell", "shard", "chunk_id", F.lit(None).cast("array<float>").alias("v")))
        touched = orders.select("cell").distinct()
        # A cell is written as a whole: shards without an order of their own stay as they are.
        theirs = now.join(touched, "cell", "left_semi").select(*(x.split()[0] for x in ("shard", "dims", "ids", "vectors", "dead", "layers")))

        def apply(shards: pa.Table, asked: pa.Table) -> pa.Table:
            rows = shards.to_pylist()
            if not asked.num_rows:
                return _table(rows)
            ids, new = asked.column("chunk_id").to_pylist(), asked.column("v").is_valid().to_pylist()
            fresh = [i for i, is_new in enumerate(new) if is_new]
            own, number = Shard.read(rows[0]) if rows else Shard.build([], np.zeros((0, dims), np.float32)), asked.column("of")[0].as_py()
            x = column_matrix(asked.column("v").drop_null(), dims)
            return _table([own.update([ids[i] for i in fresh], x, {i for i, is_new in zip(ids, new) if not is_new}).row(number)])

        out = theirs.groupBy("shard").cogroup(orders.select(F.col("shard").alias("of"), "chunk_id", "v").groupBy("of")).applyInArrow(apply, SHARD)
        out = out.withColumn("cell", F.shiftright("shard", 32).cast("int"))
        staged = self.shards.stage(version, out, touched)
        self.shards.commit(staged, stream, batch)
        self.shards.compact()
        return True


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row for row: a row may be a whole shard."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _table(rows: list[dict]) -> pa.Table:
    layer = pa.struct([("nodes", pa.binary()), ("links", pa.binary())])
    return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int64()), ("dims", pa.int32()), ("ids", pa.list_(pa.string())), ("vectors", pa.binary()), ("dead", pa.binary()), ("layers", pa.list_(layer))]))
