"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees, then connected components.

Fingerprints that differ in at most ``radius`` bits agree on at least two of ``radius + 2`` blocks of
the 64 bits. Each pair of blocks makes a shard key, so every link lies inside some shard; a shard's
fingerprints form a BK-tree, whose children are keyed by their Hamming distance to the parent, and
a lookup follows only the edges within the radius. Each shard hands on a spanning forest of its
links, never all its pairs.

``similar`` goes on to texts that share four fifths of their five-word shingles. Few of those differ in
so few bits of a fingerprint, least of all where a passage is cut off or added. So each text also has
keys, each made of the least values that several hash functions give its five-word shingles: two texts
have a key in common with a chance that depends on the share of common shingles alone. Texts with a
key in common are candidates, and are linked if their shingles, all of them, are compared and found similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, forget, fresh, written

RADIUS = 4
#: A tree holds at most so many fingerprints; larger shards are split, and their parts meet in pairs.
TREE_ROWS = 8192
#: For similar(): keys a text, least values a key (at a share s, 1 - (1 - s**LEAST)**KEYS have a key in common),
#: and texts and shingle hashes compared at once.
KEYS, LEAST, TREE_TEXTS, TREE_SHINGLES = 25, 5, 2048, 4_000_000
SHINGLE, SIMILARITY = 5, 0.8
_CHUNK = 1 << 16
_ALL = (1 << 64) - 1
_NONE = np.zeros(0, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle in order; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([hash_of(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return np.fromiter((hash_of(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, k: int = 4) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles, repeats counted; no words give 0."""
    return majority(shingle_hashes(words_of(text), k))


def family(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes mixed anew, differently for each n."""
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(n + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_MULTIPLY, _ADD = (family(np.arange(KEYS * LEAST, dtype=np.uint64), n) for n in (0, 1))
_MULTIPLY |= np.uint64(1)


def shingle_set(words: list[bytes], below: np.ndarray | None = None) -> np.ndarray:
    """The hashes of the distinct five-word shingles, in order; fewer words make one. Each is made of the two four-word shingles
    in it, whose hashes (``below``) may be given."""
    four = shingle_hashes(words, SHINGLE - 1) if below is None else below
    if len(words) >= SHINGLE:
        with np.errstate(over="ignore"):
            four = four[:-1] * np.uint64(0xD6E8FEB86659FD93) + four[1:]
    return np.unique(family(four, -1))


def keys_of(hashes: np.ndarray) -> list[int]:
    """KEYS unsigned numbers, each of the least values that LEAST hash functions give a set of shingles; none give none."""
    if not len(hashes):
        return []
    least = np.full(KEYS * LEAST, _ALL, np.uint64)
    key = np.arange(KEYS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1 << 11):
            least = np.minimum(least, (hashes[at : at + (1 << 11), None] * _MULTIPLY + _ADD).min(axis=0))
        for part in least.reshape(KEYS, LEAST).T:
            key = family(key + part, 0)
    return key.tolist()


def similar_shingles(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the share of common shingles is at least so much."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < least * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null and empty texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union-find over positions."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class BKTree:
    """Fingerprints by Hamming distance; knows which subtrees already form one component.

    ``one[v]`` stays true while everything below v is in v's component, so a lookup by a member
    of that component can leave the whole subtree out: it could add no link between components.
    """

    def __init__(self, radius: int, forest: Forest) -> None:
        self.radius, self.forest = radius, forest
        self.value: list[int] = []
        self.at: list[int] = []
        self.below: list[dict[int, int]] = []
        self.one: list[bool] = []

    def link(self, x: int, i: int, accept: Callable[[int, int], bool] = lambda i, j: True) -> Iterator[int]:
        """Joins position i, of fingerprint x, to all accepted within the radius; yields a partner's place in the tree per component joined."""
        if not self.value:
            return
        find, union, radius = self.forest.find, self.forest.union, self.radius
        todo = [0]
        while todo:
            v = todo.pop()
            if self.one[v] and find(self.at[v]) == find(i):
                continue
            d = (x ^ self.value[v]).bit_count()
            if d <= radius and find(i) != find(self.at[v]) and accept(i, self.at[v]) and union(i, self.at[v]):
                yield v
            todo += [c for e, c in self.below[v].items() if d - radius <= e <= d + radius]

    def insert(self, x: int, i: int) -> None:
        new, v = len(self.value), 0
        self.value.append(x)
        self.at.append(i)
        self.below.append({})
        self.one.append(True)
        if not new:
            return
        mine = self.forest.find(i)
        while True:
            if self.one[v] and self.forest.find(self.at[v]) != mine:
                self.one[v] = False
            d = (x ^ self.value[v]).bit_count()
            if d not in self.below[v]:
                self.below[v][d] = new
                return
            v = self.below[v][d]


def shard_links(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or between left and right, if right isn't empty."""
    forest = Forest()
    tree, out = BKTree(radius, forest), []
    for x in left:
        i = forest.add()
        if not right:
            out += [(x, tree.value[v]) for v in tree.link(x, i)]
        tree.insert(x, i)
    for x in right:
        i = forest.add()
        out += [(x, tree.value[v]) for v in tree.link(x, i)]
    return out


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): a row for each pair of blocks of the fingerprint."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    keys = [F.xxhash64(F.lit(t), block[i], block[j]) for t, (i, j) in enumerate(combinations(range(n), 2))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _by_key(rows: DataFrame, keys: list[str], found: Callable[[list, list], list[tuple[int, int]]], value: str = "fp") -> DataFrame:
    """Links (a, b) that ``found`` gives for each key's values, streamed key by key; ``side`` 1 only meets side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(links: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(links, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        key, sides, links = None, ([], []), []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:-2] != key:
                    if len(sides[0]) + len(sides[1]) > 1:
                        links += found(*sides)
                    key, sides = row[:-2], ([], [])
                sides[row[-2]].append(row[-1])
            if len(links) > 50_000:
                yield made(links)
                links = []
        if len(sides[0]) + len(sides[1]) > 1:
            links += found(*sides)
        yield made(links)

    rows = rows.select(*keys, "side", value).repartition(*keys).sortWithinPartitions(*keys, "side", *([value] if value == "fp" else []))
    return rows.mapInArrow(run, "a long, b long")


def _parted(rows: DataFrame, key: str, value: str, large: DataFrame) -> DataFrame:
    """rows of the keys in large (key, parts), each with its part."""
    return rows.join(large.select(key, "parts"), key).withColumn("part", F.pmod(F.xxhash64(value, F.lit(7)), "parts").cast("int"))


def _dealt(rows: DataFrame, key: str, value: str, large: DataFrame) -> DataFrame:
    """rows of the keys in large, once for each pair of parts they are in: with lo, hi and side."""
    dealt = _parted(rows, key, value, large)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other"), "side": F.when(F.col("part") > F.col("other"), 1).otherwise(0)})


def links(fps: DataFrame, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are linked.

    A shard of more than ``tree_rows`` fingerprints is dealt into parts; every two parts meet in
    their own group, so nothing is left out and no group grows with the shard.
    """
    keyed = _keyed(fps, radius)

    def found(left: list[int], right: list[int]) -> list[tuple[int, int]]:
        return [(_signed(a), _signed(b)) for a, b in shard_links(*([x & _ALL for x in side] for side in (left, right)), radius)]

    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_rows).withColumn("parts", F.ceil(2 * F.col("n") / F.lit(tree_rows)).cast("int")))
    if large.isEmpty():
        return _by_key(keyed.withColumn("side", F.lit(0)), ["key"], found)
    small = _by_key(keyed.join(large, "key", "left_anti").withColumn("side", F.lit(0)), ["key"], found)
    return small.unionByName(_by_key(_dealt(keyed, "key", "fp", large), ["key", "lo", "hi"], found))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Alternates large stars and small stars, each a minimum per node and a join, until nothing
    changes: the number of rounds grows with the logarithm of the longest chain. The minimum is
    joined under a changed key, so that both sides are shuffled and a node with very many links can
    be split over tasks.
    """
    def larger_first(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def with_min(df: DataFrame) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("k"), "m")
        return df.join(least, F.bitwise_not(df["a"]) == least["k"]).select("a", "b", "m")

    def settled(df: DataFrame) -> tuple[DataFrame, dict, str]:
        """The edges from a table, with their number and hash: one job."""
        seen = Observation()
        marked = larger_first(df).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("hash"))
        table, path = written(marked)
        return table, seen.get, path

    e, state, path = settled(edges)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = larger_first(with_min(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = with_min(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, before = path, state
        e, state, path = settled(small)
        forget(e.sparkSession, last)  # no round reads it any more
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text, any more).

    Equal fingerprints are one node, so copies cost nothing. component_id is the smallest doc_id
    reachable over links of at most ``radius`` bits, itself included. Null and empty texts have
    fingerprint 0 and link like any other. Repeated rows give repeated rows; a null doc_id keeps its
    row and never names a component unless nothing else is in it. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, k))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    tree = cut(components(links(nodes.select("fp"), radius, tree_rows)).join(nodes.withColumnRenamed("fp", "node"), "node"))
    named = tree.join(tree.groupBy("root").agg(F.min("first_id").alias("component")).select(F.bitwise_not("root").alias("k"), "component"), F.bitwise_not(tree["root"]) == F.col("k")).select(F.col("node").alias("fp"), "component")
    of = cut(nodes.join(named, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component")).alias("component_id")))
    return own.join(of, "fp").select("doc_id", "fp", "component_id")


def text_links(left: list[dict], right: list[dict], radius: int, least: float) -> list[tuple[int, int]]:
    """(text, root) for each text linked within left, or between left and right, if right isn't empty: stars
    around one text of each component.

    Texts link if their fingerprints are within the radius, or if they have a key in common and similar shingles.
    Those that share a ``root`` are linked already.
    """
    forest = Forest()
    find = forest.find
    tree = BKTree(radius, forest)
    texts, shingles = [], []
    # Of each key, the texts by a member of their component: a component is passed over as a whole once it is joined.
    holders: dict[int, dict[int, list[int]]] = {}
    known: dict[int, int] = {}

    for side, rows in enumerate((left, right)):
        for row in rows:
            i = forest.add()
            texts.append(row["text_id"])
            shingles.append(np.frombuffer(row["shingles"], np.uint64) if row["shingles"] else _NONE)
            if row["root"] is not None:
                forest.union(i, known.setdefault(row["root"], i))
            x, keys = row["fp"] & _ALL, row["keys"]
            if side or not right:
                for _ in tree.link(x, i):
                    pass
                tried = set()
                for key in keys:
                    for root, members in holders.get(key, {}).items():
                        if find(root) == find(i):
                            continue
                        for j in members:
                            if j not in tried and similar_shingles(shingles[i], shingles[j], least):
                                forest.union(i, j)
                                break
                            tried.add(j)
            if not side:
                tree.insert(x, i)
                for key in keys:
                    groups = holders.setdefault(key, {})
                    mine = [i]
                    for root in [r for r in groups if find(r) == find(i)]:
                        mine += groups.pop(root)
                    groups[find(i)] = mine
    roots = [find(i) for i in range(len(texts))]
    several = {r for i, r in enumerate(roots) if i != r}
    return [(texts[i], texts[r]) for i, r in enumerate(roots) if r in several]


def _hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes of the text with seeds of their own, a null text being empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _apart(df: DataFrame, clash: DataFrame | None, text_id: str = "text_id", check: str = "check") -> DataFrame:
    """df with a new number for texts that share their first hash but not their second: 128 bits tell texts apart."""
    if clash is None:
        return df
    # Of n texts about n * n / 2**65 share a number.
    other = fresh("_clash", df)
    both = df.join(F.broadcast(clash.select(F.col("text_id").alias(other))), F.col(text_id) == F.col(other), "left")
    return both.withColumn(text_id, F.when(F.col(other).isNotNull(), F.xxhash64(text_id, check)).otherwise(F.col(text_id))).drop(other)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, check, text)."""
    text_id, check = _hashes()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id.alias("text_id"), check.alias("check"), "text")


def _classes(docs: DataFrame, k: int = 4, radius: int = RADIUS, least: float = SIMILARITY, tree_rows: int = TREE_ROWS, tree_texts: int = TREE_TEXTS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, text_id) of every row, (text_id, root) of the texts that link to others, and the clashes of _apart()."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = [], []
            for t in b.column(3):
                words = words_of(t.as_py())
                hashes = shingle_hashes(words, k)
                fps.append(_signed(majority(hashes)))
                keys.append([_signed(x) for x in keys_of(shingle_set(words, hashes if k == SHINGLE - 1 else None))])
            yield pa.record_batch([*b.columns[:3], pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_id", "check", "fp", "keys"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingle_set(words_of(t.as_py())).tobytes() for t in b.column(1)], pa.binary())], names=["text_id", "shingles"])

    def distinct(own: DataFrame) -> DataFrame:
        return cut(own.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("check").alias("check"), F.max("check").alias("check_2")))

    own = cut(_numbered(docs).mapInArrow(sign, "doc_id long, text_id long, check long, fp long, keys array<long>"))
    texts, clash = distinct(own), None
    if not texts.where("check <> check_2").isEmpty():
        clash = texts.where("check <> check_2")
        own = _apart(own, clash)
        texts = distinct(own)
    texts = texts.drop("check", "check_2")

    def stars(pool: DataFrame, names: DataFrame) -> DataFrame:
        return pool.join(names, "value").select(F.col("text_id").alias("a"), F.col("name").alias("b"))

    named = cut(texts.groupBy("fp").agg(F.min("text_id").alias("name")))
    near = links(named.select("fp"), radius, tree_rows)
    near = near.join(named.toDF("a", "from"), "a").join(named.toDF("b", "to"), "b").select(F.col("from").alias("a"), F.col("to").alias("b"))
    same = stars(texts.select("text_id", F.col("fp").alias("value")), named.toDF("value", "name"))
    pool = texts.select("text_id", F.explode("keys").alias("value"))
    shared = pool.groupBy("value").agg(F.min("text_id").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rough = components(near.unionByName(same).unionByName(stars(pool, shared)).where("a <> b")).toDF("text_id", "rough")

    # Only texts that have candidates are looked at again, one row of each.
    members = cut(texts.join(rough, "text_id"))
    asked = members.select(F.col("text_id").alias("_text_id"), "first_id")
    seen = _apart(_numbered(docs), clash).join(asked, (F.col("doc_id") == F.col("first_id")) & (F.col("text_id") == F.col("_text_id")))
    drawn = seen.select("text_id", "text").mapInArrow(draw, "text_id long, shingles binary").groupBy("text_id").agg(F.max("shingles").alias("shingles"))
    member = F.struct("text_id", "fp", "keys", "shingles", F.lit(None).cast("long").alias("root"))
    rows = cut(members.join(drawn, "text_id", "left").select("rough", "text_id", member.alias("member")))

    def found(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
        return text_links(left, right, radius, least)

    size = F.greatest(F.count(F.lit(1)) / tree_texts, F.sum(F.octet_length("member.shingles") / 8) / TREE_SHINGLES)
    large = cut(rows.groupBy("rough").agg(size.alias("size")).where("size > 1").withColumn("parts", F.ceil(2 * F.col("size")).cast("int")))
    # A candidate component that fits one tree comes back as classes.
    whole = rows.join(large, "rough", "left_anti").withColumn("side", F.lit(0))
    classes = _by_key(whole, ["rough"], found, "member").toDF("text_id", "root")
    if not large.isEmpty():
        classes = classes.unionByName(_large_classes(rows, large, found, tree_texts))
    return own.select("doc_id", "text_id"), classes, clash


def _large_classes(rows: DataFrame, large: DataFrame, found: Callable[[list, list], list[tuple[int, int]]], tree_texts: int) -> DataFrame:
    """(text_id, root) of the candidate components in large, whose parts are compared one by one.

    First each part by itself, then one text of each part's classes with the others'. A family whose texts are alike is
    one class after that, in work that grows with its size. Only components that still have several classes have all their
    parts compared pair by pair, which leaves no link out.
    """
    parted = cut(_parted(rows, "rough", "text_id", large).withColumn("side", F.lit(0)))
    first = cut(_by_key(parted, ["rough", "part"], found, "member"))
    heads = cut(parted.select("rough", "text_id", "member", "side").join(first.where("a <> b").select(F.col("a").alias("text_id")), "text_id", "left_anti"))
    few = heads.groupBy("rough").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= tree_texts).select("rough")
    second = _by_key(heads.join(few, "rough", "left_semi"), ["rough"], found, "member")
    # A text's class is that of its part's, and the part's that of its head among the heads: two lookups.
    named = parted.select("rough", "text_id", "member").join(first.toDF("text_id", "_head"), "text_id", "left").withColumn("_head", F.coalesce("_head", "text_id"))
    named = cut(named.join(second.toDF("_head", "root"), "_head", "left").withColumn("root", F.coalesce("root", "_head")).drop("_head"))
    apart = named.groupBy("rough").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("rough")
    apart = cut(large.join(apart, "rough", "left_semi"))
    if apart.isEmpty():
        return named.select("text_id", "root")
    member = F.struct("member.text_id", "member.fp", "member.keys", "member.shingles", "root")
    third = _by_key(_dealt(named.select("rough", "text_id", member.alias("member")), "rough", "text_id", apart), ["rough", "lo", "hi"], found, "member")
    return components(named.select(F.col("text_id").alias("a"), F.col("root").alias("b")).unionByName(third).where("a <> b")).toDF("text_id", "root")


def similar(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_id, root) for every row of docs (doc_id, text, any more): rows of a class share a root.

    Classes join what near_duplicates() links, and texts that share at least ``least`` of their five-word
    shingles if they have a key in common (at a share of 0.8 all but 5 in 100,000 pairs have one). Equal texts are one
    node; 128 bits of hash tell texts apart. Null and empty texts are equal. Texts all of whose
    doc_ids are null link by their fingerprint only. An empty table gives no rows.
    """
    own, classes, _ = _classes(docs, **how)
    return own.join(classes, "text_id", "left").select("doc_id", "text_id", F.coalesce("root", "text_id").alias("root"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class that similar() finds: the one with the smallest doc_id (a null only
    where there is no other); rows alike in doc_id and text keep one."""
    own, classes, clash = _classes(docs, **how)
    # By text first, with partial minima: however many copies a text has, no task gets all of them.
    rows = own.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("text_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "n")).alias("best"))
    best = best.join(classes, "text_id", "left").groupBy(F.coalesce("root", "text_id").alias("root")).agg(F.min("best").alias("best"))
    kept = cut(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_id").alias("_text_id"), F.col("best.n").alias("_n")))
    text_id, check = fresh("_text", docs), fresh("_check", docs)
    one, two = _hashes()
    marked = _apart(docs.withColumn(text_id, one).withColumn(check, two), clash, text_id, check)

    def those(some: DataFrame) -> DataFrame:
        return marked.join(some, marked["doc_id"].cast("long").eqNullSafe(some["_id"]) & (marked[text_id] == some["_text_id"]), "left_semi")

    out, repeated = those(kept.where("_n = 1")), kept.where("_n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(those(repeated).dropDuplicates(["doc_id", text_id]))
    return out.drop(text_id, check)
