"""A prefix trie over conversations: chained digests of every prefix, grouped into nodes, summed over subtrees.

A turn is reduced to a digest of its role and text before anything is shuffled. Turns are placed within
their conversation by one distributed sort, chained in blocks of bounded length, and blocks are chained
the same way, so that no conversation has to fit one task. Nodes are the groups of equal (depth, digest).

All nodes with the same smallest member form one vertical path of the trie. For the subtree sums each
path is exploded to the paths above it, found by looking up the prefixes of its own conversation: that is
every node's contribution to every ancestor, in work that grows with the number of turns, where exploding
single nodes would grow with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, stored

#: Turns that are chained in one array, depths of a path that are summed in one window, ids that travel together.
BLOCK, SUM_BLOCK, PACK_IDS = 64, 1024, 4096
ROOT = hashlib.sha256(b"").digest()


def _sha(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): a row for each turn, placed from 0 by turn (null first), then role, then the text's digest.

    Null roles and texts are empty; rows without conv_id belong to no conversation. ``bytes`` is the length of the text in UTF-8.
    """
    said, who = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), _sha(said.cast("binary")).alias("said"), F.octet_length(said).cast("long").alias("bytes"))
    placed = in_order(rows, ["conv_id"], ["turn", "role", "said"], "pos")
    return placed.select("conv_id", "pos", _sha(F.concat(_sha(F.col("role").cast("binary")), F.col("said"))).alias("digest"), "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c begins with the first h turns of c - c % family, h = crc32(decimal c) % most.

    The turns (conv_id, pos, digest, bytes, last) are those, then c's own after its first h. The conversations are
    (conv_id, n), also those without a turn left. A conversation takes fewer than ``most`` turns, and gives them to fewer
    than ``family`` others. That its own family head takes its own first turns changes nothing.
    """
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head, h = F.col("conv_id") - F.col("conv_id") % family, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    info = n.select("conv_id", "own", head.alias("head"), h.alias("h")).join(n.select(F.col("conv_id").alias("head"), F.col("own").alias("given")), "head", "left")
    given = F.least("h", F.coalesce("given", F.lit(0).cast("long")))
    info = stored(info.select("conv_id", "head", "h", given.alias("given"), (given + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    mine = turns.join(info, "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "head")
    first = heads.join(info, "head").where("pos < given")
    both = mine.unionByName(first, allowMissingColumns=True)
    return both.select("conv_id", "pos", "digest", "bytes", (F.col("pos") == F.col("n") - 1).alias("last")), info.select("conv_id", "n")


def chained(turns: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, prefix, parent, and the other columns of turns): the digest of all turns up to pos, and of all before.

    ``most`` is the largest number of turns. Blocks are chained from a fixed start; the digest of a prefix joins the chain of
    its whole blocks, found in the same way, with that of its turns in the last block.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "pos", "digest")]
    blocks = turns.withColumn("block", F.floor(F.col("pos") / block)).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *rest))).alias("turns"))
    steps = F.aggregate("turns", F.array(F.lit(ROOT)), lambda done, t: F.concat(done, F.array(_sha(F.concat(F.element_at(done, -1), t["digest"])))))
    blocks = blocks.withColumn("steps", F.slice(steps, 2, block))
    if most > block:
        whole = blocks.select("conv_id", F.col("block").alias("pos"), F.element_at("steps", -1).alias("digest"))
        above = chained(whole, -(-most // block), block)
        blocks = blocks.join(above.select("conv_id", F.col("pos").alias("block"), F.col("prefix").alias("whole"), F.col("parent").alias("start")), ["conv_id", "block"])
        full = lambda p, i: F.when(i == block - 1, F.col("whole")).otherwise(_sha(F.concat(F.col("start"), p)))
    else:
        blocks = blocks.withColumn("start", F.lit(ROOT))
        full = lambda p, i: _sha(F.concat(F.col("start"), p))
    blocks = blocks.withColumn("steps", F.transform("steps", full))
    one = blocks.select("conv_id", F.explode(F.arrays_zip("turns", "steps", F.concat(F.array("start"), F.slice("steps", 1, block - 1)).alias("parents"))).alias("t"))
    return one.select("conv_id", "t.turns.pos", F.col("t.steps").alias("prefix"), F.col("t.parents").alias("parent"), *(F.col(f"t.turns.{c}") for c in rest)).where("prefix is not null")


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (digest, conv_id) with one digest as (digest, first, ids): their ids in decimal, joined by commas."""
    digest, ids = None, []
    for b in batches:
        out = []
        for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if d != digest or len(ids) == PACK_IDS:
                out += [(digest, ids[0], ",".join(map(str, ids)))] if ids else []
                digest, ids = d, []
            ids.append(c)
        yield pa.RecordBatch.from_pylist([dict(zip(("digest", "first", "ids"), o)) for o in out], _PACKED)
    if ids:
        yield pa.RecordBatch.from_pylist([{"digest": digest, "first": ids[0], "ids": ",".join(map(str, ids))}], _PACKED)


_PACKED = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ends_sha256) of packs sorted by digest and first id; holds one pack at a time."""
    digest, state = None, None
    for b in batches:
        out = []
        for d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if d == digest:
                state.update(b"," + ids.encode())
                continue
            out += [{"digest": digest, "ends_sha256": state.hexdigest()}] if state else []
            digest, state = d, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist(out, _HASHED)
    if state:
        yield pa.RecordBatch.from_pylist([{"digest": digest, "ends_sha256": state.hexdigest()}], _HASHED)


def _ends(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id). Ids of one node are sorted and joined in many tasks; only the packs of
    a node meet in one, which hashes them as they come."""
    packs = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_packed_ids, "digest binary, first long, ids string")
    return packs.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_hashed_ids, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, sum_block: int = SUM_BLOCK) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, pos, digest, bytes, last) with pos from 0 without a gap, ``convs`` all of (conv_id, n). The root has
    depth 0, no parent and no text. n_leaves and saved_tokens, (n_convs - 1) times the bytes of a node's last text, are
    summed over its subtree. ends_sha256 is of the ids that end there, ascending, joined by commas. No conversations give no rows.
    """
    most = convs.agg(F.max("n")).first()[0] or 0
    prefixes = chained(turns, most, block).select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("prefix").alias("digest"), "parent", "bytes", "last")
    prefixes = stored(prefixes)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    nodes = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    nodes = stored(nodes.unionByName(root))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(prefixes.where("last").select("digest", "conv_id").unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("digest"), "conv_id")))
    # Many children may have one parent: their side is the one that a skewed join splits.
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(kids, ["depth", "digest"], "left").join(ends, "digest", "left").join(above, ["depth", "parent"], "left")
    full = stored(
        full.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
        )
    )
    paths = full.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("top > 0")
    # What is above a path: the prefixes of its conversation, each by the path it lies on; the root's is the same for all.
    over = prefixes.select("conv_id", "depth", "digest").join(paths, "conv_id").where("depth < top")
    over = over.join(nodes.select("depth", "digest", F.col("conv_id").alias("path")), ["depth", "digest"]).select("conv_id", "path", "depth", "leaves", "saved")
    over = over.unionByName(paths.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("path"), "depth"))).select("conv_id", "path", "depth", "leaves", "saved"))
    hung = over.groupBy("conv_id", "path").agg(F.max("depth").alias("depth"), F.min("leaves").alias("leaves"), F.min("saved").alias("saved"))
    hung = hung.groupBy(F.col("path").alias("conv_id"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parts = full.unionByName(hung, allowMissingColumns=True).withColumn("part", F.floor(F.col("depth") / sum_block))
    below = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("conv_id", "part").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = sums.select("conv_id", "part", F.coalesce(F.sum("leaves").over(below), F.lit(0)).alias("leaves_below"), F.coalesce(F.sum("saved").over(below), F.lit(0)).alias("saved_below"))
    here = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumn("leaves", F.sum("leaves").over(here)).withColumn("saved", F.sum("saved").over(here)).where("n_convs is not null").join(sums, ["conv_id", "part"])
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.col("leaves_below")).alias("n_leaves"), (F.col("saved") + F.col("saved_below")).alias("saved_tokens"), "ends_sha256",
    )
