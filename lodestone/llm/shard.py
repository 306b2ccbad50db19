"""Balanced label propagation: linked documents gather in a shard while row counts stay exactly even.

Labels are shards. In each round every group of linked rows names the shard that holds most of it (one
drawn by hash where several do, so that as many rows ask to leave a shard as to enter it), the
rows elsewhere ask to move there, and quotas are set on the driver from the counts of moves asked for
between each two shards (at most shards squared numbers). What enters a shard beyond its capacity is
paid back with rows that have no links, so moves never upset the balance. Where a shard refuses moves,
as many scattered groups in proportion name their next best shard in the next round. Rounds go on until
no more links are kept within shards, and the best even state is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import cut, forget, with_rank

#: ROUNDS is a limit: rounds end when IDLE of them keep no more links.
SHARDS, ROUNDS, IDLE = 40, 24, 2
STAY_FREE, STAY_LINKED = -1, -2


def quotas(want: list[list[int]], have: list[int], free: list[int], linked: list[int]) -> tuple[list[list[int]], list[tuple[int, int, int, int, int]]]:
    """Granted moves and the repayments (shard, kind, lo, hi, to) that leave the counts at most one apart.

    lo and hi are ranks among the shard's free rows (kind STAY_FREE) or, only where those don't
    suffice, among its linked rows that stay, or last those whose move to another shard (kind) was refused.
    So every row of a shard can pay, and the counts always come out.
    """
    n, total = len(have), sum(have)
    goal = [total // n + (s < total % n) for s in range(n)]
    grant = [row[:] for row in want]
    moved = True
    while moved:
        moved = False
        for b in range(n):
            into, out = sum(grant[a][b] for a in range(n)), sum(grant[b])
            over = into - max(0, goal[b] - have[b] + out + free[b])
            for a in range(n):
                if over > 0 and grant[a][b]:
                    less = min(over, grant[a][b])
                    grant[a][b] -= less
                    over -= less
                    moved = True
    after = [have[b] + sum(grant[a][b] for a in range(n)) - sum(grant[b]) for b in range(n)]
    gaps = [[b, goal[b] - after[b]] for b in range(n) if after[b] < goal[b]]
    pay = []
    for b in range(n):
        surplus = after[b] - goal[b]
        for kind, at, end in ((STAY_FREE, 0, free[b]), (STAY_LINKED, 0, linked[b]), *((c, grant[b][c], want[b][c]) for c in range(n))):
            while surplus > 0 and at < end:
                k = min(surplus, gaps[-1][1], end - at)
                pay.append((b, kind, at, at + k, gaps[-1][0]))
                at += k
                surplus -= k
                gaps[-1][1] -= k
                if not gaps[-1][1]:
                    gaps.pop()
    return grant, pay


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut(), but with sizes read from files: those that Spark estimates for checkpoints multiply in each round's joins."""
    df.write.parquet(path := scratch(df.sparkSession, "shards"))
    return df.sparkSession.read.parquet(path), path


def balanced_shards(rows: DataFrame, link: str, order: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows with ``shard``; counts of shards differ by at most one, and equal ``link`` values gather.

    A group larger than half a shard is dealt into parts of that size, which gather in shards next to
    each other by number, so that one shard isn't asked to hold several. Null links stand alone. ``order`` are columns that tell rows apart; rows equal in them are interchangeable.
    """
    rows = cut(rows)
    total = rows.count()
    part = max(1, total // shards // 2)
    groups = cut(rows.where(F.col(link).isNotNull()).groupBy(link).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")).withColumnRenamed(link, "_link")
    parts = F.ceil(F.col("_n") / part).cast("int")
    linked = rows.join(groups, rows[link] == groups["_link"], "left")
    linked = linked.withColumn("_part", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(*order, F.lit(3)), parts))).withColumn("_linked", F.col("_n").isNotNull()).withColumn("_big", F.coalesce(F.col("_n") > part, F.lit(False)))
    state, at = written(linked.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int")).drop("_n", "_link"))
    best, best_at, most_kept, idle, refused = None, None, -1, 0, [0] * shards
    for turn in range(rounds + 2):
        held = state.where("_linked").groupBy(link, "_part", "shard").agg(F.count(F.lit(1)).alias("_c"), F.max("_big").alias("_big"))
        avoid = F.pmod(F.xxhash64(link, "_part", "shard", F.lit(2 * turn)), F.lit(1000)) < F.get(F.array(*map(F.lit, refused)), F.col("shard"))
        draw = F.xxhash64(link, "_part", "shard", F.lit(2 * turn + 1))
        most = F.max(F.struct(~avoid, "_c", draw, "shard"))["shard"]
        home = held.groupBy(link, "_part").agg(F.when(F.max("_big"), F.pmod(F.xxhash64(link) + F.col("_part"), F.lit(shards))).otherwise(most).cast("int").alias("_home"), F.sum(F.col("_c") * F.col("_c")).alias("_kept"))
        home = cut(home.select(F.col(link).alias("_link"), F.col("_part").alias("_p"), "_home", "_kept"))
        kept = home.agg(F.sum("_kept")).first()[0] or 0
        # Past the limit of rounds nobody moves but what the counts still need.
        last = turn == rounds + 1 or turn == rounds and best is not None
        asked = state.join(home.drop("_kept"), F.col("_linked") & (state[link] == home["_link"]) & (state["_part"] == home["_p"]), "left").drop("_link", "_p")
        to = F.when(~F.col("_linked"), STAY_FREE).when(F.lit(turn >= rounds) | (F.col("_home") == F.col("shard")), STAY_LINKED).otherwise(F.col("_home"))
        asked = cut(asked.withColumn("_to", to.cast("int")).drop("_home"))
        want, have = [[0] * shards for _ in range(shards)], [0] * shards
        free, still = [0] * shards, [0] * shards
        for r in asked.groupBy("shard", "_to").count().collect():
            have[r.shard] += r["count"]
            if r._to >= 0:
                want[r.shard][r._to] = r["count"]
            else:
                (free if r._to == STAY_FREE else still)[r.shard] = r["count"]
        if max(have) - min(have) <= 1:
            idle = 0 if kept > most_kept else idle + 1
            if not idle:
                if best_at:
                    forget(rows.sparkSession, best_at)
                best, best_at, most_kept = state, at, kept
        if last or idle == IDLE:
            break
        grant, pay = quotas(want, have, free, still)
        inward = [(sum(r[b] for r in want), sum(r[b] for r in grant)) for b in range(shards)]
        refused = [500 * (w - g) // w if w else 0 for w, g in inward]
        moves = [(a, b, 0, grant[a][b], b) for a in range(shards) for b in range(shards) if grant[a][b]] + pay
        if not moves and not any(map(any, want)):
            break
        table = rows.sparkSession.createDataFrame([(*m,) for m in moves], "_from int, _kind int, _lo long, _hi long, _dest int")
        ranked = with_rank(asked, ["shard", "_to"], order, max(1, total // shards), "_rank")
        here = (F.col("shard") == F.col("_from")) & (F.col("_to") == F.col("_kind")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
        # At most shards squared rows, whatever the input.
        moved = ranked.join(F.broadcast(table), here, "left").withColumn("shard", F.coalesce("_dest", "shard"))
        old = at
        state, at = written(moved.select(*state.columns))
        if old != best_at:
            forget(rows.sparkSession, old)
    return (state if best is None else best).drop("_part", "_linked", "_big")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs (doc_id, text, any more).

    size is the UTF-8 length plus 16 (null text: 16, with the checksum of an empty text, and linked to
    other texts that are empty or null). The law is `rows`: counts of shards are at most one apart.
    slot numbers a shard's rows from 0 without gaps. Repeated rows and null doc_ids are rows like
    any other; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"))
    placed = balanced_shards(rows, "text_md5", ["doc_id", "text_md5"], shards, rounds)
    total = placed.count()
    out = with_rank(placed, ["shard"], ["doc_id", "text_md5"], max(1, total // shards), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
