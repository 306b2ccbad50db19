"""The conversation trie against a naive one."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TURNS = "conv_id long, turn long, role string, text string"


def naive(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    said = {}
    for c, turns in own.items():
        turns.sort()
        h = zlib.crc32(str(c).encode()) % 9
        said[c] = [(x[2], x[4]) for x in sorted(own.get(c - c % 5, []))[:h] + turns[h:]]
    members, children, out = defaultdict(list), defaultdict(list), []
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below[node] = (sum(below[k][0] for k in children[node]) or 1, saved + sum(below[k][1] for k in children[node]))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(said[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df, **how):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in trie.trie(*trie.rebuilt(trie.turns_of(df)), **how).collect())


def conversations():
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["x", "yé", None, ""])) for c in range(60) for t in range(rng.randrange(14))]
    rows += [(100 + i, t, "user", str(t)) for i in range(5) for t in range(90 + 3 * i)]  # long ones, alike up to their ends
    rows += [(300 + 5 * i, t, "user", str(t)) for i in range(12) for t in range(i)]  # each a prefix of the next
    return rows + [(None, 1, "user", "x")] * 3 + [(200, 1, "user", "x")] * 150 + [(201, None, None, None)]


@pytest.mark.parametrize("how", [{}, {"block": 4, "sum_block": 3}, {"block": 2}])
def test_against_naive(spark, how):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS)
    for c in ("pos", "digest", "depth", "n", "last", "bytes", "_at"):
        df = df.withColumn(c, F.lit("x"))
    assert got(df, **how) == naive(rows)


def test_many_copies_and_no_rows(spark):
    rows = [(c, t, "user", f"{t}") for c in range(0, 9000, 5) for t in range(3)]
    assert got(spark.createDataFrame(rows, TURNS)) == naive(rows)
    assert got(spark.createDataFrame([], TURNS)) == [] == got(spark.createDataFrame([(None, 1, "a", "b")], TURNS))
    assert got(spark.createDataFrame([(2, 1, "a", "b")], TURNS)) == naive([(2, 1, "a", "b")])  # no turn is left


def test_ids_of_a_node_travel_in_packs(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACK_IDS", 7)
    ends = spark.createDataFrame([(bytes([d]), c) for d in range(4) for c in range(-20, 30 * d)], "digest binary, conv_id long").repartition(5)
    sha = {bytes(r.digest): r.ends_sha256 for r in trie._ends(ends).collect()}
    assert sha == {bytes([d]): hashlib.sha256(",".join(map(str, range(-20, 30 * d))).encode()).hexdigest() for d in range(4)}


def test_in_order_splits_a_hot_key(spark):
    df = spark.createDataFrame([(i % 3 if i % 10 == 0 else 7, i // 2) for i in range(20_000)], "k long, v long")
    rows = common.in_order(df, ["k"], ["v"], "at").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append((r["at"], r.v))
    assert all([a for a, _ in sorted(x)] == list(range(len(x))) and [v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by.values())


def test_work_grows_with_turns(spark):
    """One conversation of 3,000 turns: its nodes are one path, which hangs from the root's alone."""
    rows = [(c, t, "user", f"{c} {t}") for c, n in ((0, 2), (5, 3000)) for t in range(n)]
    sys.setrecursionlimit(10_000)
    assert got(spark.createDataFrame(rows, TURNS)) == naive(rows)
