"""Byte-level BPE against the vocabulary's own library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
SIGNS = ["a", "b", "the", " ", "  ", "\n", "\t ", "é", "漢", "'s", "'ll", "1", "😀", "ing", "xx", "<|endoftext|>", "\x00", "\x1c", " "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}).encode_ordinary


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def made(rng, most=200):
    return "".join(rng.choice(SIGNS) for _ in range(rng.randrange(most)))


def test_queue_gives_ranks_in_order():
    rng, q, held = random.Random(1), bpe.RankQueue(300_000), {}
    assert len(q.levels) == 3 and q.first() == -1
    for _ in range(5000):
        if held and rng.random() < 0.45:
            r = q.first()
            assert r == min(held) and q.take(r) == sorted(held.pop(r))
        else:
            r, place = rng.choice([rng.randrange(300_000), rng.randrange(50), 255, 256, 65_535, 65_536, 299_999]), rng.randrange(10**6)
            q.push(r, place)
            held.setdefault(r, []).append(place)


def test_ids_are_the_librarys(library):
    rng = random.Random(2)
    texts = [made(rng) for _ in range(600)] + [made(rng).replace(" ", "").replace("\n", "") * 3 for _ in range(200)] + [f"a{chr(c)} {chr(c)}b" for c in range(1, 0x3000)]
    b = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    coded = b.encode(texts)
    assert [ids(c) for c in coded] == [library(t) for t in texts] and [b.decode(c).decode() for c in coded] == texts


def test_small_regions_and_memory_change_nothing(library, monkeypatch):
    for name, value in (("REGION", 30), ("LOOKED_UP", 7), ("LISTED", 20), ("REMEMBERED", 30)):
        monkeypatch.setattr(bpe, name, value)
    rng, b = random.Random(3), bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    for _ in range(60):
        texts = [made(rng) for _ in range(5)]
        assert [ids(c) for c in b.encode(texts)] == [library(t) for t in texts]


def test_parts_may_have_later_ranks_than_what_they_make():
    """A vocabulary that no training gives; every merge is looked for afresh, the naive way."""
    rng = random.Random(4)
    for _ in range(60):
        words = {bytes([c]) for c in range(256)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(12)}
        ranks = dict(zip(rng.sample(sorted(words), len(words)), range(len(words))))
        b = bpe.Bpe(ranks, r"[\s\S]+")
        for _ in range(20):
            piece = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))).encode()
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while piece not in ranks and (best := min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)):
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids(b.encode([piece.decode()])[0]) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


@pytest.mark.parametrize("sign", ["x", "ab", " ", "\n", "é", "1", "a "])
def test_very_long_matches(sign, library):
    """The library itself gives up on a million blanks, so whole texts are compared up to 300,000 signs and by their decoded bytes beyond."""
    b = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    short = sign * (300_000 // len(sign))
    assert ids(b.encode([short])[0]) == library(short)
    text = sign * (2_000_000 // len(sign)) + "end"
    assert b.decode(b.encode([text])[0]) == text.encode()


def test_rows_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "lone"), (3, "x" * 70_000 + " é")], "doc_id long, text string").withColumn("ids", F.lit(7)).withColumn("Decoded", F.lit(8)).withColumn("n", F.lit(9))
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "Decoded", "n", "ids"]
    got = bpe.decode(coded, RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode(), r.n) for r in got) == sorted((a or 0, t or "", 9) for a, t in df.select("doc_id", "text").collect())
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0 == bpe.decode(coded.limit(0), RANKS).count()
    assert {bytes(r.decoded) for r in bpe.decode(spark.createDataFrame([(None,)], "ids binary"), RANKS).collect()} == {b""}


def test_query(spark, sf_dir, library):
    def sha(x):
        return hashlib.sha256(x).hexdigest()

    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        x = library(r.text or "")
        want.append((r.doc_id, len(x), sha(np.array(x, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(tuple, queries.op12_bpe(spark, sf_dir).collect())) == sorted(want)
