"""Alignment of two tokenizers against whole texts tokenised by their libraries and compared pair by pair."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import align, queries

COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()
SIGNS = ["a", "the ", "é", "漢", " ", "  ", "\n", "\t", "x.", "ing", "😀", "<s>", "<|endoftext|>", "don't", "\x00", "\x1c", "\xa0", "'s ", "1", "\r\n", " "]


@pytest.fixture(scope="module")
def sides():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align.ByteLevel(a.read()), align.Pieces(b.read())


def spans(ids, tokens):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(tokens[i]), i))
        at += len(tokens[i])
    return out


def naive(rows, sides):
    """The same from whole texts, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, p = Tokenizer.from_str(sides[0].description), SentencePieceProcessor(model_proto=sides[1].model)
    t.encode_special_tokens = True
    done, count = [], Counter()
    for doc_id, text in rows:
        a, b = (spans(ids, s.tokens) for ids, s in zip((t.encode(f" {text}", add_special_tokens=False).ids, p.encode(text)), sides)) if text else ([], [])
        if any(b"".join(s.tokens[i] for *_, i in x) != f" {text}".encode() for x, s in zip((a, b), sides) if text):
            a, b = [], []
        links, j = [], 0
        for lo, hi, i in a:
            while b[j][1] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][0] < hi:
                links.append((i, b[k][2]))
                k += 1
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        groups = [defaultdict(list) for _ in range(2)]
        for side, own in zip(groups, (a, b)):
            for lo, _, i in own:
                side[bisect.bisect_right(cuts, lo)].append(str(i))
        count.update(links)
        done.append((doc_id, len(a), len(b), len(cuts), links, ";".join("|".join(",".join(g[n]) for g in groups) for n in range(len(cuts)))))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(repr((d, a, b, c, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), g)) for d, a, b, c, x, g in done)


def odd_rows():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "▁x y"), (1004, "  "), (1005, "\n"), (1006, "a "), (1007, "a  "), (1008, "x" * 3000), (1009, " " * 3000 + "q"), (1010, "hi ▁ you")]
    return rows + [(None, "hi you"), (None, "hi you"), (1011, "many words in a row " * 2000)]


@pytest.mark.parametrize("step, units", [(align.STEP_CHARS, align.BATCH_UNITS), (2000, align.BATCH_UNITS), (2000, 300), (1, 1)])
def test_against_naive(spark, sides, step, units):
    rows = odd_rows() if step > 1 else odd_rows()[250:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("batch", "kind", "groups", "a", "own", "n_a", "of", "at"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in align.align(df, *sides, step, units).collect()) == naive(rows, sides)


def test_no_rows_and_no_tokens(spark, sides):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none, *sides).count() == 0
    got = align.align(spark.createDataFrame([(1, None), (2, "▁")], none.schema), *sides, digest=True).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark, sides):
    """Without a place to cut at, with one unit, and with very many."""
    rows = [(1, "x" * 300_000), (2, " " * 300_000), (3, "\n" * 200_000), (4, "é" * 100_000 + " z"), (5, "of the end " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in align.align(df, *sides).collect()) == naive(rows, sides)


def test_query(spark, sf_dir, sides):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*(x := eval(r))[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for r in naive(rows, sides)]  # noqa: S307
    assert sorted(tuple(r[c] for c in (*COLUMNS[:-1], "groups_sha256")) for r in queries.op11_alignment(spark, sf_dir).collect()) == sorted(want)
