"""Each operator against brute force, exact round trips or held-out labels, and on awkward rows."""

import hashlib
import json
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, common, decontam, license, mix, pack, queries, shard, simhash, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "lone words here", "en", "b", 15), (3, "x" * 50_000 + " y" * 30_000, "en", "a", 0), (4, "same text twice over", None, "a", None), (5, "same text twice over", None, None, None), (6, " \t\n ", "de", "b", 4)]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeats, and extra columns with the names of inner ones."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("fp", "_id", "_copies", "rate", "toxicity", "shard", "slot", "digest", "key", "n", "_rank", "component_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    cols = sorted(df.columns)
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(map(repr, ([r[c] for c in cols] for r in df.collect()))) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


# 1 -------------------------------------------------------------------------------------------------


def brute_topk(rows, wanted, k=10):
    """rows (id, vector): of the queries' least vectors, the k best of all rows with another id."""
    out = {}
    for q in {i for i, _ in rows if wanted(i)}:
        v = min(list(x) for i, x in rows if i == q)
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q)[:k])]
    return out


def asked(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_topk_stays_exact(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = [(i, (centres[i % 8] + 0.1 * rng.normal(size=16)).tolist()) for i in range(900)] + [(i, centres[0].tolist()) for i in range(900, 940)]
    x += [(2000, None), (2001, [float("nan")] * 16), (2002, [None] * 16), (2003, [float("inf")] * 16), (2004, []), (None, [1.0] * 16), (0, x[0][1]), (0, [9.0] * 16), (7, [1.5] * 20)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    for c in ("x", "no", "tile", "pack", "near", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    v = topk.integer_vectors(df)
    rows = [(r.vec_id, r.x) for r in v.collect()]
    assert not {2000, 2001, 2002, 2003} & {i for i, _ in rows} and (2004, []) in rows and len(rows) == 944
    wide = v.withColumn("tile", F.lit(1))
    for how in ({"tile_queries": 4, "block_rows": 16}, {"waves": ()}, {"waves": (1, 1), "block_rows": 1000}):
        assert asked(topk.top_k(wide, wide.where("vec_id % 100 = 0 or vec_id = 2004"), 10, **how)) == brute_topk(rows, lambda i: i % 100 == 0 or i == 2004)
    few = spark.createDataFrame([(0, [1]), (0, [2]), (5, [])], "vec_id long, x array<long>")
    assert asked(topk.top_k(few, few, 10)) == {0: [(1, 5, 0)], 5: [(1, 0, 0), (2, 0, 0)]}
    bare = spark.createDataFrame([(0, []), (100, [])], "vec_id long, x array<long>")
    assert asked(topk.top_k(bare, bare, 10)) == {0: [(1, 100, 0)], 100: [(1, 0, 0)]}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0 == topk.top_k(v, v.limit(0)).count()


def test_topk_skips_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 300
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 32)) * 30).astype(int).tolist()
    x += [x[0]] * 3000  # a vector that a quarter of the rows have
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, x array<long>")
    stats = {}
    got = asked(topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block_rows=64, stats=stats))
    m = np.array(x)
    for q in list(got)[::9]:
        s = m @ m[q]
        order = [i for i in np.lexsort((np.arange(len(m)), -s)) if i != q][:10]
        assert [(i, s_) for _, i, s_ in got[q]] == [(i, s[i]) for i in order]
    assert stats["all"] == 11_000 * 110 and stats["scored"] < 0.2 * stats["all"]


# 2 -------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    said = ["</s>[INST] ok [/INST]", "\\e\\\\e<\\es>", "<<s></s", "[[INST]", "", None, "tail [", "é漢😀\n", "\\"]
    rows = [(c, t, ("user", "assistant", None, "sys<s>tem")[t % 4], said[(c + t) % len(said)]) for c in range(9) for t in range(6)] + [(60, 1, "user", x) for x in ("<s>", "<a", "<", "\\")] + [(None, 1, "assistant", "a"), (50, None, "assistant", "x"), (50, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("prompt", F.lit(1))
    out = chat.format_turns(chat.turns_of(df))
    out = out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else 99, r or "", x or ""))
    assert len(out) == len(by)
    alone = chat.format_turns(chat.turns_of(spark.createDataFrame([(None, t, "user", "a") for t in range(5)], "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, r.n_turns) for r in alone] == [(None, 1)] * 5
    for r in out:
        want = sorted(by[r.conv_id])
        assert [(t.role, t.text) for t in r.back] == [w[1:] for w in want] and r.n_turns == len(want)
        assert r.loss == "".join(w[2] for w in want if w[1] == "assistant")
        for s in r.loss_spans:
            assert r.formatted[s.start : s.start + s.length].encode() == r.formatted.encode()[s.byte_start : s.byte_start + s.byte_length]
    assert chat.format_turns(chat.turns_of(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    turns = [("user", "hi"), ("assistant", "ho")]
    made = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "from/value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        "prompt/completion": {"prompt": "hi", "completion": "ho"},
        "prompt/response": {"prompt": "hi", "response": "ho"},
        "question/answer": {"question": "hi", "answer": "ho"},
        "instruction": {"instruction": "hi", "output": "ho"},
        "instruction with input": {"instruction": "hi", "input": "", "output": "ho"},
    }
    rows = [(i, json.dumps(v)) for i, v in enumerate(made.values())] + [(90, "{"), (91, None), (92, '{"a": 1}'), (93, "[]")]
    got = defaultdict(list)
    for r in chat.turns_of_json(spark.createDataFrame(rows, "conv_id long, json string")).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    for i, name in enumerate(made):
        assert got[i] == [(name, *t) for t in turns]
    assert all(got[i] == [(None, None, None)] for i in (90, 91, 92, 93))
    for i, v in enumerate(made.values()):
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps(v)])).withColumn("conv_id", F.lit(i)) if False else spark.createDataFrame([(json.dumps(v),)], "j string").select(F.from_json("j", F.schema_of_json(F.lit(json.dumps(v)))).alias("x"), F.lit(i).alias("conv_id")).select("x.*", "conv_id")
        assert [(r.role, r.text) for r in chat.turns_of(df).orderBy("turn").collect()] == turns
    with pytest.raises(ValueError):
        chat.turns_of(spark.range(1))


# 3 -------------------------------------------------------------------------------------------------


def test_license_canonical(spark, odd, none):
    mit = dict(license.KNOWN[:1])["MIT"]
    same = "Copyright (c) 2020 Some One. All rights reserved.\r\n\r\n" + mit.upper().replace(",", " ,") + "\n(c) 1999 X\n"
    rows = [(1, same), (2, mit + " and more"), (3, "RELEASED under the MIT licence!"), (4, None), (4, ""), (5, "copyright holders")]
    got = [(r.doc_id, r.licence) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, "MIT"), (2, None), (3, "MIT"), (4, None), (4, None), (5, None)]
    spelt = [f"{a} {a} x {b}" for a, b in license.EQUIVALENT] + ["Licence-LICENCE licence sub licence sub-licence"]
    back = [f"{b} {b} x {b}" for _, b in license.EQUIVALENT] + ["license license license sublicense sublicense"]
    for one, two in zip(*([r.c for r in spark.createDataFrame(list(enumerate(x)), "i int, text string").orderBy("i").select(license.canonical(F.col("text")).alias("c")).collect()] for x in (spelt, back))):
        assert one == two
    assert license.scan(odd).count() == len(ODD) and license.scan(none).count() == 0


def test_license_full_texts(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / f).exists() for f in want):
        pytest.skip("no licence texts here")
    rows = [(i, (folder / f).read_text().replace("\n", "\r\n")) for i, f in enumerate(want)] + [(99, (folder / "GPL-3").read_text()[:-200])]
    got = {r.doc_id: r.licence for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(want.values())), 99: None}


# 4 -------------------------------------------------------------------------------------------------


def brute_verdict(url, rules, listed):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = m[2].translate(str.maketrans(common.UPPER, common.LOWER)) if m else ""
    path = m[3] if m else ""
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "block" if url in listed else "allow")


@pytest.mark.parametrize("few", [100_000, 0])
def test_urls_against_brute_force(spark, sf_dir, few):
    us = ["http://A.Example.NET/en/x?y", "https://example.net", "http://net/", "x://org/fr/", "ftp://Sub.ORG/fr/a#b", "nohost", None, "", "http://u@h.net:80/de/", "http://example.com/de/", "http://xexample.com/de/", "://net/q", "http://spam.test/a/", "http://a\nb.net/\nc", "http:///en/"]
    us += [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rules = [*queries.RULES, ("test", "/a/b", "allow"), ("spam.test", "/", "allow"), ("", "", "allow")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(us + us)], "page_id long, url string, host string, block int")
    listed = {"http://spam.test/a/"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in listed], "url string"), few).collect()}
    assert len(got) == 2 * len(us)
    for i, u in enumerate(us + us):
        assert got[i] == brute_verdict(u, rules, listed), u
    if not few:
        stats = {}
        many = spark.range(3000).select(F.format_string("http://h%d.test/", "id").alias("url"))
        near = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.test/x", "id").alias("url"))
        got = urls.judge(near.unionByName(spark.createDataFrame([(9000 + i, None) for i in range(50)], "page_id long, url string")), spark.createDataFrame([("h7.test", "/x", "block")], "host string, path string, verdict string"), many, 0, stats)
        assert [r.page_id for r in got.where("verdict = 'block'").collect()] == [7] and got.count() == 3050
        assert stats["listed"] == 1 < stats["possible"] < 2000  # the exact join has removed false positives
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_listed_urls_are_canonical(spark):
    pages = spark.createDataFrame([(1, "https://WWW.a.b:443/x/?utm_source=q&k=1#f"), (2, "http://a.b/x?k=1"), (3, "http://a.b/x")], "page_id long, url string")
    out = urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), pages.where("page_id = 2")).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "block", "allow"]


# 5 -------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs = docs_of(spark, d)
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    ids = spark.createDataFrame([(i,) for i in labels], "doc_id long")
    got = [(labels[r.doc_id], r.toxicity) for r in toxicity.score(docs.join(ids, "doc_id"), model).collect()]
    hit = sum(y and s >= 0.5 for y, s in got)
    assert hit / sum(y for y, _ in got) > 0.88 and hit / sum(s >= 0.5 for _, s in got) > 0.88


def test_toxicity_folding_and_exceptions(spark, odd, none):
    m = toxicity.Model({"idiot": 4.0, "trash": 4.0}, {"worthl": 4.0})
    clean = m.score("a quite ordinary sentence")
    for t in ("an idiot", "an ID10T", "аn іdiоt", "tr@sh", "so worthless!", "tra$h"):
        assert m.score(t) > clean, t
    for t in ("put it in the trash can", "idiots", "unworthless", None, ""):
        assert m.score(t) == clean, t
    assert m.score("idiot " + "word " * 50) < m.score("idiot " + "word " * 5)
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, labels))
    assert out.count() == len(ODD) and out.columns.count("toxicity") == 1
    assert toxicity.score(none, m).count() == 0
    assert toxicity.fit(none, labels.limit(0)).words


def naive_matches(model, text):
    """(weight, place) of each word, without an automaton: the whole words' and beginnings' largest weight, unless inside an exception."""
    words = toxicity.fold(text)
    out = {}
    for i, w in enumerate(words):
        best = max([model.words.get(w, 0.0), *(x for p, x in model.prefixes.items() if w.startswith(p))])
        if best > 0:
            out[i] = best
    for e in (toxicity.fold(e) for e in model.exceptions):
        for i in range(len(words) - len(e) + 1):
            if words[i : i + len(e)] == e:
                for j in range(i, i + len(e)):
                    out.pop(j, None)
    return out, len(words)


@pytest.mark.parametrize("text", ["ïdiot", "ıdiot", "id\u200biot", "i\u00addiot", "i.d.i.o.t", "I D I O T", "i\u0308d\u0323iot", "ＩＤＩＯＴ", "ɪᴅɪᴏᴛ", "1d10t", "іԁіοт", "such an i d i o t!", "ⓘⓓⓘⓞⓣ"])
def test_toxicity_folds_disguises(text):
    assert "idiot" in toxicity.fold(text)
    assert toxicity.Model({"idiot": 4.0}, {}).features(text)[0] > 0


def test_toxicity_folding_leaves_other_words_alone():
    assert toxicity.fold("I am of the U.S. today; a b") == ["i", "am", "of", "the", "u", "s", "today", "a", "b"]
    assert toxicity.fold("U.S.A. 한국어 2\u200d") == ["usa", "한국어"]
    assert len(toxicity.fold("a " * 2_000_000)[0]) == 2_000_000 and toxicity.fold(None) == toxicity.fold("\u200b .") == []


def test_toxicity_scores_against_a_naive_matcher(spark, sf_dir):
    docs, labels = docs_of(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    model.words |= {"can": 1.0, "x" * 60: 2.0}
    hits = 0
    extra = ["the trash can is an idiot", "village idiot pub idiot", "x" * 60, "trash trash can", None, ""]
    for r in toxicity.score(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(extra)], "doc_id long, text string")), model).collect():
        got, n = naive_matches(model, r.text)
        hits += bool(got)
        total, n = sum(got.values()), max(n, 1)
        z = model.bias + model.slopes[0] * np.log1p(total) + model.slopes[1] * np.sqrt(total / n) + model.slopes[2] * np.log1p(100 * len(got) / n)
        assert r.toxicity == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
    assert hits > 10


# 6 -------------------------------------------------------------------------------------------------


def edits(a, b):
    """Least edits from a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def passage_within(item, text, width, budget):
    """Whether any ``width`` characters of the item, wherever they begin, are within the budget of a stretch of the text."""
    return any(edits(item[s : s + width], text) <= budget for s in range(len(item) - width + 1))


def test_decontamination_against_brute_force(spark, odd, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    items = [(i, words(16)) for i in range(8)] + [(20, "zshort one here"), (21, None), (22, ""), (0, None), (23, "zed middling item of under fifty")]
    rows, want = [], set()
    for i in range(60):
        t = words(12)
        if i % 3:
            item, passage = items[i % 8]
            at = rng.randrange(len(passage) - 52)
            passage = list(passage[at : at + 52])
            for _ in range((i % 4) * 2):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([["z"], [], [passage[at], "q"]])
            t = f"{t}\n{''.join(passage).upper()}  {words(12)}"
        rows.append((i, t))
        for item, text in items:
            plain = decontam.normalise(text)
            if len(plain) >= 50 and passage_within(plain, decontam.normalise(t), 50, 3):
                want.add((i, item))
    rows += [(100, "a Zshort  one here!"), (101, "zshort one hereabouts"), (102, f"x {items[-1][1]} y"), (103, f"x {items[-1][1][:-1]}x y")]
    want |= {(100, 20), (102, 23), (103, 23)}
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[1]], "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + sum(a == rows[1][0] for a, _ in want)
    assert len({a for a, _ in want}) > 25
    several = decontam.contaminated(df, bench, pass_chars=300)
    assert {(r.doc_id, r.item_id) for r in several.collect()} == want
    text = dict(rows)
    for r in got:
        assert edits(decontam.normalise(dict((k, v) for k, v in items if v)[r.item_id])[r.item_start : r.item_end][:50], decontam.normalise(text[r.doc_id][max(0, r.start - 8) : r.end + 8])) <= 3
        assert r.end - r.start < 80
    clean = len(rows) - len({a for a, _ in want})
    assert decontam.drop_contaminated(df.where("doc_id <> 1"), bench).count() == clean - (1 not in {a for a, _ in want}) == decontam.drop_contaminated(df.where("doc_id <> 1"), bench, pass_chars=300).count()
    # Each row is judged by its own text: sharing a doc_id, or having none, takes no clean row along.
    bad, good = text[100], text[0]
    shared = spark.createDataFrame([(7, bad), (7, good), (None, bad), (None, good), (None, None), (7, "")], "doc_id long, text string").withColumn("_id", F.lit("x")).withColumn("item_id", F.lit("y"))
    assert Counter(map(tuple, decontam.drop_contaminated(shared, bench).collect())) == Counter((i, t, "x", "y") for i, t in [(7, good), (None, good), (None, None), (7, "")])
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.drop_contaminated(odd, bench).count() == len(ODD)
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_passes_are_bounded(spark):
    """Neither items without an id, nor one id, nor one long item makes a large pass; one index is alive at a time."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(None, words(20)) for _ in range(100)] + [(1, words(20)) for _ in range(50)] + [(2, words(2000)), (3, None), (4, ""), (5, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = [(sum(len(c) for *_, c in index.pieces), last) for index, last in decontam._indexes(bench, 2000)]
    assert max(n for n, _ in sizes) < 2000 + 4 * decontam.WIDTH and [last for _, last in sizes] == [False] * (len(sizes) - 1) + [True] and len(sizes) > 10
    long = items[150][1]
    docs = [(i, f"{words(5)} {t[:60] if i < 150 else long[7000:7080]} {words(5)}") for i, t in ((i, t) for i, (_, t) in enumerate(items[:151]))] + [(999, words(40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [sorted((r.doc_id, r.item_id if r.item_id is not None else -1, r.start, r.end, r.item_start) for r in decontam.contaminated(df, bench, n).collect()) for n in (2000, 10**6)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} == set(range(151))
    assert [r.doc_id for r in decontam.drop_contaminated(df, bench, 2000).collect()] == [999]


def test_decontamination_finds_passages_wherever_they_begin():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    items = [words(60) for _ in range(30)]
    index = decontam.Index.of_items(list(enumerate(items)))
    for length in (50, 60, 80, 120):
        for share in (0, 2):
            found = 0
            for _ in range(60):
                k = rng.randrange(30)
                at = rng.randrange(len(items[k]) - length)
                p = list(items[k][at : at + length].strip().ljust(length, "x") if share else items[k][at : at + length])
                for _ in range(share * length // 50):
                    p[rng.randrange(len(p))] = "z"
                found += k in {r[0] for r in decontam.find(index, f"{words(50)} {''.join(p)} {words(50)}")}
            assert found >= (59 if share else 60), (length, share, found)


def test_decontamination_gives_a_row_for_each_region():
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    item, gap = words(60), words(400)
    index = decontam.Index.of_items([(1, item)])
    a, b = item[:90], item[200:300].strip()
    t = f"{gap} {a} {gap} {b} {gap} {a}"
    got = decontam.find(index, t)
    assert [t[r[4] : r[5]].strip() for r in got] == [a.strip(), b, a.strip()] and all(r[1] == 0 for r in got)
    assert decontam.original_spans("  A  b\tC ", [(0, 1), (2, 5), (0, 5)]) == [(2, 3), (5, 8), (2, 8)]


def test_decontamination_of_repetitive_texts():
    index = decontam.Index.of_items([(1, "a" * 1500), (2, "xyz hello " * 60)])
    got = decontam.find(index, "a" * 3000 + " clean words " + "xyz hello " * 100)
    assert [(r[0], r[1]) for r in got] == [(1, 0), (2, 0)] and got[0][4] == 0 and 3000 <= got[0][5] <= 3003


# 7 -------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius):
    out = list(range(len(fps)))

    def find(i):
        while out[i] != i:
            i = out[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                out[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    least = {}
    for g in groups.values():
        m = min((ids[i] for i in g if ids[i] is not None), default=None)
        least |= {i: m for i in g}
    return [least[i] for i in range(len(fps))]


@pytest.mark.parametrize("tree_rows", [8192, 8])
def test_simhash_against_brute_force(spark, odd, none, tree_rows):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 60, 400)))] for _ in range(60)]
    texts = []
    for w in base:
        texts.append(" ".join(w))
        for _ in range(3):
            w = w[:]
            w[rng.randrange(len(w))] = "Changed"
            texts.append("\t".join(w))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + ODD
    df = spark.createDataFrame(rows, DOCS)
    got = simhash.near_duplicates(df, tree_rows=tree_rows).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = Counter(zip((r[0] for r in rows), fps, brute_components(fps, [r[0] for r in rows], 4)))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert max(Counter(r.component_id for r in got).values()) > 3
    assert simhash.near_duplicates(none).count() == 0


def brute_similar(texts: list) -> tuple[list, set]:
    """A class for each text, and the links: equal texts, contract fingerprints within 4 bits, or 0.8 of the five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    fps = [brute_fingerprint(t) for t in texts]
    root, links = list(range(len(texts))), set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if (fps[i] ^ fps[j]).bit_count() <= 4 or small >= 0.8 * large > 0 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links.add((j, i))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("tree_texts", [2048, 8])
def test_similar_against_brute_force(spark, odd, none, tree_texts):
    rng = random.Random(11)
    texts = ["", None, "one", "One", " one\t", "two words"]
    for _ in range(40):
        w = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.choice((60, 150, 400, 2500)))]
        for edits in (0, 0, 0.004, 0.012, 0.02, 0.03, 0.1):
            v = [x for x in w if rng.random() >= edits / 2]
            v = ["".join(("Z", x)) if rng.random() < edits / 2 else x for x in v]
            texts.append(" ".join(v))
    classes, links = brute_similar(texts)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.root for r in simhash.similar(df, tree_texts=tree_texts).collect()}
    assert len(got) == len(texts)
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.98 * len(links), (found, len(links))
    wrong = sum(classes[a] != classes[b] for c in set(got.values()) for m in [[i for i in got if got[i] == c]] for a, b in zip(m, m[1:]))
    assert not wrong
    kept = {r.doc_id for r in simhash.keep_one(df, tree_texts=tree_texts).collect()}
    assert kept == {min(i for i in got if got[i] == c) for c in set(got.values())}
    assert simhash.similar(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_similar_finds_passages_cut_off_or_added(spark):
    rng = random.Random(23)
    words = lambda n: [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(n)]
    texts = []
    for _ in range(50):
        w = words(rng.choice((60, 150, 400, 900)))
        n, p = len(w), rng.randrange(len(w) * 4 // 5)
        m = n * 17 // 100
        texts += [w, w[m:], w[: n - m], w[:p] + w[p + m :], w + words(m), w[:p] + words(m // 2) + w[p:]]
    texts = [" ".join(w) for w in texts]
    links = [(a, b) for a, b in brute_similar(texts)[1] if a % 6 == 0]
    assert len(links) > 200
    got = {r.doc_id: r.root for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in links), sum(got[a] != got[b] for a, b in links)


def test_keep_one_with_odd_rows(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(brute_similar([r[1] for r in ODD])[0]))
    same_id = [(1, "a b c d e f", None, None, None), (1, "quite another text here today", None, None, None), (None, "x y z u v w", None, None, None), (None, "no id either", None, None, None), (None, "no id either", None, None, None)]
    assert simhash.keep_one(spark.createDataFrame(same_id, DOCS)).count() == 4


def test_shingles_are_compared_whole():
    rng = random.Random(3)
    w = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    v = [x if rng.random() > 0.02 else x + "z" for x in w]
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
    share = len(a & b) / len(a | b)
    x, y = (simhash.shingle_set(simhash.words_of(" ".join(t))) for t in (w, v))
    assert simhash.similar_shingles(x, y, share - 1e-6) and not simhash.similar_shingles(x, y, share + 1e-6)


def test_large_families_and_clashing_numbers(spark, monkeypatch):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base = words(200)
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(150)]
    chain = words(300)
    texts += [" ".join(chain[5 * k : 5 * k + 200]) for k in range(21)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_similar(texts)
    got = {r.doc_id: r.root for r in simhash.similar(df, tree_texts=16).collect()}
    assert all(got[a] == got[b] for a, b in links) and len(set(got.values())) == len(set(classes))
    hashes = simhash._hashes()
    monkeypatch.setattr(simhash, "_hashes", lambda: (F.pmod(hashes[0], F.lit(20)), hashes[1]))
    assert simhash.keep_one(df).count() == len(set(classes))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (-3, -9)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[-3] == -9


def test_bk_tree_links_what_brute_force_links():
    rng = random.Random(9)
    xs = [rng.getrandbits(64) for _ in range(40)]
    xs += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in xs for _ in range(3)]
    for left, right in ((xs, []), (xs[:70], xs[70:])):
        links = simhash.shard_links(left, right, 4)
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        ids = {x: i for i, x in enumerate(dict.fromkeys(left + right))}
        if not right:
            root = {i: i for i in ids.values()}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                root[find(ids[a])] = find(ids[b])
            want = brute_components(list(ids), list(ids.values()), 4)
            assert all((find(i) == find(j)) == (want[i] == want[j]) for i in range(len(ids)) for j in range(i))


# 8 -------------------------------------------------------------------------------------------------


def test_sharding_keeps_the_law_and_gathers_links(spark, odd, none):
    rows = [(i, f"text {i}") for i in range(700)] + [(i, "hot") for i in range(700, 1100)] + [(2000 + i, f"pair {i // 3}") for i in range(150)] + [(9, "text 9"), (None, None), (1, "")]
    got = shard.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert len(got) == len(rows)
    n = Counter(r["shard"] for r in got)
    assert set(n) <= set(range(10)) and max(n.values()) - min(n.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    for r in got:
        if r.doc_id and r.doc_id >= 2000:
            where[(r.doc_id - 2000) // 3].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert len({r["shard"] for r in got if r.text_crc32 == zlib.crc32(b"hot")}) <= 8
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(22, zlib.crc32(b"text 1")), (16, 0)}
    assert shard.assign(odd, 3).count() == len(ODD) and shard.assign(none).count() == 0


def test_sharding_gathers_links_where_nearly_all_rows_have_some(spark):
    rows = [(i, f"pair {i // 2}" if i < 3900 else f"text {i}") for i in range(4000)]
    got = shard.assign(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {400}
    where = defaultdict(set)
    for r in got:
        if r.doc_id < 3900:
            where[r.doc_id // 2].add(r["shard"])
    assert sum(len(v) == 1 for v in where.values()) >= 0.9 * len(where)


def test_ranks_of_rows_that_are_all_alike(spark):
    df = common.cut(spark.createDataFrame([(k, 1 if i < 900 else i, "t") for k in "ab" for i in range(1000)], "k string, doc_id long, t string"))
    got = common.with_rank(df, ["k"], ["doc_id", "t"], 1000, "rank", per_bucket=10).collect()
    assert {k: sorted(r["rank"] for r in got if r.k == k) for k in "ab"} == {k: list(range(1000)) for k in "ab"}
    same = spark.createDataFrame([(None, "all the same")] * 3000, "doc_id long, text string")
    n = Counter(r["shard"] for r in shard.assign(same, 7).collect())
    assert sum(n.values()) == 3000 and max(n.values()) - min(n.values()) <= 1


def test_quotas_never_break_the_counts():
    rng = random.Random(2)
    for _ in range(1000):
        n = rng.randint(1, 6)
        want = [[rng.randrange(9) if a != b else 0 for b in range(n)] for a in range(n)]
        free, linked = ([rng.randrange(rng.choice((1, 9))) for _ in range(n)] for _ in range(2))
        have = [free[s] + linked[s] + sum(want[s]) for s in range(n)]
        grant, pay = shard.quotas(want, have, list(free), list(linked))
        after = [have[s] + sum(g[s] for g in grant) - sum(grant[s]) for s in range(n)]
        for b, kind, lo, hi, to in pay:
            assert 0 <= lo < hi <= (free[b] if kind == shard.STAY_FREE else linked[b] if kind == shard.STAY_LINKED else want[b][kind])
            assert kind < 0 or lo >= grant[b][kind]
            after[b] -= hi - lo
            after[to] += hi - lo
        assert all(grant[a][b] <= want[a][b] for a in range(n) for b in range(n))
        assert max(after) - min(after) <= 1


# 9 -------------------------------------------------------------------------------------------------


def test_targets_share_the_excess(spark):
    rng = random.Random(4)
    for sizes in ([5, 1000, 30, 0, 200], [10], [0, 0], [rng.randrange(1, 10_000) for _ in range(12)]):
        rows = [(f"s{i:02}" if i else None, s) for i, s in enumerate(sizes)]
        order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
        w = {r[0]: (5, 2, 1)[i % 3] for i, r in enumerate(order)}
        want, left = {r[0]: 0.0 for r in rows}, float(sum(sizes))
        stop = {r[0]: 3.0 * r[1] for r in rows}
        while left > 1e-9:
            open_ = [s for s in want if want[s] < stop[s] - 1e-9]
            total = sum(w[s] for s in open_)
            given = {s: min(stop[s] - want[s], left * w[s] / total) for s in open_}
            for s in open_:
                want[s] += given[s]
            left -= sum(given.values())
        got = {r.source: r.target for r in mix.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_mix_comes_near_targets(spark, sf_dir, odd, none):
    docs = docs_of(spark, "/root/testdata/sf0.1")
    plan = mix.plan(docs).collect()
    taken, spread, aim = Counter(), Counter(), {}
    for r in plan:
        rate = r.target / r.source_size
        taken[r.source] += r.size * r.copies
        spread[r.source] += r.size**2 * (rate % 1) * (1 - rate % 1)
        aim[r.source] = r.target
        assert int(rate) <= r.copies <= min(3, int(rate) + 1)
    for s in aim:
        assert abs(taken[s] - aim[s]) <= 4 * spread[s] ** 0.5 + 1
    assert sum(abs(taken[s] / aim[s] - 1) for s in aim) / len(aim) < 0.05
    emitted = {(r.doc_id): r["count"] for r in mix.mix(docs).groupBy("doc_id").count().collect()}
    assert emitted == {r.doc_id: r.copies for r in plan if r.copies}
    assert mix.plan(odd).count() == len(ODD) and mix.mix(odd).columns == odd.columns and mix.plan(none).count() == 0 and mix.mix(none).count() == 0


def test_mix_draws_for_each_row(spark, monkeypatch):
    monkeypatch.setattr(mix, "CHUNK", 64)
    rows = [(None, f"w {i} w", "a") for i in range(800)] + [(None, "same words here", "b")] * 400 + [(5, "x y z", "c")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mix.plan(docs)
    assert plan.count() == len(rows)
    out = mix.mix(docs.withColumn("_own", F.lit(1)).withColumn("_part", F.lit(1)))
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.sum("copies").alias("n")).collect():
        assert abs(r.taken - r.target) < 0.1 * r.target
        assert out.where(F.col("source") == r.source).count() == r.n
    assert Counter(map(tuple, mix.mix(docs).collect())) == Counter(map(tuple, mix.mix(docs.repartition(3)).collect()))


def test_targets_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mix, "FEW_SOURCES", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 500).alias("source"))
    plan = mix.plan(docs)
    want = duckdb.connect()
    want.register("documents", docs.toPandas())
    got = {tuple(r) for r in plan.select("doc_id", "target").collect()}
    assert got == {(a, b) for a, b in want.execute(f"SELECT doc_id, target FROM ({queries.ORACLES['op9_mixing']})").fetchall()}
    assert mix.mix(docs).count() == plan.agg(F.sum("copies")).first()[0]


# 10 ------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, sf_dir, odd, none):
    encode = pack.tokenizer(bpe.read_ranks(pack.VOCABULARY))
    for df, size in ((docs_of(spark, sf_dir), 2048), (odd, 512), (odd, 1)):
        packed = pack.pack(df, size, batch_tokens=20_000).collect()
        pieces = []
        for r in packed:
            ids, cu, pos = np.frombuffer(r.ids, "<u4"), r.cu_seqlens, np.frombuffer(r.position_ids, "<u4")
            assert len(ids) == len(pos) == size and cu[0] == 0 and cu[-1] == r.n_tokens <= size
            for k, (a, b) in enumerate(zip(cu, cu[1:])):
                assert pos[a:b].tolist() == list(range(b - a))
                pieces.append((r.doc_ids[k] if r.doc_ids[k] is not None else -1, r.piece_starts[k], r.piece_lasts[k], ids[a:b].tolist()))
        whole, open_ = Counter(), defaultdict(list)
        for doc, start, last, ids in sorted(pieces, key=lambda p: (p[0], p[1], str(p[3]))):
            open_[doc].append((start, last, ids))
        rows = Counter((r.doc_id if r.doc_id is not None else -1, *encode(r.text or ""), pack.END) for r in df.collect())
        for doc, parts in open_.items():
            if len([p for p in parts if p[0] == 0]) == 1:
                assert [p[0] for p in parts] == list(range(0, len(parts) * size, size)) and [p[1] for p in parts].count(True) == 1
                whole[(doc, *sum((p[2] for p in parts), []))] += 1
            else:
                whole.update((doc, *p[2]) for p in parts if size > 1)
        assert size == 1 or whole == rows
        assert sum(r.n_tokens for r in packed) == sum(len(k) * v - v for k, v in rows.items())
        assert len({r.pack_id for r in packed}) == len(packed)
    assert pack.pack(none).count() == 0


def test_packing_a_text_longer_than_a_batch(spark):
    df = spark.createDataFrame([(1, "word " * 9000), (2, "a"), (None, "b")], "doc_id long, text string").withColumn("ids", F.lit("x"))
    packed = pack.pack(df.coalesce(1), 512, batch_tokens=1000).collect()
    ids = [np.frombuffer(r.ids, "<u4")[a:b].tolist() for r in sorted(packed, key=lambda r: r.pack_id) for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])) if r.doc_ids[k] == 1]
    starts = [r.piece_starts[k] for r in sorted(packed, key=lambda r: r.pack_id) for k in range(len(r.doc_ids)) if r.doc_ids[k] == 1]
    whole = sum((i for _, i in sorted(zip(starts, ids))), [])
    assert whole == [*pack.tokenizer(bpe.read_ranks(pack.VOCABULARY))("word " * 9000), pack.END]


@pytest.mark.parametrize("sign", [" ", "\n", "x", "é", "a b"])
def test_packing_texts_that_the_library_cannot_take(spark, sign):
    """A million blanks overflow the library's stack; here they are one match of five million."""
    import tiktoken

    ranks = bpe.read_ranks(pack.VOCABULARY)
    text = sign * (250_000 // len(sign)) + "a"
    assert pack.tokenizer(ranks)(text) == tiktoken.Encoding("own", pat_str=pack.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    rows = pack.pack(spark.createDataFrame([(1, sign * (5_000_000 // len(sign)) + "a"), (2, "b")], "doc_id long, text string")).collect()
    decode = bpe.Bpe(ranks, "").decode
    parts = sorted((d, at, r.ids[4 * a : 4 * b]) for r in rows for d, at, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]))
    whole = b"".join(bytes(x) for d, _, x in parts if d == 1)
    assert decode(whole[:-4]).decode() == sign * (5_000_000 // len(sign)) + "a"


def test_best_fit_decreasing_against_linear_search():
    rng = random.Random(7)
    for cap in (1, 7, 64, 100):
        sizes = [rng.randint(1, cap) for _ in range(300)]
        rows = pack.best_fit_decreasing(sizes, cap)
        left = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, x in enumerate(left) if x >= s]
            if fit:
                left[min(fit, key=lambda i: left[i])] -= s
            else:
                left.append(cap - s)
        assert sorted(i for r in rows for i in r) == list(range(300)) and sorted(cap - sum(sizes[i] for i in r) for r in rows) == sorted(left)


# pipeline ------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = docs_of(spark, sf_dir)
    at = docs
    for _, stage in p.STAGES[:-1]:
        out = common.cut(stage(spark, at, sf_dir))
        assert out.schema.names == docs.schema.names
        assert out.select("doc_id").join(at.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if stage is p.drop_near_duplicates:
            assert out.count() == len(set(brute_similar([r.text for r in at.collect()])[0]))
        at = out
    packed = p.run(spark, sf_dir)
    want = Counter()
    for r in at.collect():
        want[r.doc_id] += 1
    got = Counter()
    for r in packed.collect():
        got.update(d for d, s in zip(r.doc_ids, r.piece_starts) if s == 0)
    assert got == want and hashlib
