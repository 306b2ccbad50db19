"""Fixtures with known answers, and small models for folds and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import registry, scalar, text, vectors
from lodestone.operators import aggregates as agg
from lodestone.operators import diff, graph, graph_index, joins, ranking, text_search, windows
from lodestone.plans import catalog
from lodestone.sources import files, stores
from lodestone.streaming import changes


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


# Vectors and ranking


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.99, 0.01, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])], "chunk_id long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<float>")
    got = ranking.dense_top_k(q, v, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2] and got[0].score > 0.99
    assert [r.chunk_id for r in ranking.dense_top_k(q.unionByName(q.withColumn("query_id", F.lit(1).cast("long"))), v, 1, few=1).collect()] == [1, 1]
    assert abs(one(spark, vectors.dot(vectors.l2_normalise("v"), vectors.l2_normalise("v")), v=[3.0, 4.0]) - 1) < 1e-5
    assert one(spark, vectors.l2_normalise("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.dot("a", "b"), a=[1.0, 2.0, 3.0], b=[4.0, 5.0]) == 14.0


def test_ann_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    key = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, near = key(ranking.dense_top_k(q, v, 10)), key(ranking.ann_top_k(q, v, 10))
    assert len(exact & near) / len(exact) >= 0.9


def test_ann_recall_of_the_registered_query(spark, sf_dir):
    exact, near = ({(r.query_id, r.chunk_id) for r in catalog.QUERIES[n](spark, sf_dir).collect()} for n in ("dense_topk", "ann_topk"))
    assert len(exact & near) / len(exact) >= 0.9


def test_rerank_skips_small_lists_and_flat_scores(spark):
    hits = spark.createDataFrame([(1, "foo bar", i, t, s, i) for i, (t, s) in enumerate([("x", 1.0), ("foo", 1.0), ("foo bar", 1.0)], 1)], "query_id int, query_text string, chunk_id int, text string, score double, rank int")
    assert column(ranking.rerank(hits, 3), "chunk_id", "rank") == [1, 2, 3]
    got = ranking.rerank(hits, 2).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [(3, 1.0), (2, 0.85)]


def test_cap_per_group_model(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(1, rng.choice(["A\\b", "a/B", "c", ""]), r) for r in range(12)]
        cap, k = 2, 7
        seen, picked, rest = {}, [], []
        for _, g, r in rows:
            g = g.lower().replace("\\", "/")
            if not g or seen.get(g, 0) < cap:
                seen[g] = seen.get(g, 0) + 1
                picked.append(r)
            else:
                rest.append(r)
        got = windows.cap_per_group(spark.createDataFrame(rows, "q int, g string, rank int"), "q", "g", "rank", cap, k)
        assert column(got, "rank", "pick") == (picked + rest)[:k]


def test_oversample_and_routes(spark):
    f = lambda k, route, on: one(spark, scalar.retrieve_k(F.lit(k), F.lit(route), F.lit(on)))
    assert [f(12, "all", True), f(12, "doc", True), f(12, "doc", False), f(20, "git", True)] == [12, 48, 12, 64]
    assert one(spark, text.targets(F.lit("read the README guide"))) == ["doc_chunk"] and one(spark, text.targets(F.lit("hm"))) == ["all"]
    assert one(spark, text.git_mode(F.lit("show last commit"))) == "recent_commits" and one(spark, text.git_mode(F.lit("what files did I modify"))) == "working_diff"
    assert one(spark, text.sub_questions(F.lit("where is the parser defined; how does it report its errors"))) == ["where is the parser defined", "how does it report its errors"]
    assert one(spark, text.sub_questions(F.lit("short; one"))) == ["short; one"]
    assert registry.sub_questions_with(lambda q: 1 / 0, "q", lambda q: [q]) == ["q"] and registry.sub_questions_with(lambda q: ["a"], "q", list) == ["a"]
    assert one(spark, text.intent(F.lit("explain this"))) == "fast" and one(spark, text.intent(F.lit("explain the crash"))) == "reasoning" and one(spark, text.intent(F.lit(" "))) == "code"
    assert one(spark, text.route_model(F.lit("debug it"), {"reasoning": "big"}, "small")) == "big"
    assert one(spark, text.complexity(F.lit("compare both"))) == "complex" and one(spark, text.is_fatal_embedding_error(F.lit("x ECONNREFUSED y")))


# Text


def test_sparse(spark):
    assert set(one(spark, text.sparse_tokens(F.lit("verify_signature USE_SSL commit a1b2c3d4")))) >= {"verify_signature", "use_ssl", "a1b2c3d4"}
    df = spark.createDataFrame([(1, "PaymentService verify_signature"), (2, "")], "id int, text string")
    w = {r.id: r.sparse for r in text.sparse_map(df, "id", "text").collect()}
    assert len(w[1]) >= 2 and all(0 < x <= 1 for x in w[1].values()) and w[2] == {}
    assert one(spark, text.token_bucket(F.lit("paymentservice"))) == 835488


def test_header_and_fences(spark):
    src = "/*\n * Copyright X\n */\n\nimport a;\n// Licence talk\n"
    r = one(spark, text.strip_header("t"), t=src)
    assert r.body.startswith("import a;") and r.header_lines == 4
    assert one(spark, text.strip_header("t"), t="// plain comment\ncode();").header_lines == 0
    assert one(spark, text.strip_header("t"), t="# SPDX-License-Identifier: MIT\n# more\n\ndef f():\n  pass").header_lines == 3
    assert one(spark, text.strip_diagrams("t"), t="a\n```mermaid\nx\ny\n```\nb") == "a\n[mermaid diagram omitted — 4 lines]\nb"
    long = "\n".join(f"l{i}" for i in range(60))
    out = one(spark, text.compact_code("t"), t=long).split("\n")
    assert len(out) == 37 and out[28] == "/* ... 24 lines omitted ... */"
    assert one(spark, text.compact_code("t"), t="f {\n" + "\n".join("x" * 50 for _ in range(6)) + "\n}") == "f {\n  /* ... 6 lines ... */\n}"


def test_links_and_breadcrumbs(spark):
    t = "[a](../src/x.ts#L1) ![i](p.png) [w](https://e.org) [m](mailto:x) [h](#q) <b.md>"
    assert one(spark, text.markdown_links("t", "p"), t=t, p="docs/guide/a.md") == ["docs/guide/b.md", "docs/src/x.ts"]
    assert [(x.kind, x.label, x.href) for x in one(spark, text.linked_text("t"), t='see [a](http://x "T") end')] == [("text", "see ", None), ("link", "a", "http://x"), ("text", " end", None)]
    assert one(spark, text.header_breadcrumb(F.create_map(*(F.lit(x) for x in ("Header_10", "c", "Header_2", "b", "x", "y"))))) == "b > c"
    assert one(spark, text.leading_comment_start("l", "s"), l=["x", "/**", " * d", " */", "", "def"], s=6) == 2


def test_lines_and_case(spark):
    assert one(spark, text.path_range(F.lit("file.txt:20:3"))).asDict() == {"path": "file.txt", "line": 20, "column": 3}
    assert one(spark, text.path_range(F.lit("a/file.txt(19,20)"))).asDict() == {"path": "a/file.txt", "line": 19, "column": 20}
    assert one(spark, text.path_range(F.lit("file.txt:7"))).line == 7 and one(spark, text.path_range(F.lit("file.txt"))) is None
    assert one(spark, text.normalise_indent(F.lit(" \tx"), 4, True)) == "    x" and one(spark, text.normalise_indent(F.lit("      x"), 4, False)) == "\t  x"
    assert one(spark, text.word_at(F.lit("foo bar_baz"), F.lit(6))).word == "bar_baz" and one(spark, text.word_at(F.lit("  "), F.lit(1))) is None
    assert [one(spark, text.offset_of(F.lit("ab\ncde"), F.lit(a), F.lit(b))) for a, b in ((1, 1), (2, 2), (2, 99), (9, 1), (0, 1))] == [0, 4, 6, 6, 0]
    for m, n, want in (("ABC", "def", "DEF"), ("abc", "Def", "def"), ("Abc", "def", "Def"), ("Foo-Bar", "new-name", "New-Name"), ("FOO_bar", "new_name", "NEW_name"), ("aBC", "DEF", "dEF"), ("", "x", "x")):
        assert one(spark, text.preserve_case(F.lit(m), F.lit(n))) == want
    assert one(spark, text.eol_stats(F.lit("a\r\nbcd\nx"))).asDict() == {"count": 2, "first": 1, "last": 1, "kinds": 3}
    assert one(spark, text.remove_accents("t"), t="éàñ") == "ean" and one(spark, text.mime(F.lit("a/b.HTML"))) == "text/html" and one(spark, text.grammar(F.lit("x.tsx"))) == "tsx"
    assert one(spark, text.mime_matches(F.lit("image/*"), F.lit("image/png"))) and not one(spark, text.mime_matches(F.lit("image/*"), F.lit("text/png")))
    assert one(spark, text.token_estimate(F.lit("漢" * 100))) > one(spark, text.token_estimate(F.lit("a" * 400))) / 2
    assert one(spark, text.char_class(F.lit("b"), {"ab": 1, "c": 2}, 0)) == 1


def test_scalars(spark):
    assert one(spark, scalar.percent_label(F.lit(0.999))) == "99%" and one(spark, scalar.percent_label(F.lit(1.0))) == "100%"
    assert one(spark, scalar.saturate(F.lit(5e9), 32)) == 2**32 - 1 and one(spark, scalar.saturate(F.lit(-1), 8)) == 0
    assert one(spark, scalar.in_triangle(F.lit(1.0), F.lit(1.0), 0, 0, 4, 0, 0, 4)) and not one(spark, scalar.in_triangle(F.lit(4.0), F.lit(4.0), 0, 0, 4, 0, 0, 4))
    ago = lambda s: one(spark, scalar.age_label(F.timestamp_seconds(F.lit(1_000_000_000 - s)), F.timestamp_seconds(F.lit(1_000_000_000))))
    assert [ago(5), ago(65), ago(7200), ago(-86_400), ago(40 * 86_400)] == ["now", "1 min ago", "2 hrs ago", "in 1 day", "1 mo ago"]
    assert one(spark, scalar.kind_contains(F.lit("a.b"), F.lit("a.b.c"))) and not one(spark, scalar.kind_contains(F.lit("a.b"), F.lit("a.bc")))
    assert one(spark, scalar.string_hash(F.lit("hello"))) == 99162322 and one(spark, scalar.coverage(F.lit(0), F.lit(0))) == 1.0
    r = spark.range(200).select(scalar.random_int(3, 5, 1).alias("x"))
    assert {x.x for x in r.collect()} == {3, 4, 5}
    with pytest.raises(ValueError):
        scalar.random_int(2, 1, 0)
    assert one(spark, scalar.duration_label(F.lit(1500))) == "1.5s"


def test_filters(spark):
    df = spark.createDataFrame([("error", "src/a/b.ts", "Bad thing"), ("info", "src/c.js", "fine")], "s string, p string, t string")
    assert df.where(text.marker_filter(F.col("s"), F.col("p"), F.col("t"), {"error"}, ["**/*.ts"], [], "bad")).count() == 1
    assert df.where(text.marker_filter(F.col("s"), F.col("p"), F.col("t"), {"error", "info"}, [], ["src/c.*"], "!nothing")).count() == 1
    assert df.where(text.boolean_filter(F.col("t"), "bad, fine, !thing")).count() == 1
    import re

    for g, p, want in (("**/*.ts", "a/b/c.ts", 1), ("*.ts", "a/c.ts", 0), ("a/{b,c}/?.[jt]s", "a/c/x.ts", 1), ("src/**", "src/x/y", 1), ("[!a].x", "b.x", 1)):
        assert bool(re.match(text.glob_regex(g), p)) == bool(want), g


# Sources


def test_paths(spark):
    paths = ["src/a.ts", "node_modules/x.js", "a/.git/b", "tests/x.py", ".env", "a/Build/x.c", "doc/x.md", "x/compile_commands.json"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert column(df.where(~files.in_skipped_folder(F.col("path"))), "path", "path") == [".env", "doc/x.md", "src/a.ts", "x/compile_commands.json"]
    assert set(column(df.where(files.is_indexable(F.col("path"))), "path", "path")) == {"src/a.ts", "tests/x.py", "a/Build/x.c", "doc/x.md", "x/compile_commands.json"}
    assert column(df.where(files.is_ignored(F.col("path"), ["doc/", "**/*.ts", " "])), "path", "path") == ["doc/x.md", "src/a.ts"]
    assert [one(spark, ranking.path_tier(F.lit(p), files.LAST)) for p in ("src/x", "lib/src", "a/vendor/b")] == [0, 1, 2]
    kept = files.drop_ignored(spark.createDataFrame([(p,) for p in ("a.log", "keep.log", "out/x", "sub/out/y", "sub/z.tmp", "z.tmp")], "path string"), [("", ["*.log", "!keep.log", "out/"]), ("sub", ["*.tmp"])])
    assert column(kept, "path", "path") == ["keep.log", "z.tmp"]
    s = files.listing(spark.createDataFrame([("a.js",), ("a.ts",), ("b.js",)], "path string"), sibling=("js", "ts"))
    assert column(s, "path", "path") == ["a.ts", "b.js"]


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/a.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "src/b.txt").write_bytes(b"\xff\x00\x80")
    (tmp_path / ".git/c.txt").write_bytes(b"x")
    got = files.scan(spark, str(tmp_path)).withColumn("t", files.decode(F.col("content"))).orderBy("path").collect()
    assert [r.t for r in got] == ["é", None]


def test_scanned_tables_in_parts(spark, tmp_path):
    from lodestone.plans import catalog

    spark.range(9).repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    spark.range(9).toPandas().to_parquet(tmp_path / "whole.parquet")
    got = catalog.QUERIES["scan_files"](spark, str(tmp_path))
    assert sorted((r.name, r.has_bytes) for r in got.collect()) == [("parts.parquet", True), ("whole.parquet", True)]


def test_scanned_tables_of_any_size(spark, tmp_path):
    """Files larger than a row may be, and than a split: whatever their bytes are."""
    (tmp_path / "a b.parquet").mkdir()
    (tmp_path / "a b.parquet/part 0%20.parquet").write_bytes(bytes(range(256)) * 200)
    (tmp_path / "a b.parquet/part-1.parquet").write_bytes(b"PAR1" * 5000)
    (tmp_path / "some.parquet").mkdir()
    (tmp_path / "some.parquet/part-0.parquet").write_bytes(b"\r\n\xff\0" * 5000)
    (tmp_path / "zeros.parquet").write_bytes(bytes(20000))
    (tmp_path / "marked.parquet").write_bytes(b"\xef\xbb\xbf" + b"PAR1" * 5000)
    confs = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        got = catalog.QUERIES["scan_files"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.name: r.has_bytes for r in got} == {"a b.parquet": True, "some.parquet": True, "zeros.parquet": True, "marked.parquet": False}  # a mark isn't handed on


def test_git_log(spark, tmp_path):
    log = "COMMIT|abc123def456|Alice|2024-01-01|Fix payment module\n10\t2\tsrc/pay.cpp\n-\t-\tlogo.png\n\nCOMMIT|fff|Bob|2024-01-02|a|b\nCOMMIT||x|y|z\n1\t1\tq"
    (tmp_path / "log.txt").write_text(log)
    c = files.read_git_log(spark, str(tmp_path / "log.txt")).orderBy("hash").collect()
    assert [(r.hash, r.author, r.message, len(r.files)) for r in c] == [("abc123def456", "Alice", "Fix payment module", 2), ("fff", "Bob", "a|b", 0)]
    assert c[0].files[0].asDict() == {"path": "src/pay.cpp", "added": 10, "deleted": 2} and c[0].files[1].added == 0
    df = files.read_git_log(spark, str(tmp_path / "log.txt"))
    assert files.commit_totals(df).orderBy("hash").first().asDict() == {"hash": "abc123def456", "lines_added": 10, "lines_deleted": 2, "files_changed": 2}
    assert "- src/pay.cpp (+10, -2)" in files.commit_document(df).orderBy("hash").first().text
    many = "\n".join(f"COMMIT|h{i}|A|d|m\n1\t2\tf{i}\n3\t4\tg{i}" for i in range(500)).split("\n")
    one_log = files.parse_log(spark.createDataFrame(list(enumerate(many)), "line_no long, line string"))
    assert {(r.hash, tuple(f.path for f in r.files)) for r in one_log.collect()} == {(f"h{i}", (f"f{i}", f"g{i}")) for i in range(500)}
    n = files.parse_numstat(spark.createDataFrame([("3\t1\ta",), ("",), ("-\t-\tb",)], "line string"))
    assert {(r.file, r.added, r.removed) for r in n.collect()} == {("a", 3, 1), ("b", 0, 0)}


def test_small_formats(spark):
    env = 'export A=1\r\nB: two # c\n# x\nC="a\\nb"\nA=\'3\'\n'
    assert [(e.key, e.value) for e in one(spark, files.env_entries("t"), t=env)] == [("B", "two"), ("C", "a\nb"), ("A", "3")]
    df = spark.createDataFrame([('{"a": "x//y", /* c */ "b": [1, 2,], // z\n}',)], "t string")
    assert files.read_jsonc(df, "t", "a string, b array<int>").first().value.asDict() == {"a": "x//y", "b": [1, 2]}
    got = one(spark, files.splice_tokens(F.col("a"), F.col("e")), a=[1, 2, 3, 4], e=None) if False else spark.createDataFrame([([1, 2, 3, 4], [(0, 1, [9, 9]), (3, 1, [7])])], "a array<int>, e array<struct<start:int,delete:int,data:array<int>>>").select(files.splice_tokens(F.col("a"), F.col("e")).alias("x")).first().x
    assert got == [9, 9, 2, 3, 7]


def test_stores(spark, tmp_path):
    rows = [("c1", None, "odd", "foo bar", {"k": "v"}, [0.1, 0.2]), ("c2", "b.md", "doc_chunk", "", {"k": "w"}, [0.3, 0.4])]
    ch = spark.createDataFrame(rows, "chunk_id string, file_path string, doc_type string, text_content string, metadata map<string,string>, embedding array<float>")
    stores.dual_write(stores.remote_records(ch), str(tmp_path / "r"), str(tmp_path / "l"))
    assert stores.read_records(spark, str(tmp_path / "r"), "doc_chunk").count() == 1 and stores.read_records(spark, str(tmp_path / "l")).count() == 2
    assert stores.store_path("/b", "n", "h", lambda p: p == "/b/h") == "/b/h" and stores.store_path("/b", "n", "h", lambda p: False) == "/b/n"


# Joins


def test_asof_monotone(spark):
    xs = [1, 4, 5, 7, 55, 59, 60, 61, 64, 69]
    r = spark.createDataFrame([(0, x, x) for x in xs], "k int, t int, v int")
    q = spark.createDataFrame([(0, x) for x in (62, 0, 70, 5)], "k int, t int")
    assert {r.t: r.o for r in joins.asof(q, r, ["k"], "t", "v", "o").collect()} == {62: 61, 0: None, 70: 69, 5: 5}
    assert {r.t: r.o for r in joins.asof(q, r, ["k"], "t", "v", "o", forward=True).collect()} == {62: 64, 0: 1, 70: None, 5: 5}


def test_ranges(spark):
    f = lambda e: one(spark, e)
    r = joins.intersect_range(F.lit(1), F.lit(5), F.lit(3), F.lit(9))
    assert f(r).asDict() == {"start": 3, "end": 5} and f(joins.intersect_range(F.lit(1), F.lit(3), F.lit(3), F.lit(9))).asDict() == {"start": 0, "end": 0}
    assert [x.asDict() for x in f(joins.complement_range(F.lit(0), F.lit(10), F.lit(3), F.lit(5)))] == [{"start": 0, "end": 3}, {"start": 5, "end": 10}]
    g = spark.createDataFrame([(0, 10, 2), (10, 12, 2), (12, 20, 3)], "start int, end int, size int").withColumn("k", F.lit(1)).withColumn("o", F.monotonically_increasing_id())
    assert [(r.start, r.end, r.size) for r in windows.consolidate(g, ["k"], "o").orderBy("start").collect()] == [(0, 12, 2), (12, 20, 3)]
    got = joins.overlaps(g, spark.createDataFrame([(1, 5, 15)], "k int, s int, e int"), ("start", "end"), ("s", "e"), "k")
    assert {(r.lo, r.hi, r.size) for r in got.collect()} == {(5, 10, 2), (10, 12, 2), (12, 15, 3)} and got.count() == 3
    e = spark.createDataFrame([(1, 2, 4, 5), (1, 10, 11, 0)], "doc int, start int, end int, length int")
    idx = spark.createDataFrame([(1, 0), (1, 3), (1, 6), (1, 12), (2, 7)], "doc int, index int")
    assert {(r.doc, r['index']): r.new_index for r in joins.remap_index(idx, e).collect()} == {(1, 0): 0, (1, 3): None, (1, 6): 9, (1, 12): 14, (2, 7): 7}


def test_prefix_tree(spark):
    tree = spark.createDataFrame([(["foo", "bar"],), (["x"],)], "k array<string>")
    keys = spark.createDataFrame([(["foo"],), (["foo", "bar", "baz"],), (["x"],), (["y"],)], "k array<string>")
    assert {tuple(r.k) for r in joins.has_key_or_parent(keys, tree, "k").collect()} == {("foo", "bar", "baz"), ("x",)}
    assert {tuple(r.k) for r in joins.has_key_or_children(keys, tree, "k").collect()} == {("foo",), ("x",)}
    assert joins.delete_recursive(tree, "k", ["foo"]).count() == 1


def test_category_sums_and_word_distance(spark):
    nodes = spark.createDataFrame([(1, "a/b/c.js", "c", 5), (2, "a/x.js", "x", 2), (3, "z.js", "z", 1)], "node_id int, url string, label string, self_time int")
    cats = spark.createDataFrame([("a", "A"), ("a/b", "AB")], "prefix string, category string")
    assert {r.category: r.self_time for r in joins.category_sums(nodes, cats).collect()} == {"AB": 5, "A": 2, "z": 1}
    w = spark.createDataFrame([(1, 1, "foo", 50), (2, 1, "if", 50), (3, 1, "nope", 50)], "id int, doc int, word string, pos int")
    a = spark.createDataFrame([(1, "foo", 10), (1, "foo", 60), (1, "if", 5)], "doc int, word string, pos int")
    rg = spark.createDataFrame([(1, 0, 100), (1, 5, 20)], "doc int, start int, end int")
    assert {r.id: r.distance for r in joins.word_distance(w, a, rg, ["if"]).collect()} == {1: 1, 2: joins.FAR, 3: joins.FAR}


def test_three_way_merge_cases(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()) or [("-", "-")], "k string, v string").where("k <> '-'")
    base, local, remote = {"same": "1", "lu": "1", "ru": "1", "lr": "1", "rr": "1", "lrru": "1", "lurr": "1", "both": "1"}, {"same": "1", "lu": "2", "ru": "1", "rr": "1", "lurr": "2", "both": "2", "la": "1", "ab": "1"}, {"same": "1", "lu": "1", "ru": "3", "lr": "1", "lrru": "3", "both": "3", "ra": "1", "ab": "2"}
    got = {r.k: (r.local_action, r.remote_action, r.conflict) for r in joins.three_way_merge(mk(base), mk(local), mk(remote), "k", "v").collect()}
    assert got == {"lu": (None, "updated", False), "ru": ("updated", None, False), "lr": (None, "removed", False), "rr": ("removed", None, False), "lrru": ("added", None, False), "lurr": (None, None, True), "both": (None, None, True), "la": (None, "added", False), "ra": ("added", None, False), "ab": (None, None, True)}
    wins = {r.k: (r.local_action, r.remote_action) for r in joins.three_way_merge(mk(base), mk(local), mk(remote), "k", "v", remote_wins=True).collect()}
    assert wins["lurr"] == ("removed", None) and wins["both"] == ("updated", None) and wins["ab"] == ("updated", None) and wins["la"] == (None, "added")


# Aggregates


def test_collections(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 3, 1), ("a", 2, 2)], "k string, v int, o int")
    assert {r.k: r["values"] for r in agg.group_lists(df, "k", "v", "o").collect()} == {"a": [1, 2], "b": [3]}
    assert [one(spark, agg.slice_array(F.col("a"), *x), a=[1, 2, 3, 4]) for x in ((1, 3), (-2,), (3, 1), (0, 99), (-99, -3))] == [[2, 3], [3, 4], [], [1, 2, 3, 4], [1]]
    assert one(spark, agg.signed_set(["A", "b"], F.col("s")), s=["-a", "C"]) == ["b", "c"]
    assert one(spark, agg.map_key(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))) == agg.map_key(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))))
    bits = agg.bit_set(df, ["k"], "v").orderBy("k").collect()
    assert [r.bits for r in bits] == [6, 8]
    s = spark.createDataFrame([("f", "class", "A", 1, 20), ("f", "class", "A", 21, 45), ("f", "method", "m", 50, 60)], "file string, symbol_type string, symbol_name string, start_line int, end_line int")
    got = agg.merge_symbols(s).orderBy("start_line").collect()
    assert len(got) == 2 and got[0].end_line == 45 and "class A L1-45" in agg.repository_map(s).first().text
    g = spark.createDataFrame([("a", "b", 5), ("a", "c", 9), ("c", "d", 1), ("d", "a", 1)], "node string, caller string, time int")
    assert agg.heaviest_path(g, spark.createDataFrame([("a",)], "node string")).first().path == ["a", "c", "d"]
    assert agg.top_share(df, "k", "v", 5, 10, ("b",)).collect()[0].asDict() == {"k": "a", "v": 3, "share": 50}
    ch = [(r.doc, r.ok) for r in windows.all_adjacent(spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 5), (2, 2, 1)], "doc int, o int, x int"), ["doc"], ["o"], lambda a, b: a("x") <= b("x")).orderBy("doc").collect()]
    assert ch == [(1, True), (2, False)]


def test_parent_chunks_model(spark):
    rng = random.Random(3)
    rows = [("f", i, rng.choice(["h1", "h1", None]), "x" * rng.choice([10, 700, 1600])) for i in range(40)]
    group, texts, last, want = 0, [], None, {}
    for _, i, h, t in rows:
        h = h or ""
        if texts and (h != last or len("\n\n".join(texts)) + len(t) > 1500):
            group, texts = group + 1, []
        texts.append(t)
        last, want[i] = h, group
    df = spark.createDataFrame(rows, "file string, ord int, header string, text string")
    assert {r.ord: r.group for r in agg.parent_chunks(df).collect()} == want
    assert agg.parent_texts(df).where(F.length("parent_text") > 1500).isEmpty()


def test_rollup_and_counts(spark):
    df = spark.createDataFrame([("a/b", "passed", 1.0), ("a/c", "failed", 2.0), ("d", "skipped", 3.0)], "path string, state string, duration double")
    assert {r.node: (r.state, r.duration) for r in agg.rollup_states(df).collect()} == {"a": ("failed", 3.0), "a/b": ("passed", 1.0), "a/c": ("failed", 2.0), "d": ("skipped", 3.0)}
    assert agg.affected_nodes(df.where("path = 'a/b'")).count() == 2
    a, b = (spark.createDataFrame([(1, t)], "k int, text string") for t in ("aab", "abc"))
    assert abs(agg.histogram_similarity(a, b, "k").first().similarity - (1 - 2 / 6)) < 1e-9


# Windows


def test_merged_ranges_of_odd_rows(spark, tmp_path):
    """Null ids and times, times before 1970, and rows that repeat: as in the query's SQL, which one thread runs in one order."""
    import duckdb

    rows = "(1, NULL, 240), (1, 5, 240), (1, 7, 300), (2, NULL, 60), (2, 3, NULL), (2, 4, NULL), (3, 1, -30), (3, 2, -90), (3, 590, -36030), (3, 0, -200), (3, 0, -200), (4, 1, 9000), (4, 1, 9000), (4, 601, 9000)"
    at = str(tmp_path / "events.parquet")
    with duckdb.connect() as con:
        con.execute("SET threads = 1")
        con.execute(f"COPY (SELECT u::BIGINT AS user_id, i::BIGINT AS event_id, make_timestamp(t::BIGINT * 1000000) AS ts FROM (VALUES {rows}) AS v(u, i, t)) TO '{at}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}'")
        want = con.execute(catalog.ORACLES["merge_ranges"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["merge_ranges"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_window_pack(spark):
    r = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 5, 6), (1, 5, 9)], "k int, s int, e int")
    assert [(x.s, x.e) for x in windows.merge_ranges(r, ["k"], "s", "e").orderBy("s").collect()] == [(0, 4), (5, 9)]
    i = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 9, 10)], "k int, i int")
    rg = windows.indexes_to_ranges(i, ["k"], "i")
    assert sorted((x.start, x.end) for x in rg.collect()) == [(1, 4), (7, 8), (9, 11)]
    assert column(windows.ranges_to_indexes(rg, ["k"]), "index", "index") == [1, 2, 3, 7, 9, 10]
    m = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 3)], "k int, start_line int, end_line int")
    assert column(windows.group_matches(m, ["k"]), "island", "start_line", "end_line") == [1, 1, 2]
    p = spark.createDataFrame([("a/x",), ("a/y",), ("b/c/z",), ("q",)], "path string")
    assert column(windows.one_per_folder(p, "path"), "path", "path") == ["a/x", "b/c/z", "q"]
    c = spark.createDataFrame([(1, t, r, n) for t, (r, n) in enumerate([("user", 0), ("tool", 3000), ("tool", 2500), ("tool", 10), ("tool", 2000), ("tool", 9000)])], "conv int, turn int, role string, n int")
    assert column(windows.fold_old_large(c, "conv", "turn", F.col("n"), F.col("role") == "tool"), "folded", "turn") == [False, True, True, False, False, False]


def test_ranking_pack(spark):
    d = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "s"), (3, 0, "z")], "seed_ord int, dep_ord int, path string")
    assert column(ranking.recommend(d, spark.createDataFrame([("s",)], "path string")), "path", "seed_ord", "dep_ord") == ["a", "b"]
    pv = spark.createDataFrame([("x", 5, False, 1, None), ("x", 9, True, 2, None), ("y", 5, False, 1, True), ("y", 9, False, 3, False)], "k string, score int, builtin boolean, time int, exclusive boolean")
    got = [(r.k, r.score, r["rank"]) for r in ranking.rank_providers(pv, ["k"]).orderBy("k", "rank").collect()]
    assert got == [("x", 9, 1), ("x", 5, 2), ("y", 1000, 1)]
    rg = spark.createDataFrame([(1, 0, 100), (1, 1, 50), (1, 2, 20), (1, 60, 70)], "k int, start int, end int")
    assert sorted(r.start for r in ranking.limit_by_level(rg, ["k"], 3).collect()) == [0, 1, 60]
    xs = spark.createDataFrame([(x,) for x in (1, 3, 5)], "x int")
    assert [ranking.search_position(xs, "x", v).first().position for v in (3, 4, 0)] == [1, -3, -1]
    t = spark.createDataFrame([(i,) for i in range(10)], "ts int")
    assert ranking.trim_lru(t, "ts", 10).count() == 5 and ranking.trim_lru(t, "ts", 11).count() == 10
    assert one(spark, ranking.cap_result_text(F.col("l"), 2, 100), l=["a", "b", "c"]) == "a\nb\n... 1 more lines"
    c = spark.createDataFrame([("insert", None, 2), ("delete", 2, None), ("modified", 0, 0)], "type string, original_index int, modified_index int")
    assert [r.type for r in ranking.order_changes(c).collect()] == ["modified", "delete", "insert"]
    f = spark.createDataFrame([("b", 1, True), ("a", 5, False), ("c", 9, False)], "path string, count int, is_folder boolean")
    assert [r.path for r in ranking.order_results(f, "count desc").collect()] == ["b", "c", "a"]
    assert [r.l for r in ranking.sort_lines(spark.createDataFrame([("b",), ("A",), ("a",)], "l string"), "l").collect()] == ["a", "A", "b"]


# Graph

SOURCES = [("a.ts", "import { bar } from './b';\nfunction foo() {\n  bar();\n}\n"), ("b.ts", "import './c';\nexport function bar() {\n  baz();\n}\n"), ("c.ts", "export function baz() {\n  return 1;\n}\n")]


def test_graph_is_built_without_broadcasts(spark):
    """Every table of the graph is as long as its files, also if these look small at first."""
    few = spark.range(30).repartition(2).select(F.format_string("m%d.ts", "id").alias("file"), F.format_string("import { f%d } from './m%d';\nfunction f%d() {\n  f%d();\n}\n", F.col("id") + 1, F.col("id") + 1, "id", F.col("id") + 1).alias("text"))
    _, edges = graph.build_graph(few)
    assert sorted(r["count"] for r in edges.groupBy("kind").count().collect()) == [29, 29, 30]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_graph(spark, tmp_path):
    nodes, edges = graph.build_graph(spark.createDataFrame(SOURCES, "file string, text string"))
    assert nodes.count() == 6
    assert {(r.src, r.dst) for r in edges.where("kind = 'imports'").collect()} == {("a.ts", "b.ts"), ("b.ts", "c.ts")}
    assert ("a.ts#foo", "b.ts#bar") in {(r.src, r.dst) for r in edges.where("kind = 'calls'").collect()}
    seeds = spark.createDataFrame([("a.ts",)], "node string")
    one_hop, two = (set(column(graph.neighbours(edges.where("kind = 'imports'"), seeds, h), "node", "node")) for h in (1, 2))
    assert one_hop == {"b.ts"} and two == {"b.ts", "c.ts"}
    assert graph.relations(nodes, edges, entity="foo", kind="calls").count() == 1
    assert {(r.file, r.kind) for r in graph.related_files(nodes, edges, "b.ts").collect()} == {("a.ts", "imported_by"), ("a.ts", "references"), ("c.ts", "imports"), ("c.ts", "calls")}
    stores.write_graph(nodes, edges, str(tmp_path / "g"))
    n2, e2 = stores.read_graph(spark, str(tmp_path / "g"))
    assert n2.count() == nodes.count() and e2.count() == edges.count() and graph.entity_count(n2).first().n == 6
    every = nodes.select("file").distinct()
    n3, e3 = graph.update_graph(nodes, edges, every, nodes.limit(0), edges.limit(0))
    assert n3.count() == 0 and e3.count() == 0
    assert graph.linked_files(spark.createDataFrame([(1, ["a.ts", "no"])], "id int, linked_files array<string>"), every).count() == 1


@pytest.mark.parametrize(("src", "names"), [("int add(int a, int b) {\n  return a + b;\n}\nclass P {\n};", {"add", "P"}), ("fun main() {\n}\nclass K {\n}", {"main", "K"}), ("public class J {\n  public void run() {\n  }\n}", {"J", "run"}), ("function y = sq(x)\n  y = x * x\nendfunction", {"sq"}), ("def f(x):\n    return x\n", {"f"})])
def test_chunker(spark, src, names):
    got = one(spark, graph.chunk_code("t"), t=src)
    assert {c.symbol_name for c in got} >= names and all(1 <= c.start_line <= c.end_line for c in got)


def test_louvain_at_every_size(spark, tmp_path):
    """Fours that plain modularity would join, as each is small beside the whole graph."""
    from lodestone.plans import catalog

    spark.range(1600).toDF("s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["communities"](spark, str(tmp_path)).collect()
    assert len(got) == 1600 and all(r.community == r.node // 4 * 4 for r in got)


def test_best_rows_in_tiles(spark, monkeypatch):
    """A batch of many rows is scored in tiles: no matrix is larger, and ties over tiles go to the smaller id."""
    monkeypatch.setattr(ranking, "TILE_SCORES", 64)
    seen = []

    def score(ready, ys):
        seen.append(len(ys) * len(ready))
        assert len(ys) * len(ready) <= 64
        return np.array([[np.nan if y % 7 == q else float(y % 5) for q in ready] for y in ys])

    queries = spark.createDataFrame([(q, q) for q in range(6)], "query_id int, x int")
    rows = spark.range(400).select((399 - F.col("id")).alias("chunk_id"), (399 - F.col("id")).alias("y")).coalesce(1)
    got = ranking._best_by_blocks(queries, rows, 3, 4, list, score)
    want = {(q, y, r + 1) for q in range(6) for r, y in enumerate(sorted((y for y in range(400) if y % 7 != q), key=lambda y: (-(y % 5), y))[:3])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == want


def test_sparse_scores_of_common_and_rare_words(spark, monkeypatch):
    monkeypatch.setattr(ranking, "COMMON", 3)
    monkeypatch.setattr(ranking, "MOST_COMMON", 2)
    texts = ["alpha beta beta", "alpha gamma", "alpha beta delta delta", None, "", "gamma gamma beta alpha"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = ranking.sparse_top_k(df.toDF("query_id", "text"), df.toDF("chunk_id", "text"), 6).collect()
    counts = [text.bucket_counts(t) for t in texts]
    dot = lambda a, b: sum(a[i] * b[i] for i in a) / max(a.values(), default=1) / max(b.values(), default=1)
    assert {(r.query_id, r.chunk_id): r.score for r in got} == {(i, j): round(dot(a, b), 6) for i, a in enumerate(counts) for j, b in enumerate(counts) if dot(a, b) > 0}


def test_texts_in_slices(spark, monkeypatch):
    """Batches are worked through in slices by the function that makes the rows, so that no batch's results are held at once."""
    monkeypatch.setattr(text, "SLICE", 2)
    monkeypatch.setattr(text_search, "SLICE", 2)
    texts = ["alpha abc", None, "", "beta beta abc abc", "gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    coded, hits = text.sparse_encode(docs, "id", "text"), text_search.search(docs, "id", "abc")
    assert sorted((r.id, r.idx, r.weight) for r in coded.collect()) == sorted((i, *e) for i, t in enumerate(texts) for e in text.encode_sparse(t))
    assert sorted((r.id, r.total, len(r.matches)) for r in hits.collect()) == [(0, 1, 1), (3, 2, 2)]
    assert all("MapInArrow" in df._jdf.queryExecution().executedPlan().toString() for df in (coded, hits))


def test_louvain(spark):
    cl = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "xy" for i in range(4) for j in range(i)]
    got, q = graph.louvain(spark.createDataFrame([*cl, ("x0", "y0", 0.1)], "a string, b string, w double"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r.community, set()).add(r.node[0])
    assert q > 0 and sorted(map(sorted, groups.values())) == [["x"], ["y"]]
    empty, q = graph.louvain(spark.createDataFrame([], "a string, b string, w double"))
    assert empty.count() == 0 and q == 0


# Differences and search


def test_diff_models():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        for f in (diff.shortest_edits, diff.scored_edits):
            out, at, n = [], 0, 0
            for a1, a2, b1, b2 in f(a, b):
                out += a[at:a1] + b[b1:b2]
                at, n = a2, n + a2 - a1 + b2 - b1
            assert out + a[at:] == b
            lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
            assert n == len(a) + len(b) - 2 * lcs[-1][-1]


def test_diff_of_long_texts():
    rng = random.Random(6)
    a = [f"line {rng.randrange(4000)}" for _ in range(8000)]
    b = [x for x in a if rng.random() > 0.02]
    for _ in range(150):
        b.insert(rng.randrange(len(b)), f"new {rng.random()}")
    for f in (diff.shortest_edits, diff.scored_edits):
        out, at = [], 0
        for a1, a2, b1, b2 in f(a, b):
            out += a[at:a1] + b[b1:b2]
            at = a2
        assert out + a[at:] == b
    # Nothing in common: no path is searched.
    assert diff.shortest_edits([f"a{i}" for i in range(20_000)], [f"b{i}" for i in range(20_000)]) == [(0, 20_000, 0, 20_000)]


def test_scored_diff_is_one_script_at_every_size(monkeypatch):
    rng = random.Random(8)
    for _ in range(150):
        cut, parts = rng.choice([(1, 2), (2, 3), (8, 16), (512, 16)])
        monkeypatch.setattr(diff, "STRETCH", cut)
        monkeypatch.setattr(diff, "PARTS", parts)
        a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        left, right = diff._shared(a, b)
        x, y = [a[i] for i in left], [b[j] for j in right]
        if x:
            assert diff._by_rows(x, y, left, right) == diff._by_diagonals(x, y, left, right)
    assert diff._by_diagonals(["a"], ["a"], [0], [0]) == [(0, 0)]


def test_scored_diff_of_5000_lines_in_bounded_memory():
    import tracemalloc

    rng = random.Random(9)
    a, b = ([str(rng.randrange(300)) for _ in range(5000)] for _ in range(2))
    tracemalloc.start()
    got = diff.scored_edits(a, b)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = lambda r: len(a) + len(b) - sum(a2 - a1 + b2 - b1 for a1, a2, b1, b2 in r)
    assert kept(got) == kept(diff.shortest_edits(a, b)) and used < 10_000_000


def test_cell_diff(spark):
    got = one(spark, diff.cell_diff("a", "b"), a=["1", "2", "3"], b=["1", "9", "3", "4"])
    assert [(r.status, r.original, r.modified) for r in got] == [("unchanged", 0, 0), ("modified", 1, 1), ("unchanged", 2, 2), ("inserted", None, 3)]
    a, b = (spark.createDataFrame([(x,) for x in v], "h int") for v in ((1, 2), (2, 3)))
    assert {r.h: r.status for r in diff.set_diff(a, b, "h").collect()} == {1: "deleted", 2: "unchanged", 3: "inserted"}
    assert one(spark, diff.boundary_score(F.lit("  x"))) == 998 and one(spark, diff.line_key(F.lit(" a ")) == diff.line_key(F.lit("a")))


def test_search(spark):
    docs = spark.createDataFrame([(1, "abc\nxabc abc"), (2, "none")], "id int, text string")
    r = text_search.search(docs, "id", "abc").first()
    assert [(m.start_line, m.start_col, m.end_line, m.end_col) for m in r.matches] == [(0, 0, 0, 3), (1, 1, 1, 4), (1, 5, 1, 8)] and not r.limit_hit
    r = text_search.search(docs, "id", "c\nx|abc", quota=1).first()
    assert len(r.matches) == 1 and r.limit_hit
    f = lambda t, s: tuple(one(spark, text_search.find_text("t", "s"), t=t, s=s))
    assert f("a\nb\nBody line\n", "Body line") == (3, 3) and f("x\r\ny\r\n", "y") == (2, 2) and f("**Bold** text\nq", "```\nBold text\n```") == (1, 1) and f("a", "zz") == (None, None)
    h = text_search.section_headers(spark.createDataFrame([(1, "// #region Foo\ncode\n// MARK: - Bar")], "id int, text string"), "id").orderBy("line_no").collect()
    assert [(x.line_no, x.kind, x.label, x.separator) for x in h] == [(1, "region", "Foo", False), (3, "mark", "Bar", True)]
    assert one(spark, F.size(text_search.split_context(F.lit("--- FILE a\nx\n--- GRAPH\ny\n--- LINKED CODE\nz\n--- GIT\nw")))) == 4
    s = spark.createDataFrame([(1, 1, "code", "a", "x" * 60), (1, 2, "code", "b", "y" * 60), (1, 3, "git", None, "z" * 50), (1, 4, "code", "ex", "w")], "query_id int, rank int, kind string, path string, text string")
    assert column(text_search.merge_context(s, 100, 60, ["ex"]), "rank", "rank") == [1, 3]
    m = spark.createDataFrame([(1, 0, "user", "please write out/a.md", None), (1, 1, "tool", "", "x/B.MD"), (2, 0, "user", "see docs/q.md", None)], "conv_id int, turn int, role string, text string, path string")
    assert {r.conv_id: r.path for r in text_search.deliverable(m).collect()} == {1: "x/B.MD", 2: "docs/q.md"}


# Streams


def test_throttle_and_buffer_models():
    assert changes.throttle_times([0, 1, 2, 10, 11, 30], 5) == [(0, 1), (5, 2), (10, 1), (15, 1), (30, 1)]
    assert changes.anchored_times([0, 3, 5, 6, 20], 5) == [(5, 2), (10, 2), (25, 1)]


def test_index_sync_from_a_stream(spark, tmp_path):
    chunk = lambda f: f.select("file", F.explode(F.split("text", ";")).alias("chunk"))
    start = spark.createDataFrame([("a", "1;2"), ("b", "3"), ("c", "4")], "file string, text string")
    sync = changes.IndexSync(spark, str(tmp_path / "ix"), chunk)
    sync.on_batch(start.withColumn("type", F.lit("updated")), 0)
    assert sync.version() is None
    sync.build(chunk(start))
    src = tmp_path / "in"
    schema = "file string, type string, text string"
    spark.createDataFrame([("a", "updated", "9"), ("b", "deleted", None), ("b", "updated", "8"), ("d", "updated", "5;6")], schema).coalesce(1).write.json(str(src))
    q = spark.readStream.schema(schema).json(str(src)).writeStream.foreachBatch(sync.on_batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.file, r.chunk) for r in sync.read().collect()} == {("a", "9"), ("c", "4"), ("d", "5"), ("d", "6")}
    assert [e[0] for e in sync.events] == ["complete", "incrementalSync"]


def test_index_sync_after_crashes_and_fresh_checkpoints(spark, tmp_path):
    chunk = lambda f: f.select("file", F.explode(F.split("text", ";")).alias("chunk"))
    rows = lambda *r: spark.createDataFrame(list(r), "file string, type string, text string, seq int")
    sync = changes.IndexSync(spark, str(tmp_path / "ix"), chunk)
    sync.build(chunk(spark.createDataFrame([("a", "1"), ("b", "2")], "file string, text string")))
    now = lambda: {(r.file, r.chunk) for r in sync.read().collect()}
    sync.on_batch(rows(("a", "updated", "old", 1), ("a", "updated", "new", 2)), 4)
    assert now() == {("a", "new"), ("b", "2")} and sync.version() == 1
    # A stream with a fresh checkpoint begins at 0 again: nothing is lost.
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "second")
    try:
        sync.on_batch(rows(("b", "updated", "3", 1)), 0)
        assert now() == {("a", "new"), ("b", "3")} and sync.version() == 2
        # Run again behind the pointer: the same batch does nothing, whatever it holds.
        sync.on_batch(rows(("b", "updated", "again", 1)), 0)
        assert now() == {("a", "new"), ("b", "3")} and sync.version() == 2
        # A crash before the pointer leaves a version that nobody reads; the batch writes it anew.
        point, sync._point = sync._point, lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
        with pytest.raises(RuntimeError):
            sync.on_batch(rows(("a", "updated", "half", 1)), 1)
        assert now() == {("a", "new"), ("b", "3")}
        sync._point = point
        sync.on_batch(rows(("a", "updated", "whole", 1)), 1)
        assert now() == {("a", "whole"), ("b", "3")} and sync.version() == 3
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def test_dead_letters_are_tried_again(spark, tmp_path):
    works = [False]
    sync = changes.IndexSync(spark, str(tmp_path / "ix"), lambda f: f.select("file", "text", ((F.col("file") != "bad") | F.lit(works[0])).alias("ok")))
    sync.build(spark.createDataFrame([("bad", "0"), ("good", "0")], "file string, text string"))
    batch = lambda *r: spark.createDataFrame(list(r), "file string, type string, text string")
    sync.on_batch(batch(("bad", "updated", "1"), ("good", "updated", "1")), 0)
    assert {(r.file, r.text) for r in sync.read().collect()} == {("bad", "0"), ("good", "1")} and sync.failed().first().file == "bad"
    works[0] = True
    sync.on_batch(batch(("other", "updated", "2")), 1)
    assert {(r.file, r.text) for r in sync.read().collect()} == {("bad", "1"), ("good", "1"), ("other", "2")} and sync.failed().isEmpty()


def test_throttle_stream(spark, tmp_path):
    src = tmp_path / "in"
    put = lambda n, *rows: spark.createDataFrame(list(rows), "key string, value double").coalesce(1).write.mode("append").json(str(src)) or n
    put(0, ("k", 1.0), ("k", None), ("j", 5.0))
    s = spark.readStream.schema("key string, value double").option("maxFilesPerTrigger", 1).json(str(src))
    q = changes.throttle_stream(s, "key", 4000).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(processingTime="200 milliseconds").start()
    got = lambda: [(r.key, r.total, r.n) for r in spark.table("throttled").collect()]
    try:
        assert changes.wait_for(q, lambda: len(got()) == 2, 60) and set(got()) == {("k", 1.0, 2), ("j", 5.0, 1)}
        put(1, ("k", 2.0), ("k", 3.0))
        assert changes.wait_for(q, lambda: len(got()) == 3, 60) and got()[-1] == ("k", 5.0, 2)
    finally:
        q.stop()


def test_json_store_waits(spark, tmp_path):
    at = str(tmp_path / "s")
    store = stores.JsonStore(spark, at, delay=3600)
    store.set("a", "1")
    assert stores.JsonStore(spark, at).get("a") is None
    store.set("b", "2", now=True)
    store.set("a", None)
    store.flush()
    again = stores.JsonStore(spark, at)
    assert again.values == {"b": "2"} and again.get("a", "x") == "x"


def test_saved_index_gives_what_was_built(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    graph_index.GraphIndex(spark, str(tmp_path / "ix")).create(v)
    got = graph_index.GraphIndex(spark, str(tmp_path / "ix")).search(q, 5)
    key = lambda df: {(r.query_id, int(r.chunk_id), r["rank"]) for r in df.collect()}
    assert key(got) == key(ranking.ann_top_k(q, v, 5))
    graph_index.GraphIndex(spark, str(tmp_path / "ix")).create(v.limit(0))
    assert not (tmp_path / "ix").exists()


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from lodestone import session

    class Cluster:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        session.use_checkpoints(Session())


def test_buffer_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("k", "a"), ("k", None), ("j", "c")], "key string, value string").coalesce(1).write.json(str(src))
    s = spark.readStream.schema("key string, value string").json(str(src))
    q = changes.buffer_stream(s, "key", 200).writeStream.format("memory").queryName("buffered").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        assert changes.wait_for(q, lambda: spark.table("buffered").count() == 2, 60)
        assert {(r.key, r.n) for r in spark.table("buffered").collect()} == {("k", 2), ("j", 1)}
    finally:
        q.stop()


def test_watermark_and_debounce(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:02",), ("2024-01-01 00:00:05",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert [r.n for r in changes.debounce(df, "ts", "2 seconds", F.count(F.lit(1)).alias("n")).orderBy("start").collect()] == [2, 1]
    assert changes.watermarked(df, "ts", "1 minute").count() == 3
    got = changes.reduce_scopes(spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6)], "s string, v int"), "s", "v")
    assert sorted(r.v for r in got.collect()) == [3, 5, 6]
    assert changes.replay(spark.createDataFrame([(1,), (2,), (3,)], "seq int"), 1).count() == 2
    f = spark.createDataFrame([("a",), ("b",)], "file string")
    parse = lambda x: x.withColumn("ok", F.col("file") == "a")
    assert changes.retry_failed(f, parse, lambda x: x.withColumn("ok", F.lit(True))).where("ok").count() == 2
    assert changes.serve_while_loading(lambda: spark.read.parquet("/nonexistent/x"), f).count() == 2


def test_registry(spark):
    registry.register_model("len", lambda ts: [[len(t), 1.0] for t in ts])
    try:
        assert one(spark, registry.embedding("len")("t"), t="abc") == [3.0, 1.0]
        with pytest.raises(ValueError):
            registry.register_model("len", None)
    finally:
        registry.unregister_model("len")
    assert registry.first_answer([lambda t: [1.0]], ["x"]) == [1.0]
    registry.register_timeline("git", lambda u: spark.createDataFrame([(u,)], "u string"))
    assert registry.timeline("git:x").first().u == "git:x"
    df = spark.createDataFrame([("a", "A"), (None, None), ("a", None)], "a string, b string")
    assert [r.x for r in df.select(registry.equal_by(lambda x, y: F.lower(x) == F.lower(y), "a", "b").alias("x")).collect()] == [True, True, False]
    fl = spark.createDataFrame([("f", "1\n2\n3")], "file string, text string")
    assert registry.read_lines(fl, spark.createDataFrame([("f", 2, 3)], "file string, start int, end int")).first().text == "2\n3"


def test_matches_are_sorted_in_parts_that_are_not_joined_again(spark):
    df = spark.range(1000).selectExpr("id % 100 as g", "id as start_line", "id + 100 as end_line")
    assert windows.group_matches(df, ["g"]).rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
