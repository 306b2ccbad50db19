"""Queries over scalar, text and vector functions and differences. Texts with links, headers, braces and the like are made
from the documents by a rule, so that SQL knows what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text, vectors
from ..operators import diff, text_search
from ..session import load
from .registered import query
from .sources_catalog import pick

_i = lambda: F.col("doc_id")
_s = lambda: F.col("doc_id").cast("string")


def _docs(spark, d):
    return load(spark, d, "documents")


# Vectors -------------------------------------------------------------------------------------------------


@query("SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n)[1]::FLOAT::DOUBLE AS first, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n)::FLOAT::DOUBLE * (x::DOUBLE / n)::FLOAT::DOUBLE)), 5) AS length FROM (SELECT vec_id, [e * (1 + vec_id % 3) for e in embedding] AS embedding, sqrt(list_sum([(e * (1 + vec_id % 3))::DOUBLE * (e * (1 + vec_id % 3))::DOUBLE for e in embedding])) AS n FROM embeddings)".replace("first, round", "first, round"))
def l2_normalise(spark, d):
    """Vectors made longer by a rule, and unit again."""
    long = F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 3).cast("float")).cast("float"))
    v = load(spark, d, "embeddings").withColumn("v", long).withColumn("u", vectors.l2_normalise("v"))
    return v.select("vec_id", F.element_at("u", 1).cast("double").alias("first"), F.round(vectors.dot("u", "u"), 5).alias("length"))


_HEX = "lower(printf('%08X', (embedding[{0}]::FLOAT::BIT)::UINTEGER))"
_BYTES = " || ".join(f"substr({_HEX.format(k)}, {p}, 2)" for k in (1, 2, 64) for p in (7, 5, 3, 1))


@query(f"SELECT vec_id, {_BYTES} AS bytes, 256::INT AS size, true AS same FROM embeddings")
def vector_bytes(spark, d):
    """The first two and the last number's bytes, and the vector read back."""
    v = load(spark, d, "embeddings").withColumn("b", vectors.to_bytes("embedding"))
    raw = F.lower(F.hex(F.concat(F.substring("b", 1, 8), F.substring("b", 253, 4))))
    return v.select("vec_id", raw.alias("bytes"), F.octet_length("b").alias("size"), (vectors.from_bytes("b") == F.col("embedding")).alias("same"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, d):
    """Each vector's similarity to the next, from its distance."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    distance = 1 - vectors.dot("embedding", "next") / (vectors.norm("embedding") * vectors.norm("next"))
    return both.select("vec_id", F.round(vectors.similarity(distance), 5).alias("similarity"))


# Headers, code, Markdown -----------------------------------------------------------------------------------

HEADERS = ("", "/*\n * Copyright X\n */\n\n", "// SPDX-License-Identifier: MIT\n// more\n", "# plain comment\n", "\n# All Rights Reserved\n#\n\n", "/* @file x */\n#include <a>\n")


@query("SELECT doc_id, md5(CASE doc_id % 6 WHEN 3 THEN '# plain comment' || chr(10) WHEN 5 THEN '#include <a>' || chr(10) ELSE '' END || 'code();' || chr(10) || text) AS body, [0, 4, 2, 0, 4, 1][doc_id % 6 + 1]::INT AS header_lines, 7 + [0, 4, 2, 0, 4, 1][doc_id % 6 + 1]::BIGINT AS line FROM documents")
def strip_header(spark, d):
    """Documents below six kinds of beginnings, and the seventh line of what is left as a line of the whole."""
    s = _docs(spark, d).select("doc_id", text.strip_header(F.concat(pick(HEADERS, _i()), F.lit("code();\n"), "text")).alias("s"))
    return s.select("doc_id", F.md5("s.body").alias("body"), "s.header_lines", text.shift_lines(F.lit(7).cast("long"), F.col("s.header_lines")).alias("line"))


_CODE = "'f {' || chr(10) || text || chr(10) || '}' || repeat(chr(10) || 'tail', doc_id::INT % 60)"


@query(f"""WITH l AS (SELECT doc_id, string_split({_CODE}, chr(10)) AS l FROM documents), c AS (SELECT doc_id, CASE WHEN len(l) > 48 THEN array_to_string(l[:28], chr(10)) || chr(10) || '/* ... ' || (len(l) - 36)::VARCHAR || ' lines omitted ... */' || chr(10) || array_to_string(l[-8:], chr(10)) ELSE array_to_string(l, chr(10)) END AS t FROM l),
 b AS (SELECT doc_id, t, instr(t, '}}') AS e, string_split(substr(t, 3, instr(t, '}}') - 2), chr(10)) AS x FROM c)
 SELECT doc_id, md5(CASE WHEN e > 0 AND e - 2 > 160 AND len(x) > 4 AND NOT contains(substr(t, 4, e - 3), '{{') THEN 'f ' || x[1] || chr(10) || '  /* ... ' || (len(x) - 2)::VARCHAR || ' lines ... */' || chr(10) || x[-1] || substr(t, e + 1) ELSE t END) AS digest FROM b""".replace("{{", "{").replace("}}", "}"))
def compact_code(spark, d):
    """Documents inside a brace block, with up to 59 lines behind it."""
    code = F.concat(F.lit("f {\n"), "text", F.lit("\n}"), F.repeat(F.lit("\ntail"), (_i() % 60).cast("int")))
    return _docs(spark, d).select("doc_id", F.md5(text.compact_code(code)).alias("digest"))


@query("SELECT doc_id, md5('a' || chr(10) || CASE WHEN doc_id % 3 = 2 THEN '```python' || chr(10) || text || chr(10) || '```' ELSE '[' || ['mermaid', 'drawio'][doc_id % 3 + 1] || ' diagram omitted — ' || (3 + length(text) - length(replace(text, chr(10), '')))::VARCHAR || ' lines]' END || chr(10) || 'b') AS digest FROM documents")
def diagrams_stripped(spark, d):
    t = F.concat(F.lit("a\n```"), pick(("mermaid", "DrawIO", "python"), _i()), F.lit("\n"), "text", F.lit("\n```\nb"))
    return _docs(spark, d).select("doc_id", F.md5(text.strip_diagrams(t)).alias("digest"))


@query("SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['docs/g' || (doc_id % 5)::VARCHAR || '/b.md', 'docs/src/f' || doc_id::VARCHAR || '.ts'] ELSE ['docs/g' || (doc_id % 5)::VARCHAR || '/x y.md', 'docs/src/f' || doc_id::VARCHAR || '.ts'] END) AS link FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'docs/src/f' || doc_id::VARCHAR || '.ts' FROM documents WHERE doc_id % 2 = 1")
def markdown_files(spark, d):
    t = F.concat(F.lit("see [a](../src/f"), _s(), F.lit('.ts#L1 "T") ![i](p.png) [w](HTTPS://e.org/q.md) [m](mailto:x@y) [h](#top) [again](../src/./f'), _s(), F.lit(".ts?x) "), F.when(_i() % 2 == 0, "<b.md>").otherwise("<b>"))
    p = F.concat(F.lit("docs/g"), (_i() % 5).cast("string"), F.lit("/a.md"))
    return _docs(spark, d).select("doc_id", F.explode(text.markdown_links(t, p)).alias("link"))


@query("""SELECT doc_id, 0::INT AS pos, 'text' AS kind, 'go ' AS label, NULL AS href, NULL AS title FROM documents UNION ALL SELECT doc_id, 1, 'link', 'to ' || lang, 'https://h/' || doc_id::VARCHAR, 'T ' || source FROM documents
 UNION ALL SELECT doc_id, 2, 'text', ', [no](ftp://x) ', NULL, NULL FROM documents UNION ALL SELECT doc_id, 3, 'link', 'run', 'command:a.b', NULL FROM documents""")
def inline_links(spark, d):
    t = F.concat(F.lit("go [to "), "lang", F.lit("](https://h/"), _s(), F.lit(' "T '), "source", F.lit('"), [no](ftp://x) [run](command:a.b)'))
    return _docs(spark, d).select("doc_id", F.explode(text.linked_text(t)).alias("x")).select("doc_id", "x.pos", "x.kind", "x.label", "x.href", "x.title")


@query("SELECT doc_id, [6, 2, 4, 5, 2][doc_id % 5 + 1]::INT AS start FROM documents")
def leading_comments(spark, d):
    """Where the comment above line 6 begins: none, a block comment over a blank line, line comments, one behind two blanks, a decorated one."""
    lines = (["x", "// far", "", "", "y", "def"], ["x", "/**", " * d", " */", "", "def"], ["x", "y", "", "# a", "# b", "def"], ["x", "# a", "", "", "# b", "def"], ["x", "// a", "", "@note", "// b", "def"])
    picked = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in lines)), (_i() % 5 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", text.leading_comment_start(picked, F.lit(6)).alias("start"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' > last' ELSE source || ' > ' || lang || ' > last' END AS crumb FROM documents")
def breadcrumbs(spark, d):
    meta = F.create_map(F.lit("Header_10"), F.lit("last"), F.lit("Header_2"), F.when(_i() % 3 != 0, F.col("lang")), F.lit("other"), F.lit("x"), F.lit("Header_1"), F.col("source"))
    return _docs(spark, d).select("doc_id", text.header_breadcrumb(meta).alias("crumb"))


# Routing ---------------------------------------------------------------------------------------------------

ASKED = ("explain the parser", "debug it", "show last commit", "what files did I modify", "read the README guide", "where is the class; compare both", "hm", "how does the call graph work? and the git history?")
_ASKED = "(SELECT doc_id, doc_id % 8 AS k FROM documents)"


def _asked(spark, d):
    return _docs(spark, d).select("doc_id", pick(ASKED, _i()).alias("q"))


@query(f"SELECT doc_id, ['small', 'big', 'own', 'own', 'own', 'own', 'own', 'own'][k + 1] AS model FROM {_ASKED}")
def model_routes(spark, d):
    return _asked(spark, d).select("doc_id", text.route_model(F.col("q"), {"reasoning": "big", "fast": "small"}, "own").alias("model"))


@query(f"SELECT doc_id, ['all', 'all', 'git_commit', 'all', 'doc_chunk', 'code_chunk', 'all', 'git_commit'][k + 1] AS targets, [NULL, NULL, 'recent_commits', 'working_diff', NULL, NULL, NULL, NULL][k + 1] AS git, CASE WHEN k IN (5, 7) THEN 'complex' ELSE 'simple' END AS complexity FROM {_ASKED}")
def question_routes(spark, d):
    q = F.col("q")
    return _asked(spark, d).select("doc_id", F.array_join(text.targets(q), ",").alias("targets"), text.git_mode(q).alias("git"), text.complexity(q).alias("complexity"))


@query("SELECT doc_id, doc_id % 4 IN (0, 2) AS fatal FROM documents")
def embedding_errors(spark, d):
    m = pick(("x ECONNREFUSED y", "rate limit", "CUDA error: out of memory", ""), _i())
    return _docs(spark, d).select("doc_id", text.is_fatal_embedding_error(m).alias("fatal"))


@query("SELECT doc_id, '#' || doc_id::VARCHAR || ' score=' || printf('%.4f', n_chars / 7.0::DOUBLE) || ' type=' || lang || ' ' || source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':3-3' ELSE ':3-9' END AS line FROM documents")
def summary_lines(spark, d):
    start, end = F.when(_i() % 3 != 0, 3), F.when(_i() % 3 == 2, 9)
    return _docs(spark, d).select("doc_id", text.result_line(_i(), F.col("n_chars") / F.lit(7.0), F.col("lang"), F.col("source"), start, end).alias("line"))


# Search and sections -----------------------------------------------------------------------------------------


@query("SELECT doc_id, unnest(['## Diff', '--- FILE: ' || source || chr(10) || 'x', '--- GRAPH IMPORT', '--- LINKED CODE: ' || lang]) AS section FROM documents")
def context_sections(spark, d):
    t = F.concat(F.lit("## Diff\n\n--- FILE: "), "source", F.lit("\nx\n\n--- GRAPH IMPORT\n\n--- LINKED CODE: "), "lang")
    return _docs(spark, d).select("doc_id", F.explode(text_search.split_context(t)).alias("section"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 1 THEN 4 ELSE 3 END::INT AS start, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 4 END::INT AS \"end\" FROM documents")
def snippets_found(spark, d):
    """Exact, over CRLF, relaxed (no marks, no fence), and nowhere. Each document is named so that nothing else fits."""
    name = F.concat(F.lit("Body "), _s())
    whole = F.concat(F.lit("a\r\nb\r\n**"), name, F.lit("** line\r\nnext `"), _s(), F.lit("` one\r\n"))
    snippet = F.when(_i() % 4 == 0, F.concat(F.lit("**"), name, F.lit("** line"))).when(_i() % 4 == 1, F.concat(F.lit("next `"), _s(), F.lit("` one"))).when(_i() % 4 == 2, F.concat(F.lit("```md\n"), name, F.lit(" line\nnext "), _s(), F.lit(" one\n```"))).otherwise("elsewhere")
    f = _docs(spark, d).select("doc_id", text_search.find_text(whole, snippet).alias("f"))
    return f.select("doc_id", "f.start", "f.end")


@query("""SELECT doc_id, 2::INT AS line_no, 'region' AS kind, 'Part ' || lang AS label, false AS separator FROM documents UNION ALL SELECT doc_id, 4, 'mark', source, true FROM documents UNION ALL SELECT doc_id, 5, 'mark', 'x y', false FROM documents""")
def section_lines(spark, d):
    t = F.concat(F.lit("code\n// #region Part "), "lang", F.lit("\n# region\n//MARK: - "), "source", F.lit("\n/* MARK: x y */\nremark: none"))
    return text_search.section_headers(_docs(spark, d).withColumn("text", t), "doc_id")


@query("SELECT doc_id, (3 + doc_id % 120)::INT AS line_no, (5 + doc_id % 120)::INT AS end_line, lang AS label, true AS separator FROM documents")
def marked_blocks(spark, d):
    """A header over three lines, wherever it lies in chunks of a hundred lines."""
    t = F.concat(F.repeat(F.lit("x\n"), (2 + _i() % 120).cast("int")), F.lit("// ====\n// "), "lang", F.lit("\n// ====\nend"))
    return text_search.marked_blocks(_docs(spark, d).withColumn("text", t), "doc_id", r"^// (?P<separator>=+)\n^// (?P<label>[^\n]*)\n^// =+$")


@query("SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'x/B.MD' WHEN 1 THEN 'docs/q.md' WHEN 2 THEN 'plain.md' END AS path FROM (SELECT DISTINCT conv_id FROM conversations)")
def deliverables(spark, d):
    """Four kinds of conversations: a written file, a named one with a folder, one without after a word for writing, none."""
    k = F.col("conv_id") % 4
    ids = load(spark, d, "conversations").select("conv_id").distinct()
    row = lambda turn, role, t, path=None, tool=None, ok=None, folder=False: F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role"), t.alias("text"), F.lit(path).cast("string").alias("path"), F.lit(tool).cast("string").alias("tool"), F.lit(ok).cast("boolean").alias("ok"), F.lit(folder).alias("is_folder"))
    said = F.when(k == 3, "see plain.md").when(k == 2, "please write it\ninto plain.md\nor create plain.md").otherwise("look at `docs/q.md` first, then a/r.md")
    tools = F.when(k == 0, F.array(row(1, "tool", F.lit(""), "y/a.md", "edit_file", True), row(2, "tool", F.lit(""), "x/B.MD", "create_file_or_folder", True), row(3, "tool", F.lit(""), "z/c.md", "create_file_or_folder", True, True), row(4, "tool", F.lit(""), "z/d.md", "edit_file", False), row(5, "tool", F.lit(""), "z/e.md", "read_file", True)))
    none = F.array().cast("array<struct<turn:int,role:string,text:string,path:string,tool:string,ok:boolean,is_folder:boolean>>")
    m = ids.select("conv_id", F.explode(F.concat(F.array(row(0, "user", said)), F.coalesce(tools, none))).alias("m")).select("conv_id", "m.*")
    return text_search.deliverable(m).select("conv_id", F.when(F.col("path") != "", F.col("path")).alias("path"))


# Strings, lines, numbers -------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper('new-' || c_mktsegment) WHEN 1 THEN lower('new-' || c_mktsegment) WHEN 2 THEN 'New-' || c_mktsegment WHEN 3 THEN 'New-' || lower(c_mktsegment) ELSE 'nEW' END AS made FROM customer")
def case_kept(spark, d):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    match = pick(("OLD-TEXT", "old-text", "Old", "Old-text", "oLD"), k)
    new = F.when(k % 5 == 4, "NEW").when(k % 5 == 3, F.concat(F.lit("new-"), seg)).otherwise(F.concat(F.lit("new-"), seg))
    return load(spark, d, "customer").select("c_custkey", text.preserve_case(match, new).alias("made"))


@query("SELECT event_id, (x >= 0 AND y >= 0 AND 2 * x + y <= 8) AS inside FROM (SELECT event_id, (event_id % 11 - 3)::DOUBLE AS x, (event_id // 11 % 13 - 2)::DOUBLE AS y FROM events)")
def in_triangle(spark, d):
    x, y = (F.col("event_id") % 11 - 3).cast("double"), (F.floor(F.col("event_id") / 11) % 13 - 2).cast("double")
    return load(spark, d, "events").select("event_id", scalar.in_triangle(x, y, 0, 0, 4, 0, 0, 8).alias("inside"))


@query("SELECT event_id, CASE WHEN s >= 999 AND s < 1000 THEN '99%' ELSE printf('%.0f', floor(s / 10.0)) || '%' END AS label, printf('%.1f', s / 10.0) || '%' AS fine FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 999 WHEN event_id % 7 = 1 THEN 1000 ELSE event_id % 100 * 10 END AS s FROM events)")
def percent_labels(spark, d):
    i = F.col("event_id")
    s = F.when(i % 7 == 0, 999).when(i % 7 == 1, 1000).otherwise(i % 100 * 10) / 1000
    return load(spark, d, "events").select("event_id", scalar.percent_label(s).alias("label"), scalar.percent_label(s, 1).alias("fine"))


@query("WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS i, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, i, CASE WHEN trim(line) = '' THEN 0 ELSE 1000 - i % 4 END::INT AS score, true AS same FROM l")
def line_scores(spark, d):
    """Scores of lines put in by up to three blanks, and whether their keys stay the same."""
    l = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))  # noqa: E741
    put = F.concat(F.repeat(F.lit(" "), F.col("i") % 4), F.ltrim("line"))
    return l.select("doc_id", "i", diff.boundary_score(put).alias("score"), (diff.line_key(put) == diff.line_key(F.concat(F.trim("line"), F.lit("  ")))).alias("same"))


@query("SELECT event_id, CASE WHEN k = 5 THEN NULL ELSE 'a/' || event_type || '.txt' END AS path, CASE WHEN k = 5 THEN NULL ELSE user_id END::INT AS line, CASE WHEN k IN (0, 2, 4) THEN 7 END::INT AS col FROM (SELECT *, event_id % 6 AS k FROM events)")
def path_ranges(spark, d):
    p, n = F.concat(F.lit("a/"), "event_type", F.lit(".txt")), F.col("user_id").cast("string")
    forms = (F.concat(p, F.lit(":"), n, F.lit(":7")), F.concat(p, F.lit(":"), n), F.concat(p, F.lit("("), n, F.lit(",7)")), F.concat(p, F.lit("#"), n), F.concat(p, F.lit(", line "), n, F.lit(", col 7")), p)
    made = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    e = load(spark, d, "events").select("event_id", text.path_range(made).alias("r"))
    return e.select("event_id", "r.path", "r.line", F.col("r.column").alias("col"))


@query("""SELECT event_id, CASE WHEN s >= 31536000 THEN 'yr' WHEN s >= 2592000 THEN 'mo' WHEN s >= 604800 THEN 'wk' WHEN s >= 86400 THEN 'day' WHEN s >= 3600 THEN 'hr' WHEN s >= 60 THEN 'min' WHEN s >= 30 THEN 'sec' ELSE 'now' END AS unit,
 (CASE WHEN s >= 31536000 THEN s // 31536000 WHEN s >= 2592000 THEN s // 2592000 WHEN s >= 604800 THEN s // 604800 WHEN s >= 86400 THEN s // 86400 WHEN s >= 3600 THEN s // 3600 WHEN s >= 60 THEN s // 60 WHEN s >= 30 THEN s END)::BIGINT AS n,
 CASE WHEN event_id % 2 = 0 AND s >= 30 THEN 'in' WHEN s >= 30 THEN 'ago' END AS way FROM (SELECT event_id, event_id * event_id % 90000000 AS s FROM events)""")
def age_labels(spark, d):
    s = F.col("event_id") * F.col("event_id") % 90_000_000
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    then = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("event_id") % 2 == 0, s).otherwise(-s))
    e = load(spark, d, "events").select("event_id", scalar.age_label(then, now).alias("label"))
    n = F.regexp_extract("label", r"([0-9]+)", 1).try_cast("long")
    unit = F.when(F.col("label") == "now", "now").otherwise(F.regexp_replace(F.regexp_extract("label", "[0-9]+ ([a-z]+)", 1), "s$", ""))
    return e.select("event_id", unit.alias("unit"), n.alias("n"), F.when(F.col("label").startswith("in "), "in").when(F.col("label").endswith(" ago"), "ago").alias("way"))


@query("SELECT event_id, CASE WHEN v < 1000 THEN v::VARCHAR || 'ms' WHEN v < 60000 THEN printf('%.1f', v / 1000.0::DOUBLE) || 's' WHEN v < 3600000 THEN printf('%.1f', v / 60000.0::DOUBLE) || 'm' ELSE printf('%.1f', v / 3600000.0::DOUBLE) || 'h' END AS label FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 1000 WHEN event_id % 4 = 1 THEN (event_id % 50 + 1) * 1000 WHEN event_id % 4 = 2 THEN (event_id % 50 + 1) * 60000 ELSE (event_id % 9 + 1) * 3600000 END AS v FROM events)")
def duration_labels(spark, d):
    i = F.col("event_id")
    v = F.when(i % 4 == 0, i % 1000).when(i % 4 == 1, (i % 50 + 1) * 1000).when(i % 4 == 2, (i % 50 + 1) * 60_000).otherwise((i % 9 + 1) * 3_600_000)
    return load(spark, d, "events").select("event_id", scalar.duration_label(v).alias("label"))


@query("SELECT event_id, a = b OR starts_with(b, a || '.') AS holds FROM (SELECT event_id, ['a', 'a.b', 'a.b.c', 'ab'][event_id % 4 + 1] AS a, ['a', 'a.b', 'a.bc', 'a.b.c'][event_id // 4 % 4 + 1] AS b FROM events)")
def kinds_contained(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select("event_id", scalar.kind_contains(pick(("a", "a.b", "a.b.c", "ab"), i), pick(("a", "a.b", "a.bc", "a.b.c"), F.floor(i / 4))).alias("holds"))


@query("SELECT event_id, repeat(' ', w) || 'x' AS spaces, repeat(chr(9), w // 4) || repeat(' ', w % 4) || 'x' AS tabs FROM (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE (event_id % 7) // 4 * 4 + 4 + event_id % 3 END)::INT AS w FROM events)")
def indents_normalised(spark, d):
    i = F.col("event_id")
    lead = F.concat(F.repeat(F.lit(" "), (i % 7).cast("int")), F.when(i % 2 == 1, F.concat(F.lit("\t"), F.repeat(F.lit(" "), (i % 3).cast("int")))).otherwise(""), F.lit("x"))
    return load(spark, d, "events").select("event_id", text.normalise_indent(lead, 4, True).alias("spaces"), text.normalise_indent(lead, 4, False).alias("tabs"))


@query("SELECT event_id, CASE WHEN c <= 5 THEN 'first' WHEN c <= 6 THEN 'first' WHEN c < 9 THEN NULL WHEN c <= 9 + length(event_type) THEN event_type END AS word, (CASE WHEN c <= 6 THEN 1 WHEN c < 9 THEN NULL WHEN c <= 9 + length(event_type) THEN 9 END)::INT AS start FROM (SELECT event_id, event_type, event_id % 20 + 1 AS c FROM events)")
def words_at(spark, d):
    e = load(spark, d, "events").select("event_id", text.word_at(F.concat(F.lit("first - "), "event_type", F.lit(" !")), (F.col("event_id") % 20 + 1).cast("int")).alias("w"))
    return e.select("event_id", "w.word", "w.start")


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, doc_id % 9 - 1 AS line, doc_id % 30 AS col FROM documents)
 SELECT doc_id, (CASE WHEN line < 1 THEN 0 WHEN line > len(l) THEN length(text) ELSE coalesce(list_sum(list_transform(l[:line - 1], lambda x: length(x) + 1)), 0) + greatest(least(col - 1, length(l[line])), 0) END)::BIGINT AS at FROM l""")
def offsets(spark, d):
    return _docs(spark, d).select("doc_id", text.offset_of(F.col("text"), (_i() % 9 - 1).cast("int"), (_i() % 30).cast("int")).cast("long").alias("at"))


@query("SELECT event_id, least(greatest(event_id * 7919 % 2000 - 500, 0), 255)::BIGINT AS byte, least(event_id * 1000003, 4294967295)::BIGINT AS word FROM events")
def saturated(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select("event_id", scalar.saturate(i * 7919 % 2000 - 500, 8).alias("byte"), scalar.saturate(i * 1_000_003, 32).alias("word"))


def _steps(values, start):
    """The same sum of powers of 31, unrolled by SQL over a list of numbers, as signed 32 bits."""
    h = f"list_reduce(list_concat([{start}::HUGEINT], {values}), lambda h, x: (h * 31 + x + 4294967296) % 4294967296)"
    return f"(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)::INT"


_CHARS = "list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)"


@query("SELECT event_id, " + _steps(_CHARS.format("event_type"), 0) + " AS text, " + _steps("list_concat(list_concat([181387::HUGEINT, 149417, 97, 104579, user_id, 863, 149417, 98, 149417], " + _CHARS.format("event_type") + "), [149417::HUGEINT, 99, 349])", 0) + " AS tree FROM events")
def value_hashes(spark, d):
    """Of a word, and of {"a": [user_id, false], "b": word, "c": null}."""
    e = load(spark, d, "events")
    j = F.format_string('{"c": null, "b": "%s", "a": [%d, false]}', "event_type", "user_id")
    return e.select("event_id", scalar.string_hash(F.col("event_type")).alias("text"), scalar.structural_hash(j).alias("tree"))


@query("SELECT doc_id, CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 1 WHEN c IN (' ', '.') THEN 2 ELSE 0 END::INT AS class FROM (SELECT doc_id, substr(text, doc_id % 50 + 1, 1) AS c FROM documents) WHERE c <> ''")
def char_classes(spark, d):
    c = F.substring("text", (_i() % 50 + 1).cast("int"), F.lit(1))
    return _docs(spark, d).withColumn("c", c).where("c <> ''").select("doc_id", text.char_class(F.col("c"), {"aeiou": 1, " .": 2}, 0).alias("class"))


# Differences -----------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, (n // 5 + n // 7)::INT AS edits, (n // 5 + n // 7)::INT AS scored, true AS whole FROM l")
def line_diff(spark, d):
    """Each document against itself without every fifth line and with a new line behind every seventh: lines edited, and whether
    the lengths of what stays agree."""
    lines = F.split("text", "\n")
    new = F.flatten(F.transform(lines, lambda x, i: F.concat(F.when((i + 1) % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(x)), F.when((i + 1) % 7 == 0, F.array(F.concat(F.lit("\x01 new "), i.cast("string")))).otherwise(F.array().cast("array<string>")))))
    pairs = _docs(spark, d).select("doc_id", "text", F.array_join(new, "\n").alias("next"), F.size(lines).alias("n"), F.size(new).alias("m"))
    size = lambda c, a, b: F.aggregate(c, F.lit(0), lambda s, e: s + e[b] - e[a])
    pairs = pairs.withColumn("one", diff.line_diff("text", "next")).withColumn("two", diff.line_diff_scored("text", "next"))
    stays = (F.col("n") - size("one", "a_start", "a_end") == F.col("m") - size("one", "b_start", "b_end")) & (F.col("n") - size("two", "a_start", "a_end") == F.col("m") - size("two", "b_start", "b_end"))
    # A text whose lines all go is one empty line, not none.
    both = lambda c: size(c, "a_start", "a_end") + size(c, "b_start", "b_end") - F.when(F.col("m") == 0, 1).otherwise(0)
    return pairs.select("doc_id", both("one").alias("edits"), both("two").alias("scored"), (stays | (F.col("m") == 0)).alias("whole"))


@query("""WITH k AS (SELECT c_custkey, unnest([0, 1, 2, 3]) AS p FROM customer), c AS (SELECT c_custkey, c_custkey % 4 AS m FROM customer)
 SELECT c_custkey, 'unchanged' AS status, p::INT AS original, (CASE WHEN m = 1 AND p > 0 THEN p - 1 WHEN m = 2 AND p > 1 THEN p + 1 ELSE p END)::INT AS modified FROM k JOIN c USING (c_custkey) WHERE NOT (m = 1 AND p = 0) AND NOT (m = 3 AND p = 2)
 UNION ALL SELECT c_custkey, 'deleted', 0, NULL FROM c WHERE m = 1 UNION ALL SELECT c_custkey, 'inserted', NULL, 2 FROM c WHERE m = 2 UNION ALL SELECT c_custkey, 'modified', 2, 2 FROM c WHERE m = 3""")
def cell_statuses(spark, d):
    """Four cells against themselves; without the first; with one put in; with one changed."""
    k = F.col("c_custkey") % 4
    a = F.array(*map(F.lit, "wxyz"))
    b = F.when(k == 1, F.array(*map(F.lit, "xyz"))).when(k == 2, F.array(*map(F.lit, "wxnyz"))).when(k == 3, F.array(*map(F.lit, "wxmz"))).otherwise(a)
    return load(spark, d, "customer").select("c_custkey", F.explode(diff.cell_diff(a, b)).alias("s")).select("c_custkey", "s.status", "s.original", "s.modified")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'deleted' WHEN d.doc_id IS NULL THEN 'inserted' ELSE 'unchanged' END AS status FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def row_statuses(spark, d):
    return diff.set_diff(_docs(spark, d).where("doc_id % 3 <> 0"), load(spark, d, "labels"), "doc_id")
