"""Queries over sources and sinks. Paths, logs and small files are made from the tables' columns by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text
from ..functions.scalar import stable_key
from ..operators import graph, graph_index, joins, text_search
from ..session import load, scratch
from ..sources import commit_log, files, stores
from .registered import query

#: Fixed values of the made paths.
TOP = ("src", "lib", "node_modules", ".git", "Tests", "docs", ".", "vendor")
MID = ("a", "build", "Out", "x.y", "deep/er")
EXT = (".ts", ".py", ".MD", ".exe", "", ".java", ".h")


def pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def paths(spark, d):
    """(doc_id, path, text, ...): a path for each document."""
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), (i % 40).cast("string"), pick(EXT, F.floor(i / 3)))
    return load(spark, d, "documents").withColumn("path", F.concat_ws("/", pick(TOP, i), pick(MID, F.floor(i / 8)), name))


PATHS = f"(SELECT *, {list(TOP)}[doc_id % 8 + 1] || '/' || {list(MID)}[doc_id // 8 % 5 + 1] || '/f' || (doc_id % 40)::VARCHAR || {list(EXT)}[doc_id // 3 % 7 + 1] AS path FROM documents)"
_SKIP = str(list(files.SKIPPED))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT doc_id FROM {PATHS} WHERE len(list_filter(string_split(path, '/')[:-2], lambda p: list_contains({_SKIP}, lower(p)) OR (starts_with(p, '.') AND p <> '.' AND p <> '..'))) = 0")
def scan_paths(spark, d):
    return paths(spark, d).where(~files.in_skipped_folder(F.col("path"))).select("doc_id")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', true)" for t in TABLES) + ") AS x(name, has_bytes)")
def scan_files(spark, d):
    """Tables by name, whether they are a file or a folder of part files, and whether all their files were read whole."""
    found = files.scan_bytes(spark, d, "*.parquet").select(F.split_part(files.below(F.col("path"), d), F.lit("/"), F.lit(1)).alias("name"), (F.col("whole") & (F.col("length") > 0)).alias("has_bytes"))
    return found.groupBy("name").agg(F.bool_and("has_bytes").alias("has_bytes"))


@query(f"SELECT doc_id FROM {PATHS} WHERE len(list_intersect(string_split(path, '/'), ['node_modules', '.git', '.build', 'out', 'build', 'dist'])) = 0 AND lower(regexp_extract(path, '\\.[a-zA-Z]*$')) IN ('.ts', '.py', '.md', '.java', '.h')")
def indexable_paths(spark, d):
    return paths(spark, d).where(files.is_indexable(F.col("path"))).select("doc_id")


@query(f"SELECT doc_id FROM {PATHS} WHERE starts_with(path, 'docs/') OR path LIKE '%.ts' OR starts_with(path, 'lib/build/') OR regexp_matches(path, '^src/[^/]*/f1[^/]\\.[^/]*$')")
def ignored_paths(spark, d):
    return paths(spark, d).where(files.is_ignored(F.col("path"), ["docs/", "**/*.ts", " ", "lib\\build", "src/*/f1?.*"])).select("doc_id")


@query(f"""SELECT doc_id FROM {PATHS} WHERE NOT (
  (path LIKE '%.exe' AND NOT (path LIKE '%/f3.exe' OR path LIKE '%/f8.exe')) OR regexp_matches(path, '(^|/)build/') OR starts_with(path, 'vendor/a/')
  OR regexp_matches(path, '^src/(.*/)?[^/]*\\.py$'))""")
def ignore_files(spark, d):
    rules = [("", ["# comment", "*.exe", "!f3.exe", "!f8.exe", "build/", "/vendor/a"]), ("src", ["*.py"])]
    return files.drop_ignored(paths(spark, d), rules).select("doc_id")


@query(f"""WITH p AS (SELECT doc_id, path, string_split(path, '/') AS parts FROM {PATHS}), h AS (SELECT *, array_to_string(parts[1:len(parts) - 1], '/') AS dir, parts[len(parts)] AS name FROM p)
 SELECT doc_id FROM h WHERE NOT (name LIKE '%.exe' OR (contains(path, '/build/') OR starts_with(path, 'build/')) OR (name LIKE 'f1.%' AND NOT name = 'f1.py'))""")
def ignore_table(spark, d):
    """Paths under ignore files of which every folder has one: they rule out what the root's doesn't, and take back one name."""
    p = paths(spark, d).withColumn("path", F.col("path"))
    folders = p.select(F.explode(joins.ancestors(F.col("path"), own=False)).alias("folder")).distinct()
    rules = folders.select("folder", F.lit("# here\nf1.*\n!f1.py\n").alias("text")).unionByName(spark.createDataFrame([("", "*.exe\nbuild/\nf1.*\n!f1.py")], "folder string, text string"))
    return files.drop_ignored_by(p, rules).select("doc_id")


@query(f"WITH p AS (SELECT DISTINCT path FROM {PATHS}) SELECT path FROM p WHERE NOT (path LIKE '%.ts' AND replace(path, '.ts', '.py') IN (SELECT path FROM p))")
def sibling_filter(spark, d):
    return files.listing(paths(spark, d).select("path").distinct(), sibling=("ts", "py"))


def _log_lines(spark, d, log):
    o = load(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.concat(F.lit("h"), "o_orderkey"))
    head = F.concat_ws("|", F.lit("COMMIT"), name, F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), F.lit("x"))
    heads = o.select(log.alias("log"), (F.col("o_orderkey") * 10).alias("line_no"), head.alias("line"))
    n = F.when(F.col("l_linenumber") % 5 == 0, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    li = load(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(log.alias("log"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat_ws("\t", n, F.col("l_linenumber").cast("string"), F.concat(F.lit("p"), "l_partkey", F.lit("/x"))).alias("line"))
    return heads.unionByName(rows)


_COMMITS = """f AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS line_no, 'p' || l_partkey::VARCHAR || '/x' AS path, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity::INT END AS added, l_linenumber AS deleted FROM lineitem),
 c AS (SELECT o_orderkey, 'h' || o_orderkey::VARCHAR AS hash, o_custkey::VARCHAR AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority || '|x' AS message FROM orders WHERE o_orderkey % 50 <> 0)"""


def _commits(spark, d):
    return files.parse_log(_log_lines(spark, d, F.col("o_custkey")))


@query(f"WITH {_COMMITS} SELECT hash, author, date, message, count(path)::INT AS files FROM c LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY ALL")
def git_records(spark, d):
    return _commits(spark, d).select("hash", "author", "date", "message", F.size("files").alias("files"))


@query(f"WITH {_COMMITS} SELECT hash, coalesce(sum(added), 0)::BIGINT AS lines_added, coalesce(sum(deleted), 0)::BIGINT AS lines_deleted, count(path)::INT AS files_changed FROM c LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY hash")
def commit_totals(spark, d):
    return files.commit_totals(_commits(spark, d))


@query(f"""WITH {_COMMITS} SELECT hash, md5('Commit Hash: ' || hash || chr(10) || 'Author: ' || author || chr(10) || 'Date: ' || date || chr(10) || 'Message: ' || message || chr(10) || 'Modified Files:' || chr(10)
 || coalesce(string_agg('- ' || path || ' (+' || added::VARCHAR || ', -' || deleted::VARCHAR || ')', chr(10) ORDER BY line_no, path, added, deleted), '- (no file stats)')) AS digest FROM c LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY hash, author, date, message""")
def commit_documents(spark, d):
    return files.commit_document(_commits(spark, d)).select("hash", F.md5("text").alias("digest"))


@query(f"WITH {_COMMITS} SELECT hash, author, coalesce(sum(added), 0)::BIGINT AS lines_added FROM c LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY hash, author")
def git_log_files(spark, d):
    """Eight captured logs, written as text files and read back."""
    lines = _log_lines(spark, d, F.col("o_custkey") % 8)
    files.write_log(lines.withColumn("line", F.concat("line", F.lit("\r"))), at := scratch(spark, "log"), F.floor(F.col("line_no") / 10))
    commits = files.read_git_log(spark, f"{at}/log=*")
    return commits.select("hash", "author", F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x["added"]).alias("lines_added"))


@query(f"WITH {_COMMITS} SELECT hash, author, coalesce(sum(added), 0)::BIGINT AS lines_added, count(path)::INT AS files FROM c LEFT JOIN f ON l_orderkey = o_orderkey WHERE date >= '1995' GROUP BY hash, author")
def commit_log_source(spark, d):
    """Logs of very unlike sizes, written as text files and read by byte ranges through the data source, with the date pushed into it."""
    lines = _log_lines(spark, d, F.when(F.col("o_custkey") % 10 < 9, 0).otherwise(F.col("o_custkey") % 4))
    files.write_log(lines, at := scratch(spark, "log"), F.floor(F.col("line_no") / 10))
    commit_log.register(spark)
    commits = spark.read.format("commitlog").option("splitBytes", 100_000).option("pushFilters", "true").load(at.removeprefix("file:")).where("date >= '1995'")
    return commits.select("hash", "author", F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x["added"]).alias("lines_added"), F.size("files").alias("files"))


_NUMSTAT = "SELECT 'p' || l_partkey::VARCHAR AS file, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_quantity::INT END AS added, l_linenumber AS removed FROM lineitem"


def _numstat(spark, d):
    n = F.when(F.col("l_linenumber") % 5 == 0, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    lines = load(spark, d, "lineitem").select(F.concat_ws("\t", n, F.col("l_linenumber").cast("string"), F.concat(F.lit("p"), "l_partkey")).alias("line"))
    return files.parse_numstat(lines.unionByName(spark.createDataFrame([("",), ("one\ttwo",)], "line string")))


@query(f"WITH n AS ({_NUMSTAT}) SELECT file, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, count(*) AS n FROM n GROUP BY file")
def diff_numstat(spark, d):
    return _numstat(spark, d).groupBy("file").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count(F.lit(1)).alias("n"))


@query(f"WITH n AS ({_NUMSTAT}) SELECT file, sum(added + removed)::BIGINT AS changed FROM n GROUP BY file ORDER BY changed DESC, file LIMIT 10")
def top_changed_files(spark, d):
    from ..operators.aggregates import top_sums

    return top_sums(_numstat(spark, d).withColumn("changed", (F.col("added") + F.col("removed")).cast("long")), "file", "changed", 10)


@query("""WITH h AS (SELECT source AS folder, doc_id, len(regexp_extract_all(text, '[Tt]hing'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[Tt]hing')),
 c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY folder ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY folder) AS total FROM h)
 SELECT folder, doc_id, least(n, 40 - before)::BIGINT AS taken, total > 40 AS limit_hit FROM c WHERE before < 40""")
def search_folders(spark, d):
    return text_search.search_folders(load(spark, d, "documents"), "source", "doc_id", "[Tt]hing", 40).select(F.col("source").alias("folder"), "doc_id", "taken", "limit_hit")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN md5(text) END AS digest FROM documents")
def decode_bytes(spark, d):
    t = F.col("text")
    little = F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))
    big = F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))
    binary = F.concat(F.unhex(F.lit("80FF00")), F.encode(t, "UTF-8"))
    content = F.when(F.col("doc_id") % 4 == 0, marked).when(F.col("doc_id") % 4 == 1, little).when(F.col("doc_id") % 4 == 2, big).otherwise(binary)
    nested = load(spark, d, "documents").withColumn("file", F.struct(content.alias("content")))
    return nested.select("doc_id", F.md5(files.decode(F.col("file.content"))).alias("digest"))


@query("SELECT vec_id, CAST(('0x' || array_to_string(list_reverse(regexp_extract_all(substr(sha256(vec_id::VARCHAR), 1, 16), '..')), '')) AS UBIGINT)::DECIMAL(20,0) AS key, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, true AS in_cell FROM embeddings")
def saved_index(spark, d):
    """An approximate index written, read back, and joined to its vectors."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    graph_index.GraphIndex(spark, at := scratch(spark, "index")).create(v)
    nodes = graph_index.GraphIndex(spark, at).nodes()
    norm2 = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6)
    return nodes.select(F.col("chunk_id").cast("long").alias("vec_id"), stable_key(F.col("chunk_id")).alias("key"), norm2.alias("norm2"), (F.col("cell") >= 0).alias("in_cell"))


def _chunks(spark, d):
    i = F.col("doc_id")
    p = paths(spark, d).withColumn("doc_type", pick(("code_chunk", "git_commit", "doc_chunk", "weird"), i))
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return p.join(e, "doc_id").select(i.cast("string").alias("chunk_id"), F.when(i % 9 != 0, F.col("path")).alias("file_path"), "doc_type", F.col("text").alias("text_content"), F.create_map(F.lit("lang"), "lang").alias("metadata"), "embedding")


_CHUNKS = f"""SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 9 <> 0 THEN path ELSE 'unknown' END AS file_path, ['code_chunk', 'git_commit', 'doc_chunk', 'code_chunk'][doc_id % 4 + 1] AS doc_type, md5(text) AS digest, '{{"lang":"' || lang || '"}}' AS metadata, len(embedding)::INT AS dims
 FROM {PATHS} JOIN embeddings ON doc_id = vec_id"""


@query(_CHUNKS)
def local_records(spark, d):
    return stores.local_records(_chunks(spark, d)).select("chunk_id", "file_path", "doc_type", F.md5("text_content").alias("digest"), "metadata", F.size("embedding").alias("dims"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{{1,64}}|[0-9a-f]{{7,40}}|[A-Z][A-Z0-9_]{{2,}}'), lambda t: lower(t))) AS tok FROM documents),
 b AS (SELECT doc_id::VARCHAR AS chunk_id, count(DISTINCT tok) AS words FROM t GROUP BY doc_id), c AS ({_CHUNKS})
 SELECT c.*, coalesce(words, 0) > 0 AS has_sparse FROM c LEFT JOIN b USING (chunk_id) WHERE doc_type = 'git_commit'""")
def dual_written_records(spark, d):
    """Dense and sparse records written to both sinks; one route read from each."""
    remote, local = scratch(spark, "remote"), scratch(spark, "local")
    stores.dual_write(stores.remote_records(_chunks(spark, d)), remote, local)
    r, own = (stores.read_records(spark, at, "git_commit") for at in (remote, local))
    both = r.join(own.select("chunk_id"), "chunk_id", "left_semi")
    return both.select("chunk_id", "file_path", "doc_type", F.md5("text_content").alias("digest"), "metadata", F.size("dense_vector").alias("dims"), (F.size("sparse_vector") > 0).alias("has_sparse"))


@query(f"WITH c AS ({_CHUNKS}) SELECT sink, batch, doc_type, count(*) AS n FROM (SELECT *, unnest([0, 1]) AS sink, chunk_id::BIGINT % 3 AS batch FROM c) GROUP BY ALL")
def dual_store(spark, d):
    """Three batches in two sinks: the second is broken off between them and sent again, the third is sent twice."""
    rows = stores.local_records(_chunks(spark, d)).withColumn("batch", F.col("chunk_id").cast("long") % 3)
    store = stores.DualStore(spark, scratch(spark, "remote"), scratch(spark, "local"))
    of = lambda b: rows.where(F.col("batch") == b)
    store.write(of(0), "s", 0)
    stores.DualStore(spark, store.sinks[0]).write(of(1), "s", 1)  # as far as a crash let it come
    for b in (1, 2, 2):
        store.write(of(b), "s", b)
    both = store.read(0).withColumn("sink", F.lit(0)).unionByName(store.read(1).withColumn("sink", F.lit(1)))
    return both.groupBy("sink", "batch", "doc_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (0, '/b/name'), (1, '/b/name'), (2, '/b/hash'), (3, '/b/name')) AS x(there, path)")
def store_layout(spark, d):
    """Which of the folders exist (1: by name, 2: by hash), and the one that is used."""
    there = {0: (), 1: ("/b/name",), 2: ("/b/hash",), 3: ("/b/name", "/b/hash")}
    return spark.createDataFrame([(k, stores.store_path("/b", "name", "hash", lambda p, v=v: p in v)) for k, v in there.items()], "there int, path string")


@query("""SELECT 'nodes' AS kind, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier WHERE s_suppkey >= 5) AS n UNION ALL
 SELECT 'edges', (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey >= 5))""")
def graph_store(spark, d):
    """A graph written and read, with the files of five suppliers purged, and the number of nodes and edges."""
    li = load(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = load(spark, d, "supplier"), load(spark, d, "part")
    nodes = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("file"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    nodes = nodes.unionByName(p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("parts").alias("file"), F.lit("part").alias("kind"), F.col("p_name").alias("name")))
    edges = li.select(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("contains").alias("kind"))
    stores.write_graph(nodes, edges, at := scratch(spark, "graph"))
    nodes, edges = stores.read_graph(spark, at)
    nodes, edges = graph.update_graph(nodes, edges, spark.createDataFrame([(f"s{i}",) for i in range(5)], "file string"), nodes.limit(0), edges.limit(0))
    return graph.entity_count(nodes).withColumn("kind", F.lit("nodes")).unionByName(graph.entity_count(edges).withColumn("kind", F.lit("edges")))


@query("SELECT c_custkey, c_custkey % 7 AS a, 'x//y /* ' || c_mktsegment AS b, c_custkey::INT AS last FROM customer")
def json_with_comments(spark, d):
    c = load(spark, d, "customer")
    t = F.format_string('{ // first\n "a": %d, /* b\n */ "b": "x//y /* %s", "c": [1, %d,], // end\n}', F.col("c_custkey") % 7, "c_mktsegment", "c_custkey")
    v = files.read_jsonc(c.withColumn("t", t), "t", "a long, b string, c array<int>")
    return v.select("c_custkey", "value.a", "value.b", F.element_at("value.c", -1).alias("last"))


@query("""SELECT event_id, 'at' AS path, 'date' AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS value FROM events UNION ALL SELECT event_id, 'find.0', 'regex', '/' || event_type || '+/gi' FROM events
 UNION ALL SELECT event_id, 'find.1', 'json', user_id::VARCHAR FROM events UNION ALL SELECT event_id, 'to.it', 'uri', 'http://h/' || event_type FROM events""")
def typed_json(spark, d):
    e = load(spark, d, "events")
    regex = F.to_json(files.typed_regex(F.concat("event_type", F.lit("+")), F.lit("gi")))
    uri = F.to_json(F.struct(F.lit(files.URI_TAG).alias("$mid"), F.lit("http").alias("scheme"), F.lit("h").alias("authority"), F.concat(F.lit("/"), "event_type").alias("path")))
    t = F.format_string('{"at": %s, "find": [%s, %d], "to": {"it": %s}}', F.to_json(files.typed_date(F.col("ts"))), regex, "user_id", uri)
    return e.select("event_id", F.explode(files.revive_json(t)).alias("x")).select("event_id", "x.*")


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey)
 SELECT o_custkey, array_to_string(list_transform(list_concat(list_concat([-1, -2], a[2:3]), list_concat([-3], a[5:])), lambda x: x::VARCHAR), ',') AS a FROM a WHERE len(a) >= 4""")
def spliced_tokens(spark, d):
    a = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a")).where(F.size("a") >= 4)
    edits = F.expr("array(struct(0 as start, 1 as delete, array(-1L, -2L) as data), struct(3 as start, 1 as delete, array(-3L) as data))")
    return a.select("o_custkey", F.array_join(F.transform(files.splice_tokens(F.col("a"), edits), lambda x: x.cast("string")), ",").alias("a"))


@query("""SELECT c_custkey, 'SEG' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'A.B', c_name || chr(10) || 'x' FROM customer UNION ALL SELECT c_custkey, 'NAT', c_nationkey::VARCHAR || ' # in' FROM customer""")
def env_files(spark, d):
    t = F.format_string('export SEG=old\r\n# note\nA.B="%s\\nx" # end\nNAT=\'%d # in\'\rSEG: %s # last\n', "c_name", "c_nationkey", "c_mktsegment")
    return load(spark, d, "customer").select("c_custkey", F.explode(files.env_entries(t)).alias("e")).select("c_custkey", "e.key", "e.value")


@query("SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_nationkey <> 3")
def json_store(spark, d):
    """Values kept, one deleted, written, and read by another store."""
    at = scratch(spark, "store")
    store = stores.JsonStore(spark, at, delay=3600)
    for r in load(spark, d, "nation").collect():  # 25 rows whatever the scale
        store.set(r.n_name, str(r.n_regionkey))
    store.set("NATION_3", None)
    store.flush()
    return spark.createDataFrame(sorted(stores.JsonStore(spark, at).values.items()), "key string, value string")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_entries(spark, d):
    return load(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>"))).select("event_id", "key", "value")


@query("SELECT * FROM (VALUES (12, 'all', true, 12), (12, 'doc', true, 48), (12, 'doc', false, 12), (20, 'git', true, 64), (0, 'git', true, 0)) AS x(k, route, routed, fetched)")
def oversampled(spark, d):
    rows = spark.createDataFrame([(12, "all", True), (12, "doc", True), (12, "doc", False), (20, "git", True), (0, "git", True)], "k int, route string, routed boolean")
    return rows.withColumn("fetched", scalar.retrieve_k(F.col("k"), F.col("route"), F.col("routed")))


@query(f"SELECT doc_id, CASE lower(regexp_extract(path, '\\.[a-zA-Z]*$')) WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.h' THEN 'cpp' END AS grammar FROM {PATHS}")
def grammars(spark, d):
    return paths(spark, d).select("doc_id", text.grammar(F.col("path")).alias("grammar"))


@query("""WITH p AS (SELECT page_id, ['a.CSS', 'b/c.html', 'd.Png', 'noext', 'e.mjs', 'f.wav', '.svg'][page_id % 7 + 1] AS f FROM pages), m AS (SELECT page_id, ['text/css', 'text/html', 'image/png', NULL, 'text/javascript', 'audio/x-wav', NULL][page_id % 7 + 1] AS mime FROM p)
 SELECT page_id, mime, starts_with(mime, 'text/') AS is_text, mime = 'image/png' AS is_png, mime IS NOT NULL OR NULL AS is_any FROM m""")
def media_types(spark, d):
    name = pick(("a.CSS", "b/c.html", "d.Png", "noext", "e.mjs", "f.wav", ".svg"), F.col("page_id"))
    m = load(spark, d, "pages").select("page_id", text.mime(name).alias("mime"))
    fits = lambda p, n: text.mime_matches(F.lit(p), F.col("mime")).alias(n)
    return m.select("page_id", "mime", fits("TEXT/*", "is_text"), fits("image/PNG", "is_png"), F.when(F.col("mime").isNotNull(), fits("*/*", "is_any")).alias("is_any"))
