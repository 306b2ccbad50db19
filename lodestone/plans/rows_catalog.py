"""Queries over projections, joins, aggregates, sets and functions that users bring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import registry, scalar, timeline
from ..operators import aggregates as agg
from ..operators import graph, joins, ranking, windows
from ..session import load, spread
from .registered import query
from .sources_catalog import PATHS, paths, pick

# Projections and predicates ----------------------------------------------------------------------------


@query("SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))))::INT AS i, md5(unnest(string_split(text, chr(10)))) AS line FROM documents")
def flat_map(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.md5("line"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus <> 'P'")
def filter_rows(spark, d):
    return load(spark, d, "orders").where((F.col("o_totalprice") > 400_000) & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, bool_or(event_type = 'purchase') AS bought, min(event_id) FILTER (value > 50) AS found, min_by(event_type, event_id) AS first, bool_and(value < 0) AS is_empty FROM events GROUP BY user_id")
def some_and_first(spark, d):
    e = load(spark, d, "events")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.min(F.when(F.col("value") > 50, F.col("event_id"))).alias("found"), F.min_by("event_type", "event_id").alias("first"), (F.count_if(F.col("value") >= 0) == 0).alias("is_empty"))


def _order_lists(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))


_LISTS = "(SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey)"
_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"SELECT o_custkey, list_sum(a)::BIGINT AS total, len(a)::INT AS n, list_reduce(a, lambda s, x: (s * 31 + x) % 1000003)::BIGINT AS folded FROM {_LISTS}")
def array_fold(spark, d):
    """A reducer over arrays, of the user's own."""
    a = F.col("a")
    folded = agg.fold_arrays(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.element_at(a, 1), lambda s, x: (s * 31 + x) % 1_000_003)
    return _order_lists(spark, d).select("o_custkey", agg.fold_arrays(a, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(a).alias("n"), folded.alias("folded"))


@query(f"SELECT o_custkey, array_to_string(list_transform(list_reverse(a), lambda x: x::VARCHAR), ',') AS a FROM {_LISTS}")
def reverse_array(spark, d):
    return _order_lists(spark, d).select("o_custkey", _joined(F.reverse("a")).alias("a"))


@query(f"""SELECT o_custkey, {', '.join(f"array_to_string(list_transform({x}, lambda x: x::VARCHAR), ',') AS {n}" for x, n in (('a[2:3]', 'middle'), ('a[greatest(len(a) - 1, 1):]', 'tail'), ('a[:greatest(len(a) - 2, 0)]', 'head'), ('a[4:2]', 'none')))} FROM {_LISTS}""")
def slice_items(spark, d):
    a = F.col("a")
    return _order_lists(spark, d).select("o_custkey", *(_joined(agg.slice_array(a, *x)).alias(n) for x, n in (((1, 3), "middle"), ((-2,), "tail"), ((0, -2), "head"), ((3, 2), "none"))))


@query("(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7) UNION ALL (SELECT 'rest', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 7)")
def consume(spark, d):
    o = load(spark, d, "orders").orderBy("o_totalprice", "o_orderkey").select("o_orderkey")
    return o.limit(7).withColumn("part", F.lit("head")).unionByName(o.offset(7).withColumn("part", F.lit("rest")))


@query("""WITH h AS (SELECT user_id AS query_id, event_id AS chunk_id, value AS score, event_type AS doc_type FROM events),
 r AS (SELECT 'purchase' AS route, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE doc_type = 'purchase' UNION ALL SELECT 'all', *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM h)
 SELECT route, query_id, chunk_id, rank::INT AS rank FROM r WHERE rank <= 3""")
def route_limit(spark, d):
    h = load(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"), F.col("event_type").alias("doc_type"))
    out = [ranking.by_route(h, r, 3).withColumn("route", F.lit(r)) for r in ("purchase", "all")]
    return out[0].unionByName(out[1]).select("route", "query_id", "chunk_id", "rank")


@query(f"""SELECT doc_id FROM {PATHS} JOIN labels USING (doc_id) WHERE CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END IN ('warning', 'info')
 AND (path LIKE 'src/%' OR path LIKE '%.MD') AND NOT path LIKE '%/Out/%' AND NOT contains(lower(text), 'trash')""")
def marker_filter(spark, d):
    from ..functions import text

    m = paths(spark, d).join(load(spark, d, "labels"), "doc_id")
    level = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info")
    return m.where(text.marker_filter(level, F.col("path"), F.col("text"), {"warning", "info"}, ["src/**", "**/*.MD"], ["**/Out/**"], "!Trash")).select("doc_id")


_NULLS = "(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS a, CASE WHEN event_id % 4 = 1 THEN upper(event_type) WHEN event_id % 4 = 2 THEN 'view' END AS b FROM events)"


def _null_pairs(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    return load(spark, d, "events").select("event_id", F.when(i % 3 != 0, t).alias("a"), F.when(i % 4 == 1, F.upper(t)).when(i % 4 == 2, "view").alias("b"))


@query(f"SELECT event_id, a IS NOT DISTINCT FROM b AS same, CASE WHEN a IS NULL AND b IS NULL THEN true WHEN a IS NULL OR b IS NULL THEN false ELSE lower(a) = lower(b) END AS alike FROM {_NULLS}")
def null_aware_equal(spark, d):
    p = _null_pairs(spark, d)
    return p.select("event_id", registry.equal_by(lambda x, y: x == y, "a", "b").alias("same"), registry.equal_by(lambda x, y: F.lower(x) == F.lower(y), "a", "b").alias("alike"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS maps, c_custkey % 2 = 0 AS structs, c_custkey % 5 <> 0 AS lists FROM customer")
def structural_equal(spark, d):
    k, v = F.col("c_custkey"), F.col("c_name")
    one = F.create_map(F.lit("a"), v, F.lit("b"), F.col("c_mktsegment"))
    two = F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("a"), F.when(k % 3 != 0, v).otherwise("other"))
    left, right = F.struct(v.alias("x"), k.alias("y")), F.struct(v.alias("x"), F.when(k % 2 == 0, k).otherwise(k + 1).alias("y"))
    lists = agg.structural_key(F.array(k, F.lit(7))) == agg.structural_key(F.when(k % 5 != 0, F.array(k, F.lit(7))).otherwise(F.array(F.lit(7), k)))
    return load(spark, d, "customer").select("c_custkey", (agg.map_key(one) == agg.map_key(two)).alias("maps"), (agg.structural_key(left) == agg.structural_key(right)).alias("structs"), lists.alias("lists"))


@query("SELECT event_id, md5(event_type || user_id::VARCHAR) AS digest FROM events")
def memoised(spark, d):
    """A value worked out once for each distinct key and handed to all its rows; the rows are kept for a second use."""
    e = load(spark, d, "events").withColumn("key", F.concat("event_type", F.col("user_id").cast("string"))).select("event_id", "key").persist()
    return registry.once_per_key(e, "key", lambda k: k.withColumn("digest", F.md5("key"))).select("event_id", "digest")


# Joins --------------------------------------------------------------------------------------------------

_URLS = "(SELECT page_id, regexp_replace(url, '^https?://', '') AS url, split_part(url, '/', 3) AS host, length(html) AS self_time FROM pages)"


@query(f"""WITH n AS {_URLS}, hosts AS (SELECT DISTINCT host FROM n WHERE page_id % 3 = 0), langs AS (SELECT DISTINCT host || '/en' AS prefix FROM n WHERE page_id % 5 = 0)
 SELECT CASE WHEN split_part(url, '/', 1) || '/' || split_part(url, '/', 2) IN (FROM langs) THEN 'english' WHEN host IN (FROM hosts) THEN 'H ' || host ELSE 'rest' END AS category, sum(self_time)::BIGINT AS self_time FROM n GROUP BY 1""")
def category_sums(spark, d):
    n = load(spark, d, "pages").select(F.col("page_id").alias("node_id"), "page_id", F.regexp_replace("url", "^https?://", "").alias("url"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.lit("rest").alias("label"), F.length("html").alias("self_time"))
    hosts = n.where("page_id % 3 = 0").select(F.col("host").alias("prefix"), F.concat(F.lit("H "), "host").alias("category")).distinct()
    langs = n.where("page_id % 5 = 0").select(F.concat("host", F.lit("/en")).alias("prefix"), F.lit("english").alias("category")).distinct()
    return joins.category_sums(n, hosts.unionByName(langs))


def _part_graph(spark, d):
    li = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    s = F.concat(F.lit("s"), "l_suppkey")
    p = F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"))
    edges = li.select(s.alias("src"), p.alias("dst"), F.when(F.col("l_linenumber") < 4, "imports").otherwise("calls").alias("kind")).distinct()
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", F.col("id").alias("file"), F.lit("file").alias("kind"), F.col("id").alias("name")), edges


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey::VARCHAR AS src, 'p' || (l_partkey % 50)::VARCHAR AS dst, CASE WHEN l_linenumber < 4 THEN 'imports' ELSE 'calls' END AS kind FROM lineitem)"


@query(f"""WITH {_EDGES} (SELECT 's1' AS of, file, kind FROM (SELECT dst AS file, kind FROM e WHERE src = 's1') ORDER BY kind, file LIMIT 20)
 UNION ALL (SELECT 'p7', file, kind FROM (SELECT src AS file, CASE kind WHEN 'imports' THEN 'imported_by' ELSE 'references' END AS kind FROM e WHERE dst = 'p7') ORDER BY kind, file LIMIT 20)""")
def related_files(spark, d):
    n, e = _part_graph(spark, d)
    one, two = (graph.related_files(n, e, f).withColumn("of", F.lit(f)) for f in ("s1", "p7"))
    return one.unionByName(two).select("of", "file", "kind")


@query(f"WITH p AS (SELECT doc_id, path FROM {PATHS}), f AS (SELECT DISTINCT path FROM p WHERE doc_id % 2 = 0) SELECT doc_id AS id, path AS file FROM p JOIN f USING (path) WHERE doc_id % 3 = 1")
def linked_files(spark, d):
    p = paths(spark, d)
    hits = p.where("doc_id % 3 = 1").select(F.col("doc_id").alias("id"), F.array("path", F.lit("no/such")).alias("linked_files"))
    return graph.linked_files(hits, p.where("doc_id % 2 = 0").select(F.col("path").alias("file"))).select("id", "file")


@query("""WITH x AS (SELECT l_orderkey % 6 AS seed_ord, l_linenumber AS dep_ord, 'p' || (l_partkey % 30)::VARCHAR AS path FROM lineitem WHERE l_orderkey < 40),
 f AS (SELECT path, min({'s': seed_ord, 'd': dep_ord}) AS pos FROM x WHERE seed_ord < 3 AND dep_ord < 6 AND path NOT IN ('p1', 'p2', 'p3', 'p4', 'p5') GROUP BY path)
 SELECT path, pos.s AS seed_ord, pos.d AS dep_ord FROM f ORDER BY pos, path LIMIT 5""")
def recommended(spark, d):
    x = load(spark, d, "lineitem").where("l_orderkey < 40").select((F.col("l_orderkey") % 6).alias("seed_ord"), F.col("l_linenumber").alias("dep_ord"), F.concat(F.lit("p"), (F.col("l_partkey") % 30).cast("string")).alias("path"))
    return ranking.recommend(x, spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "path string"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey % 5 <> 0)
 SELECT 'left' AS kind, count(*) AS n, count(v) AS hits FROM c LEFT JOIN o USING (k) UNION ALL SELECT 'right', count(*), count(c.k) FROM c RIGHT JOIN o ON c.k = o.k UNION ALL SELECT 'full', count(*), count(v) FROM c FULL JOIN o USING (k)
 UNION ALL SELECT 'semi', count(*), count(*) FROM c SEMI JOIN o USING (k) UNION ALL SELECT 'anti', count(*), count(*) FROM c ANTI JOIN o USING (k) UNION ALL SELECT 'theta', count(*), count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def join_kinds(spark, d):
    c = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("c"))
    o = load(spark, d, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    n = load(spark, d, "nation").select("n_nationkey", "n_regionkey")
    count = lambda df, kind, hit: df.agg(F.count(F.lit(1)).alias("n"), F.count(hit).alias("hits")).select(F.lit(kind).alias("kind"), "n", "hits")
    parts = [count(c.join(o.hint("shuffle_hash"), "k", "left"), "left", "v"), count(c.join(o.hint("merge"), "k", "right"), "right", "c"), count(c.join(o, "k", "full"), "full", "v"), count(c.join(o, "k", "left_semi"), "semi", "c"), count(c.join(o, "k", "left_anti"), "anti", "c")]
    a, b = n.alias("a"), n.alias("b")
    parts.append(count(a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))), "theta", F.lit(1)))
    return agg.union_all(*parts)


@query("""WITH e AS (SELECT user_id AS doc, event_id AS id, event_type AS word, epoch_ms(ts) // 60000 AS pos FROM events), a AS (SELECT doc, word, pos FROM e WHERE id % 3 = 0),
 r AS (SELECT user_id AS doc, epoch_ms(ts) // 60000 - 30 AS s, epoch_ms(ts) // 60000 + event_id % 200 AS t FROM events WHERE event_id % 5 = 0),
 n AS (SELECT e.*, (SELECT max(a.pos) FROM a WHERE a.doc = e.doc AND a.word = e.word AND a.pos <= e.pos) AS anchor FROM e)
 SELECT id, word, CASE WHEN word = 'error' OR anchor IS NULL THEN 2097152 ELSE (SELECT count(*) FROM r WHERE r.doc = n.doc AND r.s <= anchor AND anchor < r.t AND NOT (r.s <= pos AND pos < r.t)) END::INT AS distance FROM n""")
def word_distance(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.col("event_type").alias("word"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000).alias("pos"))
    ranges = e.where("id % 5 = 0").select("doc", (F.col("pos") - 30).alias("start"), (F.col("pos") + F.col("id") % 200).alias("end"))
    return joins.word_distance(e, e.where("id % 3 = 0").select("doc", "word", "pos"), ranges, ["error"])


@query("""WITH x AS (SELECT o_custkey AS doc, o_orderkey * 10 AS s, o_orderkey * 10 + o_orderkey % 4 AS e, o_orderkey % 5 AS n FROM orders), i AS (SELECT DISTINCT o_custkey AS doc, l_orderkey * 10 + l_linenumber - 1 AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT i.doc, i.i AS index, CASE WHEN NOT bool_or(s <= i.i AND i.i < e) THEN i.i + coalesce(sum(n - (e - s)) FILTER (e <= i.i), 0)::BIGINT END AS new_index FROM i JOIN x ON i.doc = x.doc GROUP BY i.doc, i.i""")
def remapped_indexes(spark, d):
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    k = F.col("o_orderkey")
    edits = o.select(F.col("o_custkey").alias("doc"), (k * 10).alias("start"), (k * 10 + k % 4).alias("end"), (k % 5).alias("length"))
    own = li.join(o, F.col("l_orderkey") == k).select(F.col("o_custkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") - 1).alias("index"))
    return joins.remap_index(own, edits)


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, greatest(l_linenumber, 10)::BIGINT AS lo, least(l_linenumber + l_quantity::BIGINT, 30) AS hi FROM lineitem)
 SELECT l_orderkey, l_linenumber, max(CASE WHEN lo < hi THEN hi - lo ELSE 0 END)::BIGINT AS shared, max(CASE WHEN l_linenumber < 10 THEN 1 ELSE 0 END + CASE WHEN l_linenumber + q > 30 THEN 1 ELSE 0 END)::INT AS parts FROM k GROUP BY ALL""")
def range_parts(spark, d):
    li = load(spark, d, "lineitem")
    s, e = F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + F.col("l_quantity").cast("long")
    both = joins.intersect_range(s, e, F.lit(10).cast("long"), F.lit(30).cast("long"))
    rest = joins.complement_range(s, e, F.lit(10).cast("long"), F.lit(30).cast("long"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.max(both["end"] - both["start"]).alias("shared"), F.max(F.size(rest)).alias("parts"))


_TREE = f"t AS (SELECT DISTINCT path FROM {PATHS} WHERE doc_id % 3 = 0), k AS (SELECT DISTINCT unnest([path, path || '/below', split_part(path, '/', 1), 'none']) AS key FROM {PATHS} WHERE doc_id % 2 = 0)"


def _tree(spark, d):
    p = paths(spark, d)
    tree = p.where("doc_id % 3 = 0").select(F.split("path", "/").alias("k")).distinct()
    keys = p.where("doc_id % 2 = 0").select(F.explode(F.array("path", F.concat("path", F.lit("/below")), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("none"))).alias("s")).distinct()
    return keys.select(F.split("s", "/").alias("k")), tree


@query(f"WITH {_TREE} SELECT 'parent' AS side, key FROM k WHERE EXISTS (SELECT 1 FROM t WHERE key = path OR starts_with(key, path || '/')) UNION ALL SELECT 'children', key FROM k WHERE EXISTS (SELECT 1 FROM t WHERE key = path OR starts_with(path, key || '/')) UNION ALL SELECT 'left', path FROM t WHERE NOT starts_with(path, 'src/a/')")
def prefix_tree(spark, d):
    keys, tree = _tree(spark, d)
    parts = (("parent", joins.has_key_or_parent(keys, tree, "k")), ("children", joins.has_key_or_children(keys, tree, "k")), ("left", joins.delete_recursive(tree, "k", ["src", "a"])))
    return agg.union_all(*(df.select(F.lit(n).alias("side"), F.array_join("k", "/").alias("key")) for n, df in parts))


@query(f"""WITH p AS (SELECT doc_id, string_split(path, '/') AS parts FROM {PATHS}) SELECT array_to_string(parts[:i], '/') AS folder, count(*) AS files, count(DISTINCT array_to_string(parts, '/')) AS names FROM p, range(1, 5) t(i) WHERE i < len(parts) GROUP BY 1""")
def resource_tree(spark, d):
    p = paths(spark, d).select("path", F.explode(joins.ancestors(F.col("path"), own=False)).alias("folder"))
    return p.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("path").alias("names"))


_SYMBOLS = """s AS (SELECT doc_id, 1 + doc_id % 4 AS start_line, 6 + doc_id % 9 AS end_line, 'class' AS kind, 1 AS ord FROM documents UNION ALL SELECT doc_id, 3, 3 + doc_id % 5, CASE WHEN doc_id % 2 = 0 THEN 'struct' ELSE 'function' END, 2 FROM documents),
 c AS (SELECT doc_id, 3 + doc_id % 3 AS line, string_split(text, chr(10)) AS lines, ['code_chunk', 'doc_chunk'][CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END] AS doc_type, CASE WHEN doc_id % 11 = 0 THEN 'class' ELSE 'method' END AS kind, CASE WHEN doc_id % 6 <> 0 THEN 'm' || doc_id::VARCHAR END AS name FROM documents),
 t AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN repeat('long ', 120) WHEN doc_id % 5 = 1 AND len(lines) >= line THEN lines[line] ELSE ' own ' || doc_id::VARCHAR || ' ' END AS text FROM c)"""


@query(f"""WITH {_SYMBOLS}, i AS (SELECT t.doc_id, s.start_line, s.end_line FROM t JOIN s ON s.doc_id = t.doc_id AND s.start_line <= t.line AND t.line <= s.end_line AND s.kind IN ('class', 'struct') QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY s.start_line DESC, s.ord) = 1),
 a AS (SELECT t.*, CASE WHEN i.doc_id IS NOT NULL THEN trim(array_to_string(lines[i.start_line:i.end_line], chr(10)), ' ') ELSE '' END AS around, trim(text, ' ') AS own FROM t LEFT JOIN i USING (doc_id))
 SELECT doc_id, md5(CASE WHEN doc_type <> 'code_chunk' OR length(text) >= 500 OR kind = 'class' OR around = '' OR contains(around, own) THEN text
  ELSE around || chr(10) || chr(10) || '// --- matched symbol (' || kind || ': ' || coalesce(name, 'unknown') || ') ---' || chr(10) || chr(10) || own END) AS digest FROM a""")
def expanded_chunks(spark, d):
    """Short code chunks with their innermost container's lines. Texts stand for source files."""
    docs, i = load(spark, d, "documents"), F.col("doc_id")
    sym = docs.select(i.alias("file"), (1 + i % 4).alias("start_line"), (6 + i % 9).alias("end_line"), F.lit("class").alias("symbol_type"), F.lit(1).alias("ord"))
    sym = sym.unionByName(docs.select(i.alias("file"), F.lit(3).cast("long").alias("start_line"), (3 + i % 5).alias("end_line"), F.when(i % 2 == 0, "struct").otherwise("function").alias("symbol_type"), F.lit(2).alias("ord")))
    line = (3 + i % 3).cast("int")
    lines = F.split("text", "\n")
    own = F.when(i % 5 == 0, F.repeat(F.lit("long "), F.lit(120))).when((i % 5 == 1) & (F.size(lines) >= line), F.get(lines, line - 1)).otherwise(F.concat(F.lit(" own "), i.cast("string"), F.lit(" ")))
    chunks = docs.select(i.alias("chunk_id"), i.alias("file"), F.when(i % 7 == 0, "doc_chunk").otherwise("code_chunk").alias("doc_type"), F.when(i % 11 == 0, "class").otherwise("method").alias("symbol_type"), F.when(i % 6 != 0, F.concat(F.lit("m"), i.cast("string"))).alias("symbol_name"), line.cast("long").alias("start_line"), own.alias("text"))
    out = joins.expand_chunks(chunks, sym, docs.select(i.alias("file"), "text"))
    return out.select(F.col("chunk_id").alias("doc_id"), F.md5("text").alias("digest"))


def _sources(spark, d):
    """A small source file for each customer: it imports the next one's and calls its function."""
    k = F.col("c_custkey")
    t = F.format_string("import { f%d } from './m%d';\nclass K%d extends Base {\n  run() {\n    f%d();\n  }\n}\nfunction f%d() {\n  return shared();\n}\n", k + 1, k + 1, k, k + 1, k)
    return spread(load(spark, d, "customer").select("c_custkey")).select("c_custkey", F.concat(F.lit("src/m"), k.cast("string"), F.lit(".ts")).alias("file"), t.alias("text"))


@query("SELECT c_custkey, 'class' AS symbol_type, 'K' || c_custkey::VARCHAR AS symbol_name, 2::INT AS start_line, 6::INT AS end_line FROM customer UNION ALL SELECT c_custkey, 'function', 'f' || c_custkey::VARCHAR, 7, 9 FROM customer UNION ALL SELECT c_custkey, 'function', 'run', 3, 5 FROM customer")
def code_chunks(spark, d):
    c = _sources(spark, d).select("c_custkey", F.explode(graph.chunk_code("text")).alias("c"))
    return c.select("c_custkey", "c.symbol_type", "c.symbol_name", "c.start_line", "c.end_line")


@query("""SELECT c_custkey, 'imports' AS kind, NULL AS source, './m' || (c_custkey + 1)::VARCHAR AS target, 1::INT AS line FROM customer UNION ALL SELECT c_custkey, 'inherits', 'K' || c_custkey::VARCHAR, 'Base', 2 FROM customer
 UNION ALL SELECT c_custkey, 'calls', 'K' || c_custkey::VARCHAR, 'f' || (c_custkey + 1)::VARCHAR, 4 FROM customer UNION ALL SELECT c_custkey, 'calls', 'f' || c_custkey::VARCHAR, 'shared', 8 FROM customer""")
def code_relations(spark, d):
    r = _sources(spark, d).select("c_custkey", F.explode(graph.extract_relations("text")).alias("r"))
    return r.select("c_custkey", "r.kind", "r.source", "r.target", "r.line")


_VARIED = (
    "function f%1$d() {\n  const s = \"}%1$d\"; return `${ {a: 1}.a }}`;\n}\n// class No%1$d {\nconst h%1$d = (a) => {\n  return /[}/]}/.test(a);\n};\n",
    "/* int no%1$d() { } */\nclass H%1$d { void run%1$d() { go('}'); } };\nint sum%1$d(int a)\n{\n  if (a) { f(\"{\"); }\n}\n",
    "class A%1$d(B):\n    '''def no%1$d():\n'''\n    def f%1$d(self, a,\n          b):\n        return a\n\ndef g%1$d():\n    x = [\n1]\n    return x\n",
    "func (r *T) Name%1$d(x int) {\n  s := `}`\n}\ntype S%1$d struct { a int }\n",
    "fn p%1$d<'a>(x: &'a str) -> &'a str {\n  if true { x } else { x }\n}\nstruct Q%1$d { y: i32 }\n",
    "data class P%1$d(val x: Int)\nclass Q%1$d : R() {\n  fun f%1$d(): Int = 3\n}\n",
)


@query("""WITH s(lang, kind, name, first, last) AS (VALUES (0, 'function', 'f', 1, 3), (0, 'function', 'h', 5, 7), (1, 'class', 'H', 2, 2), (1, 'function', 'run', 2, 2), (1, 'function', 'sum', 3, 6),
  (2, 'class', 'A', 1, 6), (2, 'function', 'f', 4, 6), (2, 'function', 'g', 8, 11), (3, 'function', 'Name', 1, 3), (3, 'struct', 'S', 4, 4), (4, 'function', 'p', 1, 3), (4, 'struct', 'Q', 4, 4),
  (5, 'class', 'P', 1, 1), (5, 'class', 'Q', 2, 4), (5, 'function', 'f', 3, 3))
 SELECT c_custkey, kind, name || c_custkey::VARCHAR AS name, first::INT AS first, last::INT AS last FROM customer JOIN s ON lang = c_custkey % 6""")
def code_symbols(spark, d):
    """Symbols of files in six languages whose strings, comments and expressions hold braces and declarations."""
    k = F.col("c_custkey")
    text = reduce(lambda c, i: c.when(k % 6 == i, F.format_string(_VARIED[i], k)), range(1, 6), F.when(k % 6 == 0, F.format_string(_VARIED[0], k)))
    c = spread(load(spark, d, "customer").select("c_custkey")).select("c_custkey", F.explode(graph.chunk_code(text)).alias("c"))
    return c.select("c_custkey", F.col("c.symbol_type").alias("kind"), F.col("c.symbol_name").alias("name"), F.col("c.start_line").alias("first"), F.col("c.end_line").alias("last"))


@query("""WITH k AS (SELECT c_custkey AS k, (SELECT max(c_custkey) FROM customer) AS last FROM customer), n AS (SELECT 'src/m' || k::VARCHAR || '.ts' AS f, k, last FROM k)
 SELECT f AS src, 'src/m' || (k + 1)::VARCHAR || '.ts' AS dst, 'imports' AS kind FROM n WHERE k < last UNION ALL SELECT f || '#K' || k::VARCHAR, 'src/m' || (k + 1)::VARCHAR || '.ts#f' || (k + 1)::VARCHAR, 'calls' FROM n WHERE k < last
 UNION ALL SELECT f, f || '#' || unnest(['K' || k::VARCHAR, 'f' || k::VARCHAR, 'run']), 'contains' FROM n""")
def code_graph(spark, d):
    """Imports, calls and what files contain, of all the small source files together."""
    _, edges = graph.build_graph(_sources(spark, d))
    return edges.select("src", "dst", "kind")


# Aggregates ------------------------------------------------------------------------------------------------


def _symbols(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("file"), pick(("class", "method"), F.col("l_linenumber")).alias("symbol_type"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string"))).alias("symbol_name"), F.col("l_orderkey").alias("start_line"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end_line"))


_MERGED = "m AS (SELECT l_suppkey AS file, ['class', 'method'][l_linenumber % 2 + 1] AS symbol_type, CASE WHEN l_linenumber <> 3 THEN 'n' || (l_partkey % 5)::VARCHAR END AS symbol_name, min(l_orderkey) AS start_line, max(l_orderkey + l_quantity::BIGINT) AS end_line FROM lineitem GROUP BY file, symbol_type, symbol_name, CASE WHEN l_linenumber = 3 THEN l_orderkey END)"


@query(f"WITH {_MERGED} SELECT * FROM m")
def merged_symbols(spark, d):
    return agg.merge_symbols(_symbols(spark, d))


@query(f"""WITH {_MERGED}, l AS (SELECT file, start_line, symbol_type || ' ' || coalesce(symbol_name, '(anonymous)') || ' L' || start_line::VARCHAR || '-' || end_line::VARCHAR AS line FROM m)
 SELECT file, md5(array_to_string((list(line ORDER BY start_line, line))[:50], chr(10))) AS digest FROM l GROUP BY file""")
def repository_map(spark, d):
    return agg.repository_map(_symbols(spark, d)).select("file", F.md5("text").alias("digest"))


_CHUNKED = """l AS (SELECT doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents), c AS (SELECT *, (ord // 7)::VARCHAR AS header, length(text) AS n FROM l),
 g AS (WITH RECURSIVE r AS (SELECT file, ord, 0 AS grp, header, n AS len FROM c WHERE ord = 0 UNION ALL
   SELECT c.file, c.ord, CASE WHEN r.header <> c.header OR r.len + c.n > 1500 THEN r.grp + 1 ELSE r.grp END, c.header, CASE WHEN r.header <> c.header OR r.len + c.n > 1500 THEN c.n ELSE r.len + 2 + c.n END FROM r JOIN c ON c.file = r.file AND c.ord = r.ord + 1) SELECT * FROM r)"""


def _lines(spark, d):
    """Lines of documents as chunks, under a header for every seven."""
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("file", F.col("ord").cast("long"), F.floor(F.col("ord") / 7).cast("string").alias("header"), "text")


@query(f"WITH {_CHUNKED} SELECT file, ord, grp::INT AS \"group\" FROM g")
def chunk_parents(spark, d):
    return agg.parent_chunks(_lines(spark, d))


@query(f"WITH {_CHUNKED} SELECT g.file::VARCHAR || '::parent::' || grp::VARCHAR AS parent_key, md5(substr(string_agg(c.text, chr(10) || chr(10) ORDER BY c.ord), 1, 1500)) AS digest FROM g JOIN c ON c.file = g.file AND c.ord = g.ord GROUP BY g.file, grp")
def parent_texts(spark, d):
    return agg.parent_texts(_lines(spark, d)).select("parent_key", F.md5("parent_text").alias("digest"))


@query("""WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events),
 g AS (SELECT user_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, event_id FROM l) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first FROM g GROUP BY ALL""")
def equal_line_groups(spark, d):
    g = agg.consecutive_groups(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return g.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("SELECT s_suppkey AS node, s_suppkey // 4 * 4 AS community FROM supplier")
def communities(spark, d):
    """Suppliers in fours, each tied to the others of its four and loosely to the next. What is one community among a hundred is one
    in a graph of any size."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    near = s.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 4))).join(s.toDF("b"), "b")
    group = lambda c: F.floor(F.col(c) / 4)
    e = near.where((group("a") == group("b")) | (F.col("b") == F.col("a") + 4)).select("a", "b", F.when(group("a") == group("b"), 1.0).otherwise(0.01).alias("w"))
    found = graph.louvain(e, resolution=max(1.0, s.count() / 100))[0]
    name = found.groupBy("community").agg(F.min("node").alias("name"))
    own = found.join(name, "community").select("node", F.col("name").alias("community"))
    return s.select(F.col("a").alias("node")).join(own, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(['a', 'b'], list_transform(list(lower(o_orderpriority)), lambda x: x)), lambda x: x <> 'b' AND NOT (bool_or AND x = '5-low')))), ',') AS items FROM (SELECT *, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS bool_or FROM orders) GROUP BY o_custkey, bool_or")
def signed_set(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("l"), F.bool_or(F.col("o_orderstatus") == "P").alias("low"))
    signed = F.concat("l", F.array(F.lit("-B")), F.when(F.col("low"), F.array(F.lit("-5-LOW"))).otherwise(F.array().cast("array<string>")))
    return o.select("o_custkey", F.array_join(agg.signed_set(["A", "b"], signed), ",").alias("items"))


# Functions that users bring ------------------------------------------------------------------------------


def _own_model(texts):
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, length(text)::FLOAT AS a, (length(text) - length(replace(text, 'e', '')))::FLOAT AS b FROM documents")
def embedding_model(spark, d):
    """A model of the user's own, by name; the first provider to answer is used."""
    if "own" not in registry._MODELS:
        registry.register_model("own", lambda texts: registry.first_answer([_own_model], texts))
    v = load(spark, d, "documents").select("doc_id", registry.embedding("own")("text").alias("v"))
    return v.select("doc_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20")
def timeline_provider(spark, d):
    registry.register_timeline("user", lambda uri: load(spark, d, "events").where(F.col("user_id") == int(uri.split(":")[1])))
    return ranking.after_cursor(registry.timeline("user:3"), F.col("ts"), F.col("event_id"), None, 20).select("event_id", "event_type")


@query("""SELECT user_id::VARCHAR AS uri, event_id AS item, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC))::BIGINT AS place FROM events
 WHERE ts < (SELECT max(ts) - INTERVAL '7 days' FROM events) QUALIFY place <= 5""")
def timeline_function(spark, d):
    """The first five events of each user that are over a week older than the last of all, as SQL over a table function."""
    timeline.register(spark)
    events = load(spark, d, "events").select(F.col("user_id").cast("string").alias("uri"), "ts", F.col("event_type").alias("source"), F.col("event_id").alias("item"))
    cursor = events.agg(F.max("ts") - F.expr("interval 7 days")).first()[0]
    return spark.sql("SELECT uri, item, place FROM timeline(TABLE({items}), 5, CAST(:at AS TIMESTAMP_NTZ), '')", {"at": str(cursor)}, items=events)


@query("SELECT doc_id AS file, md5(array_to_string((string_split(text, chr(10)))[2:1 + doc_id % 4], chr(10))) AS digest FROM documents")
def lines_read(spark, d):
    docs = load(spark, d, "documents").withColumnRenamed("doc_id", "file")
    wanted = docs.select("file", F.lit(2).alias("start"), (1 + F.col("file") % 4).cast("int").alias("end"))
    return registry.read_lines(docs.select("file", "text"), wanted).select("file", F.md5("text").alias("digest"))


@query("SELECT * FROM (VALUES ('fails', 'a;b'), ('blank', 'a;b'), ('none', 'a;b'), ('answers', 'x'), ('answers', 'y')) AS t(kind, part)")
def model_sub_questions(spark, d):
    asks = {"fails": lambda q: 1 / 0, "blank": lambda q: [" "], "none": None, "answers": lambda q: ["x", "", "y"]}
    return spark.createDataFrame([(k, p) for k, f in asks.items() for p in registry.sub_questions_with(f, "a;b", lambda q: [q])], "kind string, part string")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1) GROUP BY user_id")
def kept_first(spark, d):
    first = windows.keep_first(load(spark, d, "events"), ["user_id", "event_type"], ["event_id"])
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 4::INT AS least, 9::INT AS most, true AS whole, (SELECT count(*) FROM orders) AS n, true AS near FROM (SELECT 1)")
def random_draws(spark, d):
    """Bounds of seeded draws over orders: whole numbers from 4 to 9, and a chance of a quarter."""
    x = load(spark, d, "orders").select(scalar.random_int(4, 9, 1).alias("x"), scalar.random_chance(0.25, 2).alias("c"))
    return x.agg(F.min("x").cast("int").alias("least"), F.max("x").cast("int").alias("most"), F.bool_and(F.col("x") == F.floor("x")).alias("whole"), F.count(F.lit(1)).alias("n"), (F.abs(F.avg(F.col("c").cast("int")) - 0.25) < 0.05).alias("near"))
