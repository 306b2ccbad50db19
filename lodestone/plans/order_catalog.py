"""Queries over windows, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import ranking, text_search, windows
from ..operators.sorted_runs import SortedRuns
from ..session import load, scratch
from ..sources import files
from .registered import query
from .sources_catalog import PATHS, paths


@query("""WITH m AS (SELECT l_suppkey AS g, l_orderkey AS s, l_orderkey + l_quantity::BIGINT % 3 AS e FROM lineitem), p AS (SELECT *, lag(e) OVER (PARTITION BY g ORDER BY s, e) AS prev FROM m),
 i AS (SELECT g, s, e, sum(CASE WHEN prev = s THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM p) SELECT g, island::BIGINT AS island, count(*) AS n, min(s) AS lo, max(e) AS hi FROM i GROUP BY ALL""")
def match_groups(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("start_line"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") % 3).alias("end_line"))
    return windows.group_matches(m, ["g"]).groupBy("g", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("lo"), F.max("end_line").alias("hi"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS ord, o_orderkey * 10 AS s, o_orderkey * 10 + 5 AS e, length(o_orderpriority) // 4 AS size FROM orders), p AS (SELECT *, lag(size) OVER (PARTITION BY o_custkey ORDER BY ord) AS prev FROM r),
 i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM size THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY ord) AS island FROM p) SELECT o_custkey, island::BIGINT AS island, min(s) AS start, max(e) AS "end", any_value(size)::INT AS size FROM i GROUP BY ALL""")
def consolidated_ranges(spark, d):
    r = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 5).alias("end"), F.floor(F.length("o_orderpriority") / 4).cast("int").alias("size"))
    return windows.consolidate(r, ["o_custkey"], "ord")


@query(f"WITH p AS (SELECT DISTINCT path, len(string_split(path, '/')) - 1 AS depth, regexp_replace(path, '/?[^/]*$', '') AS folder FROM {PATHS}) SELECT min(path) AS path FROM p GROUP BY depth, folder ORDER BY depth, folder LIMIT 12")
def one_per_folder(spark, d):
    return windows.one_per_folder(paths(spark, d), "path", 12).select("path")


@query(f"""WITH p AS (SELECT doc_id, path, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS parts FROM {PATHS})
 SELECT doc_id, tier FROM (SELECT doc_id, path, CASE WHEN parts[1] = 'src' THEN 0 WHEN len(list_intersect(parts, ['external', 'third_party', 'third-party', 'vendor', 'vendors', 'deps', 'dependencies'])) > 0 THEN 2 ELSE 1 END::INT AS tier FROM p) ORDER BY tier, lower(path), doc_id LIMIT 60""")
def tiered_paths(spark, d):
    p = paths(spark, d).withColumn("tier", ranking.path_tier(F.col("path"), files.LAST))
    return p.orderBy("tier", F.lower("path"), "doc_id").limit(60).select("doc_id", "tier")


_RESULTS = f"""r AS (SELECT path, count(*) AS count, regexp_extract(path, '\\.[a-zA-Z]*$') AS ext, regexp_extract(path, '[^/]*$') AS name, max(doc_id) AS modified, starts_with(path, 'lib') AS is_folder FROM {PATHS} GROUP BY path)"""
_ORDERS = {"default": "path", "count asc": "count, path", "count desc": "count DESC, path", "type": "ext, path", "file name": "name, path", "modified": "modified DESC, path"}


@query(f"WITH {_RESULTS} " + " UNION ALL ".join(f"(SELECT '{k}' AS by, path FROM r ORDER BY is_folder DESC, {v} LIMIT 30)" for k, v in _ORDERS.items()))
def result_orders(spark, d):
    """The first thirty results in each of the six orders."""
    r = paths(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.max("doc_id").alias("modified")).withColumns({"ext": F.regexp_extract("path", r"\.[a-zA-Z]*$", 0), "name": F.regexp_extract("path", "[^/]*$", 0), "is_folder": F.col("path").startswith("lib")})
    out = None
    for by in ranking.ORDERS:
        got = ranking.order_results(r, by).limit(30).select(F.lit(by).alias("by"), "path")
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT event_id FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 2 END AS webview, value FROM events) ORDER BY user_id, webview NULLS FIRST, value, event_id LIMIT 40")
def cell_order(spark, d):
    i = F.col("event_id")
    e = load(spark, d, "events").select("event_id", F.col("user_id").alias("cell"), F.when(i % 4 != 0, i % 2).alias("webview"), F.struct("value", "event_id").alias("start"))
    return ranking.order_cells(e).limit(40).select("event_id")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, array_to_string(l[:5], chr(10)) || CASE WHEN len(l) > 5 THEN chr(10) || '... ' || (len(l) - 5)::VARCHAR || ' more lines' ELSE '' END AS t FROM l)
 SELECT doc_id, md5(CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || chr(10) || '... cut' ELSE t END) AS digest FROM c""")
def capped_results(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(ranking.cap_result_text(F.split("text", "\n"), 5, 300)).alias("digest"))


_NESTED = "n AS (SELECT DISTINCT o_custkey AS k, o_orderkey * 16 AS s, o_orderkey * 16 + 16 AS e FROM orders UNION SELECT o_custkey, o_orderkey * 16 + 2, o_orderkey * 16 + 9 + o_orderkey % 3 FROM orders UNION SELECT o_custkey, o_orderkey * 16 + 3, o_orderkey * 16 + 5 FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"""WITH {_NESTED}, l AS (SELECT a.k, a.s, a.e, count(b.k) AS level FROM n a LEFT JOIN n b ON a.k = b.k AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e) GROUP BY ALL),
 c AS (SELECT k, level, sum(count(*)) OVER (PARTITION BY k ORDER BY level) AS total FROM l GROUP BY k, level) SELECT l.k, l.s AS start, l.e AS "end", l.level::BIGINT AS level FROM l JOIN c ON l.k = c.k AND l.level = c.level WHERE total <= 30""")
def limited_levels(spark, d):
    o, k = load(spark, d, "orders"), F.col("o_orderkey") * 16
    part = lambda s, e: o.select(F.col("o_custkey").alias("k"), s.alias("start"), e.alias("end"))
    r = part(k, k + 16).unionByName(part(k + 2, k + 9 + F.col("o_orderkey") % 3)).unionByName(o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), (k + 3).alias("start"), (k + 5).alias("end")))
    return ranking.limit_by_level(r, ["k"], 30).select("k", "start", "end", "level")


@query("(SELECT 'up' AS way, p_partkey FROM part ORDER BY lower(p_name), p_name, p_partkey LIMIT 25) UNION ALL (SELECT 'down', p_partkey FROM part ORDER BY lower(p_name || lpad(p_partkey::VARCHAR, 9, '0')) DESC LIMIT 25)")
def sorted_lines(spark, d):
    p = load(spark, d, "part").withColumn("key", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    up = ranking.sort_lines(p.withColumn("line", F.concat("p_name", F.lit(" "), "key")), "line").limit(25).withColumn("way", F.lit("up"))
    down = ranking.sort_lines(p.withColumn("line", F.concat("p_name", "key")), "line", descending=True).limit(25).withColumn("way", F.lit("down"))
    return up.unionByName(down).select("way", "p_partkey")


@query("""WITH p AS (SELECT o_custkey AS k, floor(o_totalprice)::BIGINT % 5 AS s, o_orderstatus = 'P' AS b, o_orderkey AS t, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 3 = 0 THEN false END AS x FROM orders),
 r AS (SELECT *, coalesce(bool_or(x) OVER (PARTITION BY k), false) AS any_x FROM p), z AS (SELECT k, b, t, CASE WHEN any_x THEN CASE WHEN x THEN 1000 ELSE 0 END ELSE s END AS score FROM r)
 SELECT k, t, score::BIGINT AS score, row_number() OVER (PARTITION BY k ORDER BY score DESC, b, t DESC)::INT AS rank FROM z WHERE score > 0""")
def ranked_providers(spark, d):
    k = F.col("o_orderkey")
    p = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.floor("o_totalprice") % 5).alias("score"), (F.col("o_orderstatus") == "P").alias("builtin"), k.alias("time"), F.when((F.col("o_custkey") % 4 == 0) & (k % 7 == 0), True).when(k % 3 == 0, False).alias("exclusive"))
    return ranking.rank_providers(p, ["k"]).select("k", F.col("time").alias("t"), F.col("score").cast("long").alias("score"), "rank")


@query("(SELECT 'trimmed' AS which, event_id FROM events ORDER BY event_id DESC LIMIT 50) UNION ALL SELECT 'kept', n_nationkey::BIGINT FROM nation")
def trimmed_cache(spark, d):
    """A cache over its limit is cut to the newer half of it; one below it stays."""
    over = ranking.trim_lru(load(spark, d, "events").select("event_id"), "event_id", 100)
    under = ranking.trim_lru(load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("event_id")), "event_id", 100)
    return over.withColumn("which", F.lit("trimmed")).unionByName(under.withColumn("which", F.lit("kept"))).select("which", "event_id")


@query("SELECT x, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = x AND o_orderkey % 3 = 0) THEN (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey < x AND o_orderkey % 3 = 0) ELSE -(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey < x AND o_orderkey % 3 = 0) - 1 END::BIGINT AS position FROM (VALUES (-1), (7), (50), (51), (1000000)) AS t(x)")
def sorted_map_positions(spark, d):
    """Where keys stand in a sorted map, or would."""
    keys = load(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("v")).distinct()
    out = None
    for x in (-1, 7, 50, 51, 1_000_000):
        got = ranking.search_position(keys, "v", x).select(F.lit(x).alias("x"), F.col("position").cast("long").alias("position"))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 1 ELSE 2 END AS kind, CASE WHEN event_type IN ('click', 'view', 'signup', 'purchase') THEN event_id // 7 END AS m, CASE WHEN event_type NOT IN ('signup', 'purchase') THEN event_id // 5 END AS o FROM events) ORDER BY coalesce(m, o), kind, o NULLS FIRST, event_id LIMIT 45")
def ordered_changes(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "error", "delete").when(t == "click", "modified").when(t == "view", "unchanged").otherwise("insert")
    c = load(spark, d, "events").select("event_id", kind.alias("type"), F.when(t != "error", F.floor(F.col("event_id") / 7)).alias("modified_index"), F.struct(F.when(~t.isin("signup", "purchase"), F.floor(F.col("event_id") / 5)).alias("o"), "event_id").alias("at"))
    c = c.withColumn("original_index", F.col("at.o"))
    return ranking.order_changes(c, ["event_id"]).limit(45).select("event_id")


@query("""WITH s AS (SELECT doc_id % 20 AS q, doc_id AS rank, CASE WHEN doc_id % 3 = 0 THEN 'git' ELSE 'code' END AS kind, path, length(text) AS n FROM """ + PATHS + """ WHERE NOT (doc_id % 3 <> 0 AND path LIKE 'src/a/%')),
 u AS (SELECT *, sum(n) OVER (PARTITION BY q, kind ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT q AS query_id, rank, kind, used::BIGINT AS used FROM u WHERE used <= CASE kind WHEN 'git' THEN 4000 ELSE 20000 END""")
def merged_context(spark, d):
    i = F.col("doc_id")
    p = paths(spark, d)
    s = p.select((i % 20).alias("query_id"), i.alias("rank"), F.when(i % 3 == 0, "git").otherwise("code").alias("kind"), F.when(i % 3 != 0, F.col("path")).alias("path"), "text")
    gone = sorted({f"src/a/f{n}{e}" for n in range(40) for e in (".ts", ".py", ".MD", ".exe", "", ".java", ".h")})
    return text_search.merge_context(s, 20_000, 4_000, gone).select("query_id", "rank", "kind", "used")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 25)::BIGINT AS page, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 25)::INT AS item FROM orders")
def whole_table_pages(spark, d):
    """Pages of a whole table: places are counted range by range, not in one task."""
    return ranking.page(load(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 25).select("o_orderkey", "page", F.col("item").cast("int"))


@query("""WITH l AS (SELECT o_custkey, o_orderpriority AS k, max(o_orderkey) AS v FROM orders GROUP BY ALL)
 SELECT o_custkey, string_agg(k || '=' || v::VARCHAR, ';' ORDER BY k) AS up, string_agg(k || '=' || v::VARCHAR, ';' ORDER BY v DESC) AS down, max_by(v, k) FILTER (k <= '3') AS floor FROM l GROUP BY o_custkey""")
def sorted_maps(spark, d):
    """Each customer's last order of each priority, as a sorted map, by a comparator, and its entry at or below 3."""
    o = load(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("v"))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["k"], F.lit("="), e["v"].cast("string"))), ";")
    up, down = ranking.sorted_map(o, ["o_custkey"], "k", "v", "v"), ranking.sorted_map(o, ["o_custkey"], "k", "v", "v", lambda a, b: (b["v"] - a["v"]).cast("int"))
    up = up.select("o_custkey", shown("entries").alias("up"), ranking.floor_entry(F.col("entries"), "k", F.lit("3"))["v"].alias("floor"))
    return up.join(down.select("o_custkey", shown("entries").alias("down")), "o_custkey")


def _runs(spark, d):
    at = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    lines = load(spark, d, "lineitem").select(at.cast("long").alias("k"), F.col("l_orderkey").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    runs = SortedRuns(spark, scratch(spark, "runs"))
    runs.create(lines, "k", "v", "at", run_rows=10_000)
    return runs


@query("""WITH m AS (SELECT l_partkey * 1000000 + l_suppkey AS k, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM m), q AS (SELECT o_orderkey, o_custkey * 1000000 + o_orderkey % 1000 AS x FROM orders)
 SELECT o_orderkey, x, k AS floor, v AS value, CASE WHEN k = x THEN place ELSE -(coalesce(place + 1, 0)) - 1 END AS position FROM q ASOF LEFT JOIN p ON q.x >= p.k""")
def sorted_run_lookups(spark, d):
    """One sorted map of all parts and suppliers that were ordered together, in runs; the entry at or below a key of every order."""
    runs = _runs(spark, d)
    asked = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 1_000_000 + F.col("o_orderkey") % 1000).cast("long").alias("x"))
    return runs.find(asked, "x")


@query("""WITH m AS (SELECT l_partkey * 1000000 + l_suppkey AS k, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS v FROM lineitem GROUP BY ALL)
 SELECT k AS "key", v AS value, row_number() OVER (ORDER BY k) - 1 AS place FROM m""")
def sorted_run_entries(spark, d):
    """All entries of that map with their places."""
    runs = _runs(spark, d)
    return runs.entries()


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS node, l_partkey % 97 + 1 AS caller, sum(l_quantity) AS time FROM lineitem GROUP BY ALL),
 b AS MATERIALIZED (SELECT node, caller FROM e QUALIFY row_number() OVER (PARTITION BY node ORDER BY time DESC, caller DESC) = 1),
 w AS (SELECT s_suppkey AS node, [s_suppkey] AS path, 0 AS i FROM supplier UNION ALL
  SELECT w.node, CASE WHEN b.caller IS NULL OR list_contains(path, b.caller) THEN path ELSE list_append(path, b.caller) END, i + 1 FROM w LEFT JOIN b ON b.node = path[-1] WHERE i < 5)
 SELECT node, array_to_string(list_transform(path, lambda x: x::VARCHAR), '>') AS path FROM w WHERE i = 5""")
def heaviest_paths(spark, d):
    """From each supplier the caller that took most, and so on for five steps."""
    edges = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 97 + 1).alias("caller")).agg(F.sum("l_quantity").alias("time"))
    paths = agg.heaviest_path(edges, load(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))
    return paths.select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))
