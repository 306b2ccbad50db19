"""Every registered query with its SQL (DuckDB's dialect)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar, text, vectors
from ..operators import aggregates as agg
from ..operators import diff, graph, graph_index, joins, ranking, text_search, windows
from ..session import load, scratch
from ..sources import files, stores
from ..streaming import changes
from . import order_catalog, rows_catalog, sources_catalog, streams_catalog, text_catalog  # noqa: F401 - they register their queries
from . import retrieval
from .registered import ORACLES, QUERIES, query  # noqa: F401


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


def _queries(spark, d):
    """Every twentieth vector, with the text of its document."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(docs, "query_id", "left")


_DOT = "round(list_sum(list_transform(range(1, 65), lambda i: q.q[i]::DOUBLE * e.embedding[i]::DOUBLE)), 9)"
_QUERY = "q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
_DENSE = f"""{_QUERY}, s AS (SELECT q.query_id, e.vec_id AS chunk_id, {_DOT} AS score FROM q, embeddings e),
 dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 48)"""


def _dense(spark, d, k=48):
    return ranking.dense_top_k(_queries(spark, d), _vectors(spark, d), k)


# Retrieval -------------------------------------------------------------------------------------------


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM dense WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", "score", "rank")


_RANKED = """w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_$.]+'), lambda t: length(t) > 1)) AS dt,
   list_distinct(list_filter(regexp_extract_all(lower(query_text), '[a-zA-Z0-9_$.]+'), lambda t: length(t) > 1)) AS qt,
   count(*) OVER p AS n, min(score) OVER p AS lo, max(score) OVER p AS hi FROM h WINDOW p AS (PARTITION BY query_id)),
 k AS (SELECT *, CASE WHEN n <= 12 THEN score ELSE 0.7 * CASE WHEN hi <= lo THEN score ELSE (score - lo) / (hi - lo) END
   + 0.3 * CASE WHEN len(qt) = 0 OR len(dt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END END AS s2 FROM w),
 rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 12 THEN -s2 END NULLS FIRST, rank) AS r2 FROM k)"""
_HITS = f"""{_DENSE}, h AS (SELECT x.query_id, x.chunk_id, x.score, x.rank, doc.text, doc.source, qd.text AS query_text
  FROM dense x JOIN documents doc ON doc.doc_id = x.chunk_id JOIN documents qd ON qd.doc_id = x.query_id),
 {_RANKED}"""


def _hits(spark, d):
    docs = load(spark, d, "documents")
    hits = _dense(spark, d).join(docs.select(F.col("doc_id").alias("chunk_id"), "text", "source"), "chunk_id")
    return hits.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")


@query(f"WITH {_HITS} SELECT query_id, chunk_id, round(s2, 6) AS score, r2::INT AS rank FROM rr WHERE r2 <= 12")
def hybrid_rerank(spark, d):
    return ranking.rerank(_hits(spark, d), 12).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(source) ORDER BY r2) AS rn, count(*) OVER (PARTITION BY query_id) AS m FROM rr WHERE r2 <= 12),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN m > 8 AND rn > 2 THEN 1 ELSE 0 END, r2) AS pick FROM t)
 SELECT query_id, chunk_id, source, pick::INT AS pick FROM o WHERE pick <= 8""")
def diversity_cap(spark, d):
    ranked = ranking.rerank(_hits(spark, d), 12)
    return windows.cap_per_group(ranked, "query_id", "source", "rank", 2, 8).select("query_id", "chunk_id", "source", "pick")


_TOK = "list_transform(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]{{1,64}}|[0-9a-f]{{7,40}}|[A-Z][A-Z0-9_]{{2,}}'), lambda t: lower(t))"
_FNV = "(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 1048576)::INT"


def _sparse(table, id_col, where="true"):
    return f"(WITH t AS (SELECT {id_col} AS id, unnest({_TOK.format('text')}) AS tok FROM {table} WHERE {where}), c AS (SELECT id, tok, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT id, {_FNV.format('tok')} AS idx, sum(n) AS tf FROM c GROUP BY ALL) SELECT id, idx, tf::BIGINT AS tf, (max(tf) OVER (PARTITION BY id))::BIGINT AS top, tf::DOUBLE / max(tf) OVER (PARTITION BY id) AS weight FROM b)"


@query(f"SELECT id AS doc_id, idx, round(weight, 9) AS weight FROM {_sparse('documents', 'doc_id')}")
def sparse_encode(spark, d):
    return text.sparse_encode(load(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query(f"""WITH c AS {_sparse('documents', 'doc_id')}, q AS {_sparse('benchmark', 'item_id')},
 s AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.tf * c.tf)::DOUBLE / (any_value(q.top) * any_value(c.top)), 6) AS score FROM q JOIN c USING (idx) GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def sparse_topk(spark, d):
    """Every benchmark item is a query; ten rows for each are the report."""
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return ranking.sparse_top_k(load(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"), chunks, 10)


_FUSED = f"""v AS (SELECT * FROM embeddings SEMI JOIN documents ON doc_id = vec_id), {_DENSE.replace("embeddings", "v")}, c AS {_sparse('(SELECT * FROM documents SEMI JOIN embeddings ON doc_id = vec_id)', 'doc_id')}, qq AS (SELECT * FROM {_sparse('documents', 'doc_id')} WHERE id IN (SELECT query_id FROM q)),
 ss AS (SELECT qq.id AS query_id, c.id AS chunk_id, round(sum(qq.tf * c.tf)::DOUBLE / (any_value(qq.top) * any_value(c.top)), 6) AS score FROM qq JOIN c USING (idx) GROUP BY ALL),
 sp AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss QUALIFY rank <= 48),
 u AS (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT * FROM sp),
 fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY ALL)"""


def _asked(spark, d):
    """The queries that have a text."""
    return _queries(spark, d).where("text is not null")


def _chunks(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("file"))
    return _vectors(spark, d).join(docs, "chunk_id")


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, round(score, 9) AS score FROM fused")
def rrf_fuse(spark, d):
    return retrieval.fused(_asked(spark, d), _chunks(spark, d), 48).withColumn("score", F.round("score", 9))


@query(f"""WITH {_FUSED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 48),
 h AS (SELECT x.query_id, x.chunk_id, x.score, x.rank, doc.text, doc.source, qd.text AS query_text FROM best x JOIN documents doc ON doc.doc_id = x.chunk_id JOIN documents qd ON qd.doc_id = x.query_id),
 {{_RANKED}},
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(source) ORDER BY r2) AS rn, count(*) OVER (PARTITION BY query_id) AS m FROM rr WHERE r2 <= 24),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN m > 12 AND rn > 2 THEN 1 ELSE 0 END, r2) AS pick FROM t)
 SELECT query_id, chunk_id, source AS file, round(s2, 6) AS score, pick::INT AS pick FROM o WHERE pick <= 12""".replace("{_RANKED}", _RANKED.replace("<= 12", "<= 24").replace("> 12", "> 24")))
def hybrid_retrieval(spark, d):
    return retrieval.hybrid(_asked(spark, d), _chunks(spark, d)).withColumn("score", F.round("score", 6))


@query()
def ann_topk(spark, d):
    return ranking.ann_top_k(_queries(spark, d), _vectors(spark, d), 10)


@query("SELECT count(*) AS queries, true AS recall_is_90 FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, d):
    """Recall at ten of the approximate search, as it is shipped, against the exact one: 0.9 at least."""
    exact, near = _dense(spark, d, 10), ranking.ann_top_k(_queries(spark, d), _vectors(spark, d), 10)
    hit = exact.join(near.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_is_90"))


_LIVE = f"v AS (SELECT CASE WHEN vec_id % 10 = 3 THEN vec_id + 1000000 ELSE vec_id END AS chunk_id, embedding FROM embeddings WHERE vec_id % 10 <> 7)"


@query(f"""WITH {_QUERY}, {_LIVE}, s AS (SELECT q.query_id, e.chunk_id, {_DOT} AS score FROM q, v e QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, e.chunk_id) <= 10)
 SELECT count(DISTINCT query_id) AS queries, true AS recall_is_90, 0::BIGINT AS removed_found, (SELECT count(*) FROM v) AS nodes FROM s""")
def graph_index_updates(spark, d):
    """A saved graph index after two batches: a tenth of the vectors removed, another tenth moved to other ids; recall against
    an exact search over what is left."""
    v = _vectors(spark, d).select("chunk_id", "v")
    index = graph_index.GraphIndex(spark, scratch(spark, "graphs"))
    index.create(v)
    moved = v.where("chunk_id % 10 = 3")
    index.update(moved.withColumn("chunk_id", F.col("chunk_id") + 1_000_000), moved.select("chunk_id"), "changes", 1)
    index.update(None, v.where("chunk_id % 10 = 7").select("chunk_id"), "changes", 2)
    index.update(None, v.select("chunk_id"), "changes", 2)  # sent again: does nothing
    left = v.where("chunk_id % 10 <> 7").withColumn("chunk_id", F.when(F.col("chunk_id") % 10 == 3, F.col("chunk_id") + 1_000_000).otherwise(F.col("chunk_id")))
    near = index.search(_queries(spark, d), 10).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    exact = ranking.dense_top_k(_queries(spark, d), left, 10).join(near.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    removed = near.join(v.where("chunk_id % 10 in (3, 7)"), "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("removed_found"))
    recall = exact.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_is_90"))
    return recall.crossJoin(removed).crossJoin(index.nodes().agg(F.count(F.lit(1)).alias("nodes")))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 6).alias("norm"))


# Text ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, ceil(len(regexp_extract_all(text, '[一-鿿]')) / 1.2::DOUBLE + (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) - len(regexp_extract_all(text, '[一-鿿]'))) / 3.0::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::INT AS count, length(string_split(text, chr(10))[1])::INT AS first, length(string_split(text, chr(10))[-1])::INT AS last FROM documents")
def eol_counter(spark, d):
    s = load(spark, d, "documents").select("doc_id", text.eol_stats(F.col("text")).alias("s"))
    return s.select("doc_id", "s.count", "s.first", "s.last")


@query("SELECT doc_id, regexp_matches(text, '(?i)copyright|license|©') AS notice, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)copyright|licen[sc]e')))::INT AS lines FROM documents")
def license_lines(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", t.rlike("(?i)copyright|license|©").alias("notice"), F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike("(?i)copyright|licen[sc]e"))).alias("lines"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def remove_accents(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.remove_accents("text")).alias("digest"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM documents) SELECT doc_id, line_no, len(regexp_extract_all(line, '[Tt]hing'))::INT AS n FROM l WHERE regexp_matches(line, '[Tt]hing')")
def search_lines(spark, d):
    return text_search.search_lines(load(spark, d, "documents"), "doc_id", "[Tt]hing").drop("line")


@query("SELECT doc_id, len(regexp_extract_all(text, '[Tt]hing'))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[Tt]hing')")
def search_ranges(spark, d):
    """The matches with places, and those beyond the quota, are all of them."""
    hits = text_search.search(load(spark, d, "documents"), "doc_id", "[Tt]hing")
    return hits.groupBy("doc_id").agg((agg.match_count(F.col("matches")) + F.sum(F.col("total") - F.size("matches"))).alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'trash') AND (contains(lower(text), 'thing') OR contains(lower(text), 'a,b'))")
def boolean_filter(spark, d):
    return load(spark, d, "documents").where(text.boolean_filter(F.col("text"), r"thing, a\,b, !trash")).select("doc_id")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*\\.example\\.(com|net)(/.*)?$') THEN 1 ELSE 0 END AS kept FROM pages WHERE regexp_matches(url, '^https?://[^/]*/.*$') AND NOT regexp_matches(url, '^[^/]*//[^/]*/de/.*$')")
def glob_filter(spark, d):
    p = load(spark, d, "pages")
    ok = files.listing(p.withColumnRenamed("url", "path"), include=["http?://*/**", "http://*/**"], exclude=["*//*/de/**"])
    return ok.select("page_id", F.col("path").rlike(r"^https?://[^/]*\.example\.(com|net)(/.*)?$").cast("int").alias("kept"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(trim(text), '(?i)\\b(error|failed|crash|bug|exception|deadlock)\\b') THEN 'reasoning' WHEN regexp_matches(trim(text), '(?i)^(explain|translate|rename|briefly)') THEN 'fast' ELSE 'code' END AS intent FROM documents""")
def query_intent(spark, d):
    return load(spark, d, "documents").select("doc_id", text.intent(F.col("text")).alias("intent"))


@query("SELECT doc_id, CAST(('0x' || array_to_string(list_reverse(regexp_extract_all(substr(sha256(doc_id::VARCHAR), 1, 16), '..')), '')) AS UBIGINT)::DECIMAL(20,0) AS key FROM documents")
def stable_key(spark, d):
    return load(spark, d, "documents").select("doc_id", scalar.stable_key(F.col("doc_id").cast("string")).alias("key"))


@query("SELECT doc_id, least(greatest(n_chars, 100), 1000) AS clamped, (doc_id % 7)::BIGINT AS rot, CASE WHEN n_chars >= 1000 THEN 'high' WHEN n_chars >= 300 THEN 'medium' WHEN n_chars >= 0 THEN 'low' END AS bucket, CASE WHEN n_chars <= 8192 THEN 2 WHEN n_chars <= 16384 THEN 4 WHEN n_chars <= 32768 THEN 6 WHEN n_chars <= 65536 THEN 8 ELSE 12 END AS reads, least(n_chars, 255)::BIGINT AS byte FROM documents")
def scalar_pack(spark, d):
    n = F.col("n_chars")
    return load(spark, d, "documents").select("doc_id", scalar.clamp(n, 100, 1000).alias("clamped"), scalar.rotate(F.col("doc_id"), 7).alias("rot"), scalar.bucket(n, {"low": 0, "medium": 300, "high": 1000}).alias("bucket"), scalar.active_reads(n).alias("reads"), scalar.saturate(n, 8).alias("byte"))


@query("SELECT item_id, unnest(CASE WHEN length(text) < 30 OR len(string_split(text, '. ')) < 2 THEN [text] ELSE string_split(text, '. ') END) AS part FROM benchmark")
def sub_questions(spark, d):
    b = load(spark, d, "benchmark").withColumn("q", F.replace("text", F.lit(". "), F.lit(";")))
    whole = F.when(F.size(F.split("q", ";")) < 2, F.array("text")).otherwise(F.split("q", ";"))
    return b.select("item_id", F.explode(F.when(F.length("text") < 30, F.array("text")).otherwise(whole)).alias("part"))


@query("""WITH n AS (SELECT c.doc_id, c.ch, c.n AS x, coalesce(m.n, 0) AS y FROM (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL) c
 LEFT JOIN (SELECT doc_id - 1 AS doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE doc_id % 50 = 1) GROUP BY ALL) m USING (doc_id, ch)),
 o AS (SELECT m.doc_id, 0 AS x, m.n AS y FROM (SELECT doc_id - 1 AS doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE doc_id % 50 = 1) GROUP BY ALL) m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = m.doc_id AND n.ch = m.ch)),
 u AS (SELECT doc_id, x, y FROM n UNION ALL SELECT doc_id, x, y FROM o)
 SELECT doc_id, round(1 - sum(abs(x - y)) / sum(x + y), 6) AS similarity FROM u GROUP BY doc_id""".replace("WHERE doc_id % 50 = 0", "").replace("WHERE doc_id % 50 = 1", ""))
def histogram_similarity(spark, d):
    """Each document with the next by id."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return agg.histogram_similarity(docs, docs.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id").withColumn("similarity", F.round("similarity", 6))


# Sets and joins --------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_diff(spark, d):
    return joins.diff(load(spark, d, "documents"), load(spark, d, "labels"), ["doc_id"]).where("side = 'removed'").select("doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_semi(spark, d):
    return joins.semi(load(spark, d, "documents").select("doc_id"), load(spark, d, "labels"), ["doc_id"]).distinct()


@query("SELECT c_custkey AS key FROM customer UNION ALL (SELECT c_custkey FROM customer INTERSECT ALL SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)")
def set_operations(spark, d):
    c, o = load(spark, d, "customer").select(F.col("c_custkey").alias("key")), load(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return agg.union_all(c, c.intersectAll(o), o.exceptAll(c))


_SIDES = """b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0),
 l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'local' WHEN c_custkey % 77 = 1 THEN 'both' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0),
 r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'remote' WHEN c_custkey % 77 = 1 THEN 'both' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 13 <> 0),
 j AS (SELECT coalesce(b.k, l.k, r.k) AS k, b.v AS bv, l.v AS lv, r.v AS rv, b.k IS NOT NULL AS hb, l.k IS NOT NULL AS hl, r.k IS NOT NULL AS hr FROM b FULL JOIN l ON b.k = l.k FULL JOIN r ON coalesce(b.k, l.k) = r.k),
 c AS (SELECT *, CASE WHEN hb AND NOT hl THEN 'removed' WHEN NOT hb AND hl THEN 'added' WHEN hb AND hl AND bv <> lv THEN 'updated' ELSE 'same' END AS lc,
  CASE WHEN hb AND NOT hr THEN 'removed' WHEN NOT hb AND hr THEN 'added' WHEN hb AND hr AND bv <> rv THEN 'updated' ELSE 'same' END AS rc FROM j)"""


def _sides(spark, d):
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    side = lambda keep, v: c.where(keep).select(k.alias("k"), v.alias("v"))
    both = F.when(k % 77 == 1, "both").otherwise(F.col("c_mktsegment"))
    return side(k % 5 != 0, F.col("c_mktsegment")), side(k % 11 != 0, F.when(k % 7 == 0, "local").otherwise(both)), side(k % 13 != 0, F.when(k % 3 == 0, "remote").otherwise(both))


@query(f"""WITH {_SIDES}, x AS (SELECT *, (lc = 'updated' AND rc = 'removed') OR (lc = rc AND lc IN ('updated', 'added') AND lv IS DISTINCT FROM rv) AS conflict FROM c),
 y AS (SELECT k, conflict, CASE WHEN conflict THEN NULL WHEN lc = 'removed' AND rc = 'updated' THEN 'added' WHEN lc = 'same' AND rc = 'removed' THEN 'removed' WHEN lc = 'same' AND rc = 'updated' THEN 'updated' WHEN rc = 'added' AND NOT hl THEN 'added' END AS local_action,
  CASE WHEN conflict THEN NULL WHEN lc = 'removed' AND rc = 'same' THEN 'removed' WHEN lc = 'updated' AND rc = 'same' THEN 'updated' WHEN lc = 'added' AND NOT hr THEN 'added' END AS remote_action FROM x)
 SELECT * FROM y WHERE conflict OR local_action IS NOT NULL OR remote_action IS NOT NULL""")
def three_way_merge(spark, d):
    return joins.three_way_merge(*_sides(spark, d), "k", "v")


@query(f"""WITH {_SIDES}, y AS (SELECT k, false AS conflict, CASE WHEN rc = 'removed' AND hl THEN 'removed' WHEN rc = 'added' AND lc = 'added' THEN CASE WHEN lv <> rv THEN 'updated' END WHEN rc = 'added' THEN 'added' WHEN rc = 'updated' THEN 'updated' END AS local_action,
  CASE WHEN lc = 'added' AND rc <> 'added' THEN 'added' WHEN lc = 'updated' AND rc NOT IN ('removed', 'updated') THEN 'updated' WHEN lc = 'removed' AND hr THEN 'removed' END AS remote_action FROM c)
 SELECT * FROM y WHERE local_action IS NOT NULL OR remote_action IS NOT NULL""")
def three_way_merge_remote_wins(spark, d):
    return joins.three_way_merge(*_sides(spark, d), "k", "v", remote_wins=True)


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
 SELECT e.event_id, p.purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last(spark, d):
    e = load(spark, d, "events")
    return joins.asof(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", "purchase").select("event_id", "purchase")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
 SELECT e.event_id, p.purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts""")
def asof_first(spark, d):
    e = load(spark, d, "events")
    return joins.asof(e.where("event_type = 'error'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", "purchase", forward=True).select("event_id", "purchase")


_SPANS = "sp AS (SELECT l_suppkey AS g, l_orderkey * 3 + l_linenumber AS s, l_orderkey * 3 + l_linenumber + l_quantity::BIGINT * 20 AS e, l_orderkey * 10 + l_linenumber AS o FROM lineitem)"


def _spans(spark, d):
    li = load(spark, d, "lineitem")
    s = F.col("l_orderkey") * 3 + F.col("l_linenumber")
    return li.select(F.col("l_suppkey").alias("g"), s.alias("s"), (s + F.col("l_quantity").cast("long") * 20).alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))


@query(f"""WITH {_SPANS}, p AS (SELECT p_partkey AS id, p_partkey % (SELECT max(l_suppkey) FROM lineitem) + 1 AS g, p_partkey * 7 AS pos FROM part)
 SELECT id, s, o FROM p JOIN sp USING (g) WHERE s <= pos AND pos <= e QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o) = 1""")
def interval_innermost(spark, d):
    spans = _spans(spark, d)
    most = spans.agg(F.max("g").alias("m"))
    p = load(spark, d, "part").crossJoin(F.broadcast(most)).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % F.col("m") + 1).alias("g"), (F.col("p_partkey") * 7).alias("pos"))
    return joins.innermost(p, spans, "g", "pos", ["id"], "s", "e", "o").select("id", "s", "o")


@query(f"""WITH {_SPANS}, p AS (SELECT p_partkey AS id, p_partkey % (SELECT max(l_suppkey) FROM lineitem) + 1 AS g, p_partkey * 7 AS pos FROM part)
 SELECT id, min(o) AS o FROM p JOIN sp USING (g) WHERE s <= pos AND pos <= e GROUP BY id""")
def interval_first(spark, d):
    spans = _spans(spark, d)
    most = spans.agg(F.max("g").alias("m"))
    p = load(spark, d, "part").crossJoin(F.broadcast(most)).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % F.col("m") + 1).alias("g"), (F.col("p_partkey") * 7).alias("pos"))
    return joins.innermost(p, spans, "g", "pos", ["id"], "s", "e", "o", first=True).select("id", "o")


@query("""WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 60000 AS s, epoch_ms(ts) // 60000 + 1 + event_id % 90 AS t, event_type FROM events)
 SELECT a.event_id, b.event_id AS other, greatest(a.s, b.s) AS lo, least(a.t, b.t) AS hi FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND a.s < b.t AND b.s < a.t""")
def range_overlap(spark, d):
    s = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000)
    e = load(spark, d, "events").select("user_id", "event_id", s.alias("s"), (s + 1 + F.col("event_id") % 90).alias("t"), "event_type")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("other"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    return joins.overlaps(e.where("event_type = 'error'"), b, ("s", "t"), ("s2", "t2"), "user_id").select("event_id", "other", "lo", "hi")


@query("""WITH p AS (SELECT page_id, string_split(split_part(split_part(url, '?', 1), '#', 1), '/') AS parts FROM pages),
 a AS (SELECT page_id, array_to_string(parts[1:i], '/') AS prefix, i FROM p, range(1, 12) t(i) WHERE i <= len(parts)),
 f AS (SELECT prefix, count(*) AS n FROM a WHERE i >= 3 GROUP BY prefix HAVING count(*) > 3)
 SELECT page_id, max(prefix) AS prefix, max_by(n, length(prefix)) AS n FROM a JOIN f USING (prefix) GROUP BY page_id""")
def longest_prefix(spark, d):
    p = load(spark, d, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)).alias("path"))
    a = p.select(F.explode(joins.ancestors(F.col("path"))).alias("prefix")).where(F.size(F.split("prefix", "/")) >= 3)
    folders = a.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    return joins.longest_prefix(p, "path", folders, "prefix", ["page_id"])


@query("SELECT d.doc_id, md5(coalesce(b.text, d.text)) AS digest FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def lookup_parent(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("own"))
    return joins.lookup(docs, load(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), "doc_id", "text", "own").select("doc_id", F.md5("text").alias("digest"))


# Aggregates -------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def grouped_sum(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey")
def group_lists(spark, d):
    g = agg.group_lists(load(spark, d, "orders").withColumn("v", F.col("o_orderkey").cast("string")), "o_custkey", "v", "o_orderkey")
    return g.select("o_custkey", F.array_join("values", ",").alias("orders"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def distinct_by_key(spark, d):
    return agg.distinct_by_key(load(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return windows.keep_first(docs, ["h"], ["doc_id"]).select("doc_id")


@query("SELECT event_type, count(*) AS n, min_by(event_id, event_id) AS event_id FROM events GROUP BY event_type")
def error_count(spark, d):
    return agg.count_with_first(load(spark, d, "events"), "event_type", "event_id", "event_id")


@query("SELECT time_bucket(INTERVAL '5 seconds', ts) AS start, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def error_count_window(spark, d):
    w = agg.count_with_first(load(spark, d, "events").where("event_type = 'error'"), "event_type", "event_id", "ts", "5 seconds")
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT l_partkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) SELECT *, round(l_quantity / ((SELECT sum(l_quantity) FROM lineitem) / 100))::BIGINT AS share FROM s ORDER BY l_quantity DESC, l_partkey LIMIT 5")
def topn_share(spark, d):
    return agg.top_share(load(spark, d, "lineitem"), "l_partkey", "l_quantity", 5)


@query("SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topn_sum(spark, d):
    return agg.top_sums(load(spark, d, "lineitem"), "l_suppkey", "l_quantity", 10)


@query("""WITH l AS (SELECT r_name || '/' || n_name || '/' || c_custkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'failed' END AS state, o_totalprice AS duration FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 u AS (SELECT split_part(path, '/', 1) AS node, state, duration FROM l UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), state, duration FROM l UNION ALL SELECT path, state, duration FROM l)
 SELECT node, max_by(state, CASE state WHEN 'passed' THEN 2 WHEN 'queued' THEN 3 ELSE 4 END) AS state, round(sum(duration), 2) AS duration FROM u GROUP BY node""")
def priority_rollup(spark, d):
    o, c, n, r = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    leaves = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    state = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    leaves = leaves.select(F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")).alias("path"), state.alias("state"), F.col("o_totalprice").alias("duration"))
    # Leaves of one path meet first, so that ancestors get few rows.
    prio = F.element_at(F.create_map(*(F.lit(x) for kv in agg.STATE_PRIORITY.items() for x in kv)), F.col("state"))
    few = leaves.groupBy("path").agg(F.max_by("state", prio).alias("state"), F.sum("duration").alias("duration"))
    return agg.rollup_states(few).withColumn("duration", F.round("duration", 2))


@query("SELECT source, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (lang = 'en')::DOUBLE / count(*), 6) END AS coverage FROM documents GROUP BY source")
def coverage_ratio(spark, d):
    g = load(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("c"), F.count(F.lit(1)).alias("t"))
    return g.select("source", F.round(scalar.coverage(F.col("c"), F.col("t")), 6).alias("coverage"))


@query("SELECT user_id, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 WHEN event_type = 'click' THEN event_id % 4 ELSE 0 END)::BIGINT AS n FROM events GROUP BY user_id")
def conditional_count(spark, d):
    kind = F.when(F.col("event_type").isin("signup", "error"), "insert").when(F.col("event_type") == "click", "modified").otherwise("same")
    return load(spark, d, "events").groupBy("user_id").agg(agg.change_count(kind, F.col("event_id") % 4).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_count(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


@query("SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_distinct(spark, d):
    return load(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT user_id, bit_or((1::BIGINT << (event_id % 60)::INT)) AS bits FROM events GROUP BY user_id")
def small_bit_set(spark, d):
    return agg.bit_set(load(spark, d, "events").withColumn("b", F.col("event_id") % 60), ["user_id"], "b")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY pos), ',') AS kinds FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY user_id")
def append_if_absent(spark, d):
    g = agg.append_if_absent(load(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return g.select("user_id", F.array_join("items", ",").alias("kinds"))


@query("SELECT l_partkey, max(l_extendedprice) AS worst, min(l_extendedprice) AS base FROM lineitem GROUP BY l_partkey HAVING max(l_extendedprice) > 10 * min(l_extendedprice)")
def above_baseline(spark, d):
    """Parts whose dearest line is over ten times their cheapest."""
    base = F.min("l_extendedprice").over(Window.partitionBy("l_partkey"))
    return agg.above_baseline(load(spark, d, "lineitem").withColumn("base", base), ["l_partkey"], "l_extendedprice", "base")


# Windows ----------------------------------------------------------------------------------------------


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS mean, round(least(greatest(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 10), 50), 6) AS delay FROM events")
def sliding_avg6(spark, d):
    return load(spark, d, "events").select("event_id", F.round(windows.sliding_mean("value", 6, ["user_id"], ["ts", "event_id"]), 6).alias("mean"), F.round(windows.debounce_delay("value", ["user_id"], ["ts", "event_id"], 10.0, 50.0), 6).alias("delay"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 10) AS mean FROM events")
def cumulative_avg(spark, d):
    return load(spark, d, "events").select("event_id", F.round(windows.cumulative_mean("value", ["user_id"], ["ts", "event_id"]), 10).alias("mean"))


@query("""WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events),
 i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, round(sum(value), 6) AS value, count(*) AS n FROM i GROUP BY user_id, island""")
def run_length(spark, d):
    return windows.run_lengths(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "value").withColumn("value", F.round("value", 6))


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn > coalesce(last, -1)) AS streak FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def streak_since_boundary(spark, d):
    return windows.streak(load(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user")


@query("""SELECT conv_id, turn, role = 'assistant' AND length(text) >= 300 AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' AND length(text) >= 300 ORDER BY turn DESC) > 2 AS folded FROM conversations""")
def keep_latest_n(spark, d):
    c = load(spark, d, "conversations")
    return windows.fold_old_large(c, "conv_id", "turn", F.length("text"), F.col("role") == "assistant", least=300).select("conv_id", "turn", "folded")


@query("""WITH r AS (SELECT user_id, epoch_ms(ts) // 60000 AS s, epoch_ms(ts) // 60000 + 1 + event_id % 600 AS e FROM events),
 m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 i AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, island""")
def merge_ranges(spark, d):
    s = F.expr("unix_millis(cast(ts AS timestamp)) div 60000")  # towards zero before 1970 too
    r = load(spark, d, "events").select("user_id", s.alias("s"), (s + 1 + F.col("event_id") % 600).alias("e"))
    return windows.merge_ranges(r, ["user_id"], "s", "e").select("user_id", "s", "e")


@query("WITH x AS (SELECT DISTINCT o_custkey, dayofyear(o_orderdate)::BIGINT AS i FROM orders), y AS (SELECT *, i - row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS g FROM x) SELECT o_custkey, min(i) AS start, max(i) + 1 AS \"end\" FROM y GROUP BY o_custkey, g")
def indexes_to_ranges(spark, d):
    return windows.indexes_to_ranges(load(spark, d, "orders").withColumn("i", F.dayofyear("o_orderdate").cast("long")), ["o_custkey"], "i")


@query("SELECT vec_id, label, round(CASE WHEN max(x) OVER p <= min(x) OVER p THEN x ELSE (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) END, 6) AS norm FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) WINDOW p AS (PARTITION BY label)")
def minmax_norm(spark, d):
    v = load(spark, d, "embeddings").withColumn("x", F.element_at("embedding", 1).cast("double"))
    return v.select("vec_id", "label", F.round(windows.min_max("x", ["label"]), 6).alias("norm"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS bucket FROM orders) SELECT o_custkey, bucket::INT AS bucket, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey), ',') AS items FROM s GROUP BY ALL""")
def equal_score_buckets(spark, d):
    b = windows.equal_score_buckets(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return b.select("o_custkey", "bucket", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::INT AS q, lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS prev, first_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS first FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)""")
def ranking_functions(spark, d):
    p = Window.partitionBy("o_orderstatus")
    w, k = p.orderBy("o_orderpriority"), p.orderBy("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(k).alias("q"), F.lag("o_orderkey").over(k).alias("prev"), F.first("o_orderkey").over(k).alias("first"))


@query("SELECT user_id, coalesce(bool_and(p IS NULL OR p <= value), true) AS ok FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def all_adjacent(spark, d):
    return windows.all_adjacent(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], lambda a, b: a("value") <= b("value"))


@query("""WITH n AS (SELECT *, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 99 PRECEDING), 10) AS average, round(CASE WHEN rn > 3 THEN avg(CASE WHEN rn <= 3 THEN value END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END, 10) AS initial FROM n""")
def latency_summary(spark, d):
    return windows.latency(load(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", F.round("average", 10).alias("average"), F.round("initial", 10).alias("initial"))


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, no FROM l WHERE contains(line, 'thing'))
 SELECT DISTINCT l.doc_id, l.no FROM l JOIN m ON l.doc_id = m.doc_id AND abs(l.no - m.no) <= 1 WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.doc_id = l.doc_id AND x.no = l.no)""")
def context_lines(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("no"), "line")
    return windows.context_lines(lines, lines.where(F.col("line").contains("thing")).select("doc_id", F.col("no").alias("line")), ["doc_id"], 1, 1).select("doc_id", "no")


# Sorting and paging ------------------------------------------------------------------------------------


@query("SELECT page_id, ((row_number() OVER (PARTITION BY h ORDER BY url, page_id) - 1) // 20)::BIGINT AS page, ((row_number() OVER (PARTITION BY h ORDER BY url, page_id) - 1) % 20)::INT AS item FROM (SELECT page_id, url, split_part(url, '/', 3) AS h FROM pages)")
def pages_paging(spark, d):
    p = load(spark, d, "pages").withColumn("h", F.split_part("url", F.lit("/"), F.lit(3)))
    return ranking.page(p, ["url", "page_id"], 20, ["h"]).select("page_id", "page", "item")


@query("SELECT event_id FROM events WHERE (ts, event_id) < ((SELECT max(ts) FROM events WHERE event_id = 100), 100) ORDER BY ts DESC, event_id DESC LIMIT 50")
def timeline_page(spark, d):
    e = load(spark, d, "events")
    at = e.where("event_id = 100").agg(F.max("ts")).first()[0]
    return ranking.after_cursor(e, F.col("ts"), F.col("event_id"), (at, 100), 50).select("event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC, event_type)::INT AS rank FROM events GROUP BY user_id, event_type QUALIFY rank <= 3")
def recent_items(spark, d):
    return ranking.recent(load(spark, d, "events"), ["user_id"], "event_type", "event_id", 3)


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE o_orderdate < TIMESTAMP '1997-01-01' AND rn > 10")
def retention_age(spark, d):
    o = load(spark, d, "orders").withColumn("k", F.struct("o_orderdate", (-F.col("o_orderkey")).alias("n")))
    return ranking.expired(o, ["o_custkey"], "k", F.struct(F.expr("timestamp_ntz'1997-01-01'").alias("o_orderdate"), F.lit(None).cast("long").alias("n")), 10).select("o_orderkey")


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 9")
def retention_last_n(spark, d):
    return ranking.beyond_last(load(spark, d, "orders"), ["o_custkey"], "o_orderkey", 9).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k_rows(spark, d):
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


# Graph ------------------------------------------------------------------------------------------------


def _parts(spark, d):
    """Parts and the orders they were bought in; parts of one order are two steps apart. Parts are even, orders odd."""
    return load(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_orderkey") * 2 + 1).alias("dst"))


def _hops(spark, d, hops):
    near = graph.neighbours(_parts(spark, d), spark.createDataFrame([(2,), (4,)], "node long"), 2 * hops)
    return near.where("hop % 2 = 0").select((F.col("node") / 2).cast("long").alias("node"), (F.col("hop") / 2).cast("int").alias("hop"))


_PARTS = "li AS (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM li a JOIN li b USING (l_orderkey) WHERE a.p < b.p), b2 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH {_PARTS} SELECT DISTINCT dst AS node, 1 AS hop FROM b2 WHERE src IN (1, 2) AND dst NOT IN (1, 2)")
def hop1(spark, d):
    return _hops(spark, d, 1)


@query(f"WITH {_PARTS}, h1 AS (SELECT DISTINCT dst AS node FROM b2 WHERE src IN (1, 2) AND dst NOT IN (1, 2)), h2 AS (SELECT DISTINCT dst AS node FROM b2 WHERE src IN (SELECT node FROM h1) AND dst NOT IN (1, 2) AND dst NOT IN (SELECT node FROM h1)) SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2")
def hop2(spark, d):
    return _hops(spark, d, 2)


@query("SELECT DISTINCT c_custkey AS src, l_partkey AS dst, c_name AS src_name, p_name AS dst_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name = (SELECT min(p_name) FROM part)")
def relation_lookup(spark, d):
    c, p = load(spark, d, "customer"), load(spark, d, "part")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("c").alias("file")).unionByName(p.select(F.concat(F.lit("p"), "p_partkey"), "p_name", F.lit("p")).toDF("id", "name", "file"))
    o = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("calls").alias("kind")).distinct()
    name = p.agg(F.min("p_name")).first()[0]
    r = graph.relations(nodes, edges, entity=name, kind="calls")
    num = lambda n: F.substring(n, 2, 20).cast("long").alias(n)
    return r.select(num("src"), num("dst"), "src_name", "dst_name")


# Changes ----------------------------------------------------------------------------------------------


@query("SELECT user_id AS path, CASE WHEN bool_or(event_type = 'error') THEN 'deleted' ELSE 'updated' END AS type FROM events GROUP BY user_id")
def change_coalesce(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("updated").alias("type"))
    return changes.coalesce(e)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS c FROM events),
 s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, n""")
def debounce_session(spark, d):
    e = load(spark, d, "events")
    return changes.debounce(e, "ts", "2 hours", F.count(F.lit(1)).alias("events"), keys=("user_id",))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def heartbeat(spark, d):
    return changes.heartbeat(load(spark, d, "events"), "ts")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)")
def ring_buffer(spark, d):
    return changes.ring(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("SELECT doc_id, source AS file, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 10 <> 0) AND NOT source = 'src2'")
def incremental_index(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("file"))
    new = docs.where("doc_id % 10 = 0").withColumn("state", F.lit("new"))
    old = docs.withColumn("state", F.when(F.col("doc_id") % 10 == 0, "new").otherwise("old"))
    ch = spark.createDataFrame([("src1", "updated"), ("src2", "updated"), ("src2", "deleted"), ("src2", "updated")], "file string, type string")
    return changes.apply_changes(old, ch, new)


@query("SELECT event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events QUALIFY delta <> 0")
def value_deltas(spark, d):
    return changes.deltas(load(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "delta")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'code_chunk' END AS t FROM events")
def doc_type_default(spark, d):
    kind = F.when(F.col("event_type") == "click", "git_commit").when(F.col("event_type") == "view", "doc_chunk").otherwise(F.col("event_type"))
    back = F.element_at(F.create_map(F.lit("git_commit"), F.lit("click"), F.lit("doc_chunk"), F.lit("view"), F.lit("code_chunk"), F.lit("code_chunk")), stores.doc_type(kind))
    return load(spark, d, "events").select("event_id", back.alias("t"))


@query("SELECT event_id, len(json_keys(props))::INT AS n, array_to_string(list_transform(json_keys(props), lambda k: k || '=' || json_extract_string(props, '$.' || k)), ',') AS entries FROM events")
def json_access(spark, d):
    p = F.from_json("props", "map<string,string>")
    every = F.array_join(F.transform(F.map_entries(p), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return load(spark, d, "events").select("event_id", F.size(p).alias("n"), every.alias("entries"))
