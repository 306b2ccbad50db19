"""Queries over change streams, recorded and live. Live ones read the events table as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import rollup
from ..session import load, scratch
from ..streaming import changes, state
from .registered import query


def _stream(spark, d, name="events"):
    schema = load(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _finished(q):
    """Waits until a stream has read all there is, however long that takes, as what it has written so far is no result; raises what
    it failed by."""
    try:
        q.awaitTermination()
    finally:
        q.stop()


def _drained(spark, stream, name):
    """What a stream of files gives in append mode once all of it is read."""
    at = scratch(spark, name)
    _finished(stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def streamed_windows(spark, d):
    """Tumbling windows that the watermark has closed."""
    e = changes.watermarked(_stream(spark, d), "ts", "10 minutes")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = _drained(spark, w.select(F.col("w.start").alias("start"), "event_type", "n"), "windows")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT e.event_id, p.event_id AS purchase FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts > e.ts AND p.ts <= e.ts + INTERVAL '30 minutes' WHERE e.event_type = 'error' AND p.event_type = 'purchase'")
def stream_join(spark, d):
    """Purchases in the half hour after an error: two streams joined within watermarks."""
    one, two = (changes.watermarked(_stream(spark, d).where(f"event_type = '{t}'"), "ts", "1 hour") for t in ("error", "purchase"))
    e = one.select(F.col("user_id").alias("u"), F.col("ts").alias("at"), "event_id")
    p = two.select("user_id", "ts", F.col("event_id").alias("purchase"))
    both = e.join(p, (F.col("u") == F.col("user_id")) & (F.col("ts") > F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("interval 30 minutes")))
    return _drained(spark, both.select("event_id", "purchase"), "joined")


@query("SELECT * FROM (VALUES ('complete', true), ('progress', true), ('started', true), ('error', false)) AS x(kind, seen)")
def lifecycle_events(spark, d):
    """What a listener hears of one stream, from its start to its end."""
    heard = changes.IndexEvents()
    spark.streams.addListener(heard)
    try:
        at = scratch(spark, "heard")
        q = _stream(spark, d).select("event_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        _finished(q)
        if not changes.wait_for(q, lambda: any(k in ("complete", "error") for k, _ in heard.events), 600):
            raise TimeoutError("the listener wasn't told of the stream's end")
    finally:
        spark.streams.removeListener(heard)
    kinds = {k for k, _ in heard.events}
    return spark.createDataFrame([(k, k in kinds) for k in ("complete", "progress", "started", "error")], "kind string, seen boolean")


_SENT = "SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_SENT}), s AS (
 SELECT user_id, rn, t + 3600 AS until, 0::BIGINT AS held, NULL::DOUBLE AS fired_at, NULL::BIGINT AS fired_n, t AS sent_at FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn,
  CASE WHEN t >= until AND (held = 0 OR t >= until + 3600) THEN t + 3600 WHEN t >= until THEN until + 3600 ELSE until END,
  CASE WHEN t >= until AND (held = 0 OR t >= until + 3600) THEN 0 WHEN t >= until THEN 1 ELSE held + 1 END,
  CASE WHEN t >= until AND held > 0 THEN until END, CASE WHEN t >= until AND held > 0 THEN held END, CASE WHEN t >= until AND (held = 0 OR t >= until + 3600) THEN t END
 FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
 SELECT user_id, fired_at AS at, fired_n AS n FROM s WHERE fired_n IS NOT NULL UNION ALL SELECT user_id, sent_at, 1 FROM s WHERE sent_at IS NOT NULL
 UNION ALL SELECT user_id, until, held FROM s WHERE held > 0 AND rn = (SELECT max(rn) FROM e WHERE e.user_id = s.user_id)""")
def throttle(spark, d):
    return changes.throttle(load(spark, d, "events"), "user_id", "ts", 3600.0)


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_SENT}), s AS (SELECT user_id, rn, t + 3600 AS due FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, CASE WHEN t < due THEN due ELSE t + 3600 END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1) SELECT user_id, due AS "at", count(*) AS n FROM s GROUP BY user_id, due""")
def buffer_from_first(spark, d):
    return changes.buffer_from_first(load(spark, d, "events"), "user_id", "ts", 3600.0)


@query("""WITH l AS (SELECT doc_id::VARCHAR AS file, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 3 <> 0)
 SELECT file, md5(line) AS chunk FROM l WHERE NOT (file::BIGINT % 10 = 0 OR file::BIGINT % 10 = 1) UNION ALL SELECT doc_id::VARCHAR, md5('new ' || doc_id::VARCHAR) FROM documents WHERE doc_id % 10 = 1 OR (doc_id % 10 = 5 AND doc_id % 3 = 0)""")
def index_sync(spark, d):
    """An index of two thirds of the documents after two batches: a tenth deleted (and updated too late), a tenth updated twice, files
    that fail once and come with the next batch, and the first batch sent again."""
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "doc_id", "text")
    fails = [True]

    def chunk(files):
        ok = ~(F.lit(fails[0]) & (F.col("file").cast("long") % 10 == 5) & (F.col("text") != "first"))
        return files.select("file", F.md5("text").alias("chunk"), ok.alias("ok"))

    sync = changes.IndexSync(spark, scratch(spark, "sync"), chunk)
    sync.build(docs.where("doc_id % 3 <> 0").select("file", F.explode(F.split("text", "\n")).alias("line")).select("file", F.md5("line").alias("chunk")))
    new = lambda where, kind, seq, t: docs.where(where).select("file", F.lit(kind).alias("type"), t.alias("text"), F.lit(seq).alias("seq"))
    fresh = F.concat(F.lit("new "), "file")
    first = agg.union_all(new("doc_id % 10 = 0", "deleted", 1, F.lit(None).cast("string")), new("doc_id % 10 = 0", "updated", 2, F.lit("late")), new("doc_id % 10 = 1", "updated", 1, F.lit("first")), new("doc_id % 10 = 1", "updated", 2, fresh), new("doc_id % 10 = 5 and doc_id % 3 = 0", "updated", 1, fresh))
    sync.on_batch(first, 4)
    fails[0] = False
    sync.on_batch(first.limit(0), 0)
    sync.on_batch(first, 4)
    return sync.read()


@query("SELECT event_id FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 30")
def replayed(spark, d):
    """What a sink that is attached after event 400 is sent first."""
    return changes.replay(load(spark, d, "events").withColumn("seq", F.col("event_id")), 400).limit(30).select("event_id")


@query("SELECT 'before' AS moment, doc_id FROM labels UNION ALL SELECT 'after', doc_id FROM documents")
def cache_handover(spark, d):
    """The old table is served until the new one can be read."""
    at, old = scratch(spark, "cache"), load(spark, d, "labels").select("doc_id")
    before = changes.serve_while_loading(lambda: spark.read.parquet(at), old)
    load(spark, d, "documents").select("doc_id").write.parquet(at)
    after = changes.serve_while_loading(lambda: spark.read.parquet(at), old)
    return before.withColumn("moment", F.lit("before")).unionByName(after.withColumn("moment", F.lit("after")))


@query("SELECT doc_id AS file, length(text)::BIGINT AS n, CASE WHEN doc_id % 4 = 0 THEN 'second' ELSE 'first' END AS pass FROM documents")
def retried(spark, d):
    """Every fourth file fails at first and is tried again."""
    files = load(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    made = lambda f, name: f.select("file", F.length("text").cast("long").alias("n"), F.lit(name).alias("pass"))
    out = changes.retry_failed(files, lambda f: made(f, "first").withColumn("ok", F.col("file") % 4 != 0), lambda f: made(f, "second").withColumn("ok", F.lit(True)))
    return out.select("file", "n", "pass")


@query("SELECT user_id AS scope, round(sum(value), 6) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id UNION ALL SELECT NULL, round(value, 6) FROM events WHERE event_type = 'error'")
def reduced_scopes(spark, d):
    e = load(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("scope"), "value")
    return changes.reduce_scopes(e, "scope", "value").withColumn("value", F.round("value", 6))


@query("""WITH l AS (SELECT r_name || '/' || n_name || '/' || c_custkey::VARCHAR AS path, c_custkey % 40 = 7 AS changed, CASE WHEN c_custkey % 40 = 7 THEN 'errored' WHEN c_custkey % 3 = 0 THEN 'passed' ELSE 'skipped' END AS state, c_acctbal AS duration FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 u AS (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS node, * FROM l)
 SELECT node, max_by(state, CASE state WHEN 'errored' THEN 5 WHEN 'passed' THEN 2 ELSE 1 END) AS state, round(sum(duration), 2) AS duration FROM u GROUP BY node HAVING bool_or(changed)""")
def affected_rollup(spark, d):
    """Only the ancestors of changed leaves are rolled up again."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    state = F.when(F.col("c_custkey") % 40 == 7, "errored").when(F.col("c_custkey") % 3 == 0, "passed").otherwise("skipped")
    leaves = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string")).alias("path"), state.alias("state"), F.col("c_acctbal").alias("duration"), (F.col("c_custkey") % 40 == 7).alias("changed"))
    nodes = agg.affected_nodes(leaves.where("changed"))
    return agg.rollup_states(leaves, only=nodes).withColumn("duration", F.round("duration", 2))


@query("""WITH l AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_custkey::VARCHAR AS path, c_acctbal + CASE WHEN c_custkey % 50 = 9 THEN 5 ELSE 0 END AS duration,
  CASE WHEN c_custkey % 40 = 7 THEN 'failed' WHEN c_custkey % 3 = 0 THEN 'passed' ELSE 'skipped' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 60 <> 11),
 u AS (SELECT unnest(list_transform(range(1, 5), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS node, * FROM l)
 SELECT node, max_by(state, CASE state WHEN 'failed' THEN 4 WHEN 'passed' THEN 2 ELSE 1 END) AS state, round(sum(duration), 2) AS duration FROM u GROUP BY node""")
def rollup_updates(spark, d):
    """A stored rollup after two batches: some leaves fail and some take longer, then some are removed; the first batch is sent twice."""
    c, n, r = (load(spark, d, t) for t in ("customer", "nation", "region"))
    at, key = F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.col("c_custkey").cast("string")), F.col("c_custkey")
    start = F.when(key % 3 == 0, "passed").otherwise("skipped")
    leaves = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(key, at.alias("path"), start.alias("state"), F.col("c_acctbal").alias("duration"))
    table = rollup.Rollup(spark, scratch(spark, "rollup"))
    table.create(leaves)
    first = leaves.where((key % 40 == 7) | (key % 50 == 9)).withColumn("state", F.when(key % 40 == 7, "failed").otherwise(F.col("state"))).withColumn("duration", F.col("duration") + F.when(key % 50 == 9, 5).otherwise(0))
    table.update(first, "changes", 1)
    table.update(leaves.where(key % 60 == 11).withColumn("state", F.lit(None).cast("string")), "changes", 2)
    table.update(first.limit(0), "changes", 1)
    return table.read().withColumn("duration", F.round("duration", 2))


def _in_batches(spark, d, name, n=4):
    """The events as a stream of n batches in order of event_id: each is a file of its own."""
    at, e = scratch(spark, name), load(spark, d, "events")
    top = e.agg(F.max("event_id")).first()[0] + 1
    for i in range(n):
        e.where((F.col("event_id") >= top * i // n) & (F.col("event_id") < top * (i + 1) // n)).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _each_batch(spark, stream, name, mode):
    """(batch, ...): what a stream gives with each batch, once all of it is read."""
    at = scratch(spark, name)
    keep = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{at}/out/b={i}")
    with state.state_store(spark):
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    _finished(q)
    return spark.read.parquet(f"{at}/out").drop("b")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS place, round(value, 6) AS value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)")
def live_ring(spark, d):
    """The last five events of each user, kept as state over a live stream: what was sent with the last batch that touched the user."""
    rows = _each_batch(spark, state.ring_stream(_in_batches(spark, d, "ring"), "user_id", "event_id", "value", 5), "ring", "update")
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["user_id", "batch"]).select("user_id", "event_id", "place", F.round("value", 6).alias("value"))


@query("""SELECT user_id, event_id, round(value, 6) AS delta, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS value FROM events
 QUALIFY event_id <= max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id)""")
def live_deltas(spark, d):
    """Changes that wait for the purchase that ends their transaction, over a live stream."""
    stream = _in_batches(spark, d, "deltas").select("user_id", "event_id", F.col("value").alias("delta"), (F.col("event_type") == "purchase").alias("ends"))
    rows = _each_batch(spark, state.delta_stream(stream, "user_id", "event_id", "delta", "ends"), "deltas", "append")
    return rows.select("user_id", "event_id", F.round("delta", 6).alias("delta"), F.round("value", 4).alias("value"))
