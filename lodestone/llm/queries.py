"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, license, mix, pack, shard, simhash, topk, toxicity, trie, urls
from .common import table

#: Fixed values of the URL query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The parts of the listed URLs, those with even numbers below LISTED_BELOW. Odd numbers, other endings and queries
#: that don't merely track are near misses.
LISTED_HOSTS = ("", "m.", "blog."), ("spam-farm", "casino-win", "free-bets", "cheap-pills"), ("com", "org")
LISTED_PATHS, LISTED_BELOW = ("en", "fr", "de", "es"), 1000


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat.turns_of(table(spark, sf_dir, "conversations")).unionByName(extra)
    out = chat.format_turns(turns)
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge(pages, rules, listed_urls(spark))


def listed_urls(spark: SparkSession) -> DataFrame:
    """(url): an outside list, made by a rule."""
    hosts = [f"{a}{b}.example.{c}" for a in LISTED_HOSTS[0] for b in LISTED_HOSTS[1] for c in LISTED_HOSTS[2]]
    of = lambda values: F.explode(F.array(*map(F.lit, values)))
    parts = spark.range(0, LISTED_BELOW, 2).withColumn("host", of(hosts)).withColumn("lang", of(LISTED_PATHS))
    return parts.select(F.format_string("http://%s/%s/%d", "host", "lang", "id").alias("url"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(table(spark, sf_dir, "documents"), 40)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mix.plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        left, right = align.ByteLevel(a.read()), align.Pieces(b.read())
    return align.align(table(spark, sf_dir, "documents"), left, right, digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(coded.select("doc_id", "ids"), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.turns_of(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_chat_formatting, op3_license_scan, op4_url_filter, op5_toxicity, op6_decontamination, op7_simhash, op8_sharding, op9_mixing, op10_packing, op11_alignment, op12_bpe, op13_prefix_trie, pipeline)}

_W = r"[^\x20\x09-\x0D]+"


def _canonical_sql(text: str) -> str:
    """The canonical licence text in DuckDB: every word between blanks of its own, so that plain replacing loses none."""
    line = license.COPYRIGHT_LINE.removeprefix("(?m)").replace(r"\pL\pN", r"\p{L}\p{N}")
    c = f"regexp_replace(lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g')), '(?m){line}', '', 'g')"
    c = f"' ' || replace(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for a, b in sorted(license.EQUIVALENT, key=lambda ab: " " in ab[0] + ab[1]):
        c = f"replace({c}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({c}, '  ', ' '))"



ORACLES = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, 65), lambda i: q.x[i] * d.x[i]))::BIGINT AS score
              FROM (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v d ON q.vec_id <> d.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_chat_formatting": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, (length(role || text) - length(replace(role || text, chr(92), ''))
                + 2 * ((length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
                + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7)) AS grown FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(role) + length(text) + grown + 3 + 6 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id, alone""",
    "op3_license_scan": f"""
        WITH t AS (SELECT licence, text, NULL AS doc_id, NULL AS digest FROM (VALUES {", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in license.KNOWN)}) AS x(licence, text)
                   UNION ALL SELECT NULL, coalesce(text, ''), doc_id, NULL FROM documents),
        c AS (SELECT licence, doc_id, sha256({_canonical_sql("text")}) AS digest FROM t),
        k AS (SELECT digest, min(licence) AS licence FROM (SELECT digest, licence FROM c WHERE licence IS NOT NULL UNION ALL VALUES {", ".join(f"('{d}', '{n}')" for n, d in license.FULL)}) GROUP BY digest)
        SELECT c.doc_id, c.digest, k.licence FROM c LEFT JOIN k ON c.digest = k.digest WHERE c.licence IS NULL""",
    "op4_url_filter": """
        WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)', 'i'))) AS kept FROM p),
        c AS (SELECT page_id, host, path, coalesce(regexp_replace(host, '^www\\.|:[0-9]*$', '', 'g') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END, '') AS canonical FROM q),
        r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                             WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c),
        l AS (SELECT a || b || '.example.' || t || '/' || g || '/' || n::VARCHAR AS canonical FROM (SELECT unnest(['', 'm.', 'blog.']) AS a), (SELECT unnest(['spam-farm', 'casino-win', 'free-bets', 'cheap-pills']) AS b),
              (SELECT unnest(['com', 'org']) AS t), (SELECT unnest(['en', 'fr', 'de', 'es']) AS g), (SELECT unnest(range(0, 1000, 2)) AS n))
        SELECT page_id, host, path, r.canonical, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
        FROM r LEFT JOIN l ON r.canonical = l.canonical""",
    "op9_mixing": f"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS digest,
                          row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS place FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS stop FROM s),
        l AS (SELECT *, row_number() OVER o AS place,
                     ((sum(source_size) OVER ())::BIGINT - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
              FROM w WINDOW o AS (ORDER BY stop::DOUBLE / w::DOUBLE, source NULLS LAST)),
        h AS (SELECT min_by(level, place) AS held FROM l WHERE level * w < stop),
        t AS (SELECT source, source_size, CASE WHEN held IS NULL THEN stop::DOUBLE ELSE least(stop::DOUBLE, held * w) END AS target FROM l, h),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
        u AS (SELECT d.*, r.source_size, r.target, r.rate,
                     ('0x' || substr(md5(concat_ws('|', '0', coalesce((d.doc_id)::VARCHAR, ''), d.digest, (d.place)::VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u""",
    "op13_prefix_trie": """
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc),
        t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS said,
                     xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, x: xor(a // 256, crc[xor(a % 256, x) + 1])), 4294967295) % 9 AS h
              FROM t, crc GROUP BY conv_id, crc),
        r AS (SELECT c.conv_id, list_concat(coalesce(g.said[1:c.h], []), c.said[c.h + 1:]) AS said FROM c LEFT JOIN c g ON g.conv_id = c.conv_id - c.conv_id % 5),
        p AS (SELECT conv_id, d, len(said) AS n, to_json(said[1:d])::VARCHAR AS k, CASE WHEN d > 0 THEN to_json(said[1:d - 1])::VARCHAR END AS up, CASE WHEN d > 0 THEN strlen(said[d].text) ELSE 0 END AS bytes, said
              FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM r)),
        node AS (SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min_by(said, conv_id) AS said, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
                 FROM p GROUP BY k, d),
        kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
        w AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
        s AS (SELECT to_json(said[1:a])::VARCHAR AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1)
        SELECT w.conv_id, w.d AS depth, above.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
        FROM w JOIN s ON w.k = s.k LEFT JOIN w above ON w.d > 0 AND above.k = w.up""",
}
