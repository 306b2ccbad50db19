"""URL filters: a blocked Bloom filter passes possible hits on to an exact hash join.

The list holds rules (a host with its subdomains, and a path prefix) and single canonical URLs. Each
distinct URL is looked up under every key it could be listed by: its host's suffixes with its path's
prefixes, and its canonical form. A key touches one 64-bit block of the filter; keys whose bits are
all set go to the exact join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Bits set per key, and keys per 64-bit block on average.
BITS, PER_BLOCK = 4, 4
#: Up to so many listed keys the filter (a few bytes a key) and the list are sent to every task; above, both are shuffled.
FEW_KEYS = 100_000
#: Above, a key that very many URLs have (``rule com/``) is dealt into so many parts when its hit is joined back.
SALTS = 16
#: Query parameters that only track.
TRACKING = r"(?i)^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host without ``www.`` and port, path without closing slashes, query without tracking, no fragment."""
    host = F.regexp_replace(host_of(url), r"^www\.|:[0-9]*$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    return F.coalesce(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The key's bits in its block."""
    bits = F.xxhash64(F.lit("mask"), key)
    mask = None
    for i in range(BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of a blocked Bloom filter over keys (key)."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))


def listing(rules: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(key, rule, verdict) from rules (host, path, verdict) and urls (url), which are blocked; each key once.

    Of contrary verdicts on a rule ``block`` stays. Rules and urls with nulls are left out.
    """
    own = rules.where("host is not null and path is not null and verdict is not null").select(F.concat(F.lit("rule "), ascii_lower(F.col("host")), "path").alias("key"), F.concat(ascii_lower(F.col("host")), "path").alias("rule"), "verdict")
    if urls is not None:
        own = own.unionByName(urls.where(canonical_of(F.col("url")) != "").select(F.concat(F.lit("url "), canonical_of(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    return own.groupBy("key").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))


def _keys(lengths: list[int]) -> Column:
    """All keys a URL could be listed by: host suffixes at label bounds, path prefixes of the lengths that rules have."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*(F.substring("path", 1, n) for n in lengths))
    made = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.transform(F.array_distinct(prefixes), lambda p: F.concat(F.lit("rule "), s, p))))
    return F.concat(made, F.array(F.concat(F.lit("url "), F.col("canonical"))))


def judge(pages: DataFrame, rules: DataFrame, urls: DataFrame | None = None, few: int = FEW_KEYS, stats: dict | None = None) -> DataFrame:
    """(page_id, host, path, canonical, rule, verdict) for every row of pages (page_id, url, any more).

    The longest fitting rule decides. Without one, a URL whose canonical form is listed is blocked and any
    other allowed. Null urls and those without ``://`` have empty hosts and paths, which no rule
    fits unless it is empty too. Above ``few`` listed keys the filter and the list are shuffled, each distinct key is
    looked up once, and hits are joined back with salt. ``stats`` gets the number of keys the filter
    lets through (``possible``) and of those listed (``listed``). Repeated rows stay; an empty table gives no rows, an empty list allows all.
    """
    listed = cut(listing(rules, urls))
    n = listed.count()
    # One number per distinct length of a rule's path: a URL's length bounds them.
    lengths = sorted(r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect())
    blocks = max(1, -(-n // PER_BLOCK))
    small = n <= few
    sent = F.broadcast if small else (lambda df: df)
    parts = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_of(F.col("url")).alias("canonical")))
    keys = parts.select("host", "path", "canonical").distinct().withColumn("key", F.explode(_keys(lengths)))
    asked = keys if small else keys.select("key").distinct()
    asked = asked.withColumn("block", _block(F.col("key"), blocks)).withColumn("mask", _mask(F.col("key")))
    possible = asked.join(sent(bloom(listed.select("key"), blocks)), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
    found = possible.join(sent(listed), "key")
    if stats is not None:
        stats |= {"possible": possible.select("key").distinct().count(), "listed": found.select("key").distinct().count()}
    if not small:
        salted = found.select("key", "rule", "verdict", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        found = keys.withColumn("salt", F.pmod(F.xxhash64("host", "path", "canonical"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    hits = found.groupBy("host", "path", "canonical").agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)), "rule", "verdict")).alias("best"))
    hits = cut(hits.select(F.xxhash64("host", "path", "canonical").alias("h"), *(F.col(c).alias(f"_{c}") for c in ("host", "path", "canonical")), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    same = (F.xxhash64("host", "path", "canonical") == F.col("h")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")) & (F.col("canonical") == F.col("_canonical"))
    return parts.join(hits, same, "left").select("page_id", "host", "path", "canonical", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
