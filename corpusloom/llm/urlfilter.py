"""URL rules through a blocked Bloom filter and an exact join.

The listed canonical URLs (host and path prefix) go into a Bloom filter of 256-bit blocks. Each URL's possible
listings - each suffix of its host with as many labels as a listed host has, with every listed length of its path -
are looked up there; the possible hits go to an exact hash join with the list, which removes the false positives. The
longest listing wins. So a URL costs its length, however many labels its host has.

Null url or no `://`: host and path are empty, no rule. No rule fits: the verdict is allow (nothing listed).
Repeated rows are kept. Empty input or an empty list: no rows, or no rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower

#: Broadcast a side only up to this many rows (a block has 32 bytes, a rule a short string).
BROADCAST_ROWS = 500_000
BITS_PER_KEY, PROBES, BLOCK_BITS = 16, 8, 256

DEFAULT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _bits(key):
    """The key's bits in its block, from independent seeded hashes."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(BLOCK_BITS)) for i in range(1, PROBES + 1)])


def _block(key, n_blocks: int):
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(n_blocks))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """keys(key) -> block, w0..w3: the block's 256 bits as four longs."""
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), F.explode(_bits(F.col("key"))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(BLOCK_BITS // 64)]
    return bits.groupBy("block").agg(*words)


def _may_hold(key):
    """Are all of the key's bits set in the block joined to it?"""
    at = lambda b: F.when(b < 64, F.col("w0")).when(b < 128, F.col("w1")).when(b < 192, F.col("w2")).otherwise(F.col("w3"))
    return F.forall(_bits(key), lambda b: F.getbit(at(b), (b % 64).cast("int")) == 1)


def split_url(url):
    """Host (A-Z lowered) and path of a URL, both empty where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules(host, path, action) -> per input row: id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action").filter("rule_host != '' and rule_path is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))  # equal rules that differ: block
    listed = rules.select(F.concat_ws("\x01", "rule_host", "rule_path").alias("key"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    n_rules = listed.count()
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())  # bounded by the longest path
    depths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())  # and the deepest host
    n_blocks = max(1, -(-n_rules * BITS_PER_KEY // BLOCK_BITS))
    blocks = bloom_blocks(listed, n_blocks)
    if n_blocks <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    if n_rules <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    n_labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    tails = F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda n: n <= n_labels)
    heads = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    distinct = urls.select("host", "path").distinct().filter("host != ''")
    asked = (
        distinct.withColumn("tail", F.explode(tails))
        .withColumn("head", F.explode(heads))
        .select("host", "path", F.concat_ws("\x01", F.expr("substring_index(host, '.', -tail)"), F.expr("substring(path, 1, head)")).alias("key"))
        .withColumn("block", _block(F.col("key"), n_blocks))
    )
    possible = asked.join(blocks, "block").filter(_may_hold(F.col("key"))).select("host", "path", "key")
    best = possible.join(listed, "key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule")).alias("best"))
    # URLs without a host match nothing: they are spread instead of meeting at one key
    apart = F.concat(F.lit("\x01"), F.xxhash64("page_id", F.spark_partition_id()).cast("string"))
    urls = urls.withColumn("at", F.when(F.col("host") == "", apart).otherwise(F.col("host")))
    best = best.select(F.col("host").alias("at"), "path", "best")
    return urls.join(best, ["at", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict")
    )
