"""URL rules behind a blocked Bloom filter.

A rule lists a canonical URL prefix: a host, which stands for itself and its subdomains, and the start of a
path. Each page URL gives the few keys that could be listed: suffixes of its host with as many labels as some listed
host, with path prefixes of listed lengths. They are tested against the blocked Bloom filter on the page's own row. A page
without a possible hit is done there; of the others the possible hits meet the list in an exact hash join, which removes
the filter's false positives, and come together again by row; the longest listed key decides. A URL with very many pages
is as many rows, and no key.

A null URL, or one without "://", has an empty host and path and fits no rule but one that lists the empty host. Rules
with a null host or path are left out. Repeated URLs and rows are each judged.
An empty table gives an empty result, an empty list lets everything pass. Extra columns are carried through,
unless they bear a result's name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import free_name, materialise, read_table

#: The rules of the registered query as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BITS_PER_KEY, PROBES = 16, 4
#: The filter is broadcast up to so many blocks of 256 bits; a larger one is joined by block. A list of so many rules is
#: broadcast too.
BROADCAST_BLOCKS, BROADCAST_RULES = 500_000, 100_000


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _blocks_of(key: Column, n_blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """(block, probes as (word 0..3, bit)) of a 64-bit key hash: 256 bits a block."""
    block = F.pmod(key, F.lit(n_blocks).cast("bigint"))
    other = F.xxhash64(key, F.lit(1))
    return block, [(F.shiftright(other, 8 * k).bitwiseAND(3), F.shiftright(other, 8 * k + 2).bitwiseAND(63)) for k in range(PROBES)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) with the bits of every key of `listed` (key bigint) set."""
    block, probes = _blocks_of(F.col("key"), n_blocks)
    words = [F.lit(0).cast("bigint") for _ in range(4)]
    for word, bit in probes:
        words = [F.when(word == k, w.bitwiseOR(_bit(bit))).otherwise(w) for k, w in enumerate(words)]
    return listed.select(block.alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def _bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))


def _flat_bits(spark: SparkSession, bits: DataFrame, n_blocks: int) -> DataFrame:
    """One row: the filter's words in order, four a block; n_blocks is at most BROADCAST_BLOCKS."""
    own = spark.range(n_blocks).withColumnRenamed("id", "block").join(bits, "block", "left")
    words = F.struct("block", F.array(*[F.coalesce(f"w{k}", F.lit(0).cast("bigint")) for k in range(4)]).alias("words"))
    return own.agg(F.flatten(F.transform(F.sort_array(F.collect_list(words)), lambda x: x["words"])).alias("_bits"))


def _passes(key: Column, word_at, n_blocks: int) -> Column:
    """Whether all probes of a key are set; word_at(block, word) gives a word of the filter."""
    block, probes = _blocks_of(key, n_blocks)
    out = F.lit(True)
    for word, bit in probes:
        out = out & (word_at(block, word).bitwiseAND(_bit(bit)) != 0)
    return out


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Append host, path, rule and verdict. rules: host, path, verdict; of equal rules, block wins."""
    spark = pages.sparkSession
    host, path = canonical(F.col(f"`{url_col}`"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    listed = rules.select(F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna(subset=["rule_host", "rule_path"]).groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    listed = materialise(listed.withColumn("key", F.xxhash64("rule_host", "rule_path")))
    n = listed.count()
    if not n:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    n_blocks = max(1, math.ceil(n * BITS_PER_KEY / 256))
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().collect()]  # as many as path lengths in use
    labels = [r[0] for r in listed.select(F.size(F.split("rule_host", r"\."))).distinct().collect()]  # as many as label counts in use
    ends = [F.substring_index("host", ".", -k) for k in sorted(labels)]  # the host itself where it has fewer labels
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, k) for k in sorted(lengths)]))
    pairs = F.flatten(F.transform(F.array_distinct(F.array(*ends)), lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path")))))
    bits = materialise(bloom(listed.select("key"), n_blocks))
    key, hits, best = (free_name(judged, name) for name in ("_row", "_hits", "_best"))
    if n_blocks <= most_blocks:
        met = judged.crossJoin(F.broadcast(_flat_bits(spark, bits, n_blocks)))  # one row of bits
        word_at = lambda block, word: F.get("_bits", (block * 4 + word).cast("int"))
        met = met.withColumn(hits, F.filter(pairs, lambda p: _passes(F.xxhash64(p["rule_host"], p["rule_path"]), word_at, n_blocks))).drop("_bits")
    else:  # a filter too large to send around: what pages ask for meets it by block, and only that is shuffled
        keyed = materialise(judged.withColumn(key, F.monotonically_increasing_id()))
        asked = keyed.select(key, F.inline(pairs)).withColumn("_key", F.xxhash64("rule_host", "rule_path"))
        block, _ = _blocks_of(F.col("_key"), n_blocks)
        word_of = lambda _, word: F.when(word == 0, F.col("w0")).when(word == 1, F.col("w1")).when(word == 2, F.col("w2")).otherwise(F.col("w3"))
        passed = asked.withColumn("block", block).join(bits, "block").filter(_passes(F.col("_key"), word_of, n_blocks))
        found = passed.groupBy(key).agg(F.collect_list(F.struct("rule_host", "rule_path")).alias(hits))  # as many as lengths times labels at most
        met = keyed.join(found, key, "left").drop(key)
    # pages without a possible hit are done where they are; the few others meet the list itself
    quiet = met.filter(F.coalesce(F.size(hits), F.lit(0)) <= 0).drop(hits).select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    few = F.broadcast if n <= BROADCAST_RULES else lambda df: df
    loud = met.filter(F.size(hits) > 0).withColumn(key, F.monotonically_increasing_id())
    size = F.length("rule_host") + F.length("rule_path")
    choice = F.struct(size.alias("size"), F.length("rule_host").alias("wide"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    exact = loud.select(*judged.columns, key, F.inline(hits)).join(few(listed.drop("key")), ["rule_host", "rule_path"], "left")
    page = F.first(F.struct(*[F.col(f"`{c}`") for c in judged.columns])).alias("page")
    chosen = exact.groupBy(key).agg(page, F.max(F.when(F.col("verdict").isNotNull(), choice)).alias(best))  # a row's own hits
    judged_loud = chosen.select("page.*", F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))
    return quiet.unionByName(judged_loud).select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", "verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return apply_rules(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP6_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), pages2 AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), best AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM pages2, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM pages2 LEFT JOIN best USING (page_id)
"""
