"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every url is reduced to (host, path). Its canonical keys are all host suffixes joined with the path
prefixes of the lengths that the list uses. A key goes to one 256-bit block of the filter, of which it
tests eight bits; only keys that pass reach the exact join, which removes the filter's false positives.
The filter is a small table (block, four 64-bit words), so it is broadcast while it is small and
joined by block number when the list has grown beyond the bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jadwal.llm.common import UPPER, ascii_lower, table

LIST_SCHEMA = "host string, path string, verdict string, is_rule boolean"
BITS_PER_KEY = 16
BLOCK_BITS = 256
BROADCAST_ROWS = 100_000

# The contract's rules, and the listed canonical URLs of the production query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED = [(f"{name}.example.{end}", "/") for name in ("spam-farm", "casino-win", "ads-track", "cheap-pills") for end in ("com", "net", "org")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _masks(key: Column) -> list[Column]:
    """Four words with two bits each."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, n).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(12 * w).bitwiseOR(bit(12 * w + 6)) for w in range(BLOCK_BITS // 64)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of column ``key``: block, w0..w3."""
    words = _masks(F.col("key"))
    return (
        keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(words))])
    )


def filter_urls(urls: DataFrame, listed: DataFrame, url_col: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    ``listed`` has LIST_SCHEMA: an entry fits its host and every subdomain when the path starts with the
    entry's. Of the rules that fit, the longest wins (host and path together, then the smaller string);
    without one, a listed entry that fits blocks, and everything else is allowed.

    Null urls and urls without ``://`` have empty host and path and are allowed. Repeated rows stay
    repeated. Own columns of ``urls`` named host, path, rule or verdict are replaced. Null entries of the
    list are ignored; an empty list allows everything.
    """
    src = urls.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col]).withColumn("__url", F.col(url_col))
    host, path = host_path(F.col("__url"))
    src = src.withColumn("host", host).withColumn("path", path).drop("__url")
    entries = listed.where("host is not null and path is not null").select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), "verdict", "is_rule").distinct()
    shape = entries.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    if not shape["n"]:
        return src.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    small = shape["n"] <= broadcast_rows
    n_blocks = max(1, -(-shape["n"] * BITS_PER_KEY // BLOCK_BITS))
    bound = F.broadcast if small else (lambda d: d)

    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(names) - shape["labels"] + 1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(shape["chars"])]), lambda n: n <= F.length("path"))
    tried = (
        src.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("chars", F.explode(lengths))
        .select("host", "path", F.concat("suffix", F.expr("substring(path, 1, chars)")).alias("key"))
        .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    )
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("key")))])
    possible = tried.join(bound(bloom_blocks(entries, n_blocks)), "block").where(passed).select("host", "path", "key")
    order = F.struct(~F.col("is_rule"), -F.length("key"), "key")
    found = (
        possible.join(bound(entries), "key").groupBy("host", "path")
        .agg(F.min_by(F.struct("key", "verdict", "is_rule"), order).alias("best"))
        .select("host", "path", F.when(F.col("best.is_rule"), F.col("best.key")).alias("rule"), F.when(F.col("best.is_rule"), F.col("best.verdict")).otherwise("block").alias("verdict"))
    )
    # Urls without a host match nothing; keys of their own keep them from meeting in one task. Frequent urls are left to skew joins.
    alone = F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"))
    keyed = src.withColumn("__host", F.col("host")).withColumn("__path", F.when(F.col("host") == "", alone).otherwise(F.col("path")))
    found = found.withColumnsRenamed({"host": "__host", "path": "__path"})
    return keyed.join(found, ["__host", "__path"], "left").drop("__host", "__path").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


def production_list(spark: SparkSession) -> DataFrame:
    rows = [(h, p, v, True) for h, p, v in RULES] + [(h, p, "block", False) for h, p in LISTED]
    return spark.createDataFrame(rows, T._parse_datatype_string(LIST_SCHEMA))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, production_list(spark)).select("page_id", "host", "path", "rule", "verdict")


_rows = ", ".join([f"('{h}', '{p}', '{v}', true)" for h, p, v in RULES] + [f"('{h}', '{p}', 'block', false)" for h, p in LISTED])
OP10_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), entries(h, p, v, is_rule) AS (VALUES {_rows}),
fits AS (
  SELECT page_id, h || p AS rule, v, is_rule,
         row_number() OVER (PARTITION BY page_id ORDER BY is_rule DESC, length(h || p) DESC, h || p) AS rn
  FROM parts JOIN entries ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, CASE WHEN is_rule THEN rule END AS rule,
       CASE WHEN is_rule THEN v WHEN is_rule IS NULL THEN 'allow' ELSE 'block' END AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND rn = 1
"""
