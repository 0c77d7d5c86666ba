"""URL filter: blocked Bloom filter, then an exact hash join (DataFrame functions only).

A rule is a listed canonical address (host and path prefix) with a verdict. It fits its host and all subdomains of it
when the address's path starts with the rule's path; the longest fitting rule decides. An address that no rule fits
gets the default verdict: a list says nothing about what isn't on it.

Edge cases: a null url, or one without ``://``, has empty host and path and fits no rule; repeated pages keep one row
each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table

#: Most 64-bit blocks of the filter: 16 MB of rows when it is broadcast, however long the list is. A longer list
#: makes the filter pass more; the exact join stays right.
MOST_BLOCKS = 1 << 20
#: Listed addresses for each block of 64 bits, with 4 bits set for each.
KEYS_PER_BLOCK = 4

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Canonical host and path of a url, by the text after its first ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4), F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _bits(h: Column) -> Column:
    """A word with 4 bits set, from four 6-bit fields of the hash."""
    mask = F.lit(0).cast("long")
    for shift in (40, 46, 52, 58):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return mask


def blocked_bloom(keys: DataFrame, host: str, path: str, blocks: int) -> DataFrame:
    """``block``, ``word``: the filter as a table of 64-bit blocks; empty blocks are left out."""
    h = F.xxhash64(F.col(host), F.col(path))
    return keys.select(F.pmod(h, F.lit(blocks)).alias("block"), _bits(h).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules``: host, path, verdict. One row for each page: id, host, path, ``rule`` (host and path of the rule that
    decided, else null), ``verdict``.

    Candidate keys of an address are its host suffixes and path prefixes of the shapes (number of labels, length of
    path) that the list has. The filter drops nearly all of them before the join.
    """
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    labels = F.size(F.split("r_host", r"\.", -1))
    shapes = rules.select(labels.alias("n"), F.length("r_path").alias("k")).distinct().collect()  # as many rows as the list has shapes
    n_rules = rules.count()
    blocks = 1
    while blocks * KEYS_PER_BLOCK < n_rules and blocks < MOST_BLOCKS:
        blocks *= 2
    blocks = max(blocks, 64)
    bloom = F.broadcast(blocked_bloom(rules, "r_host", "r_path", blocks))  # MOST_BLOCKS rows at most
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("u")).filter(F.col("u").isNotNull()).distinct()
    host_u, path_u = url_parts(F.col("u"))
    n_host = F.size(F.split("h", r"\.", -1))
    kind = "array<struct<c_host: string, c_path: string>>"

    def of_shape(n: int, lengths: list[int]) -> Column:
        """The candidates with ``n`` labels; no more than the path has prefixes."""
        fits = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length("p"))
        return F.when(n_host >= n, F.transform(fits, lambda k: F.struct(F.substring_index("h", ".", -n).alias("c_host"), F.col("p").substr(F.lit(1), k).alias("c_path")))).otherwise(F.array().cast(kind))

    by_labels: dict[int, list[int]] = {}
    for s in sorted(shapes):
        by_labels.setdefault(s["n"], []).append(s["k"])
    candidates = [of_shape(n, lengths) for n, lengths in by_labels.items()] or [F.array().cast(kind)]
    possible = (
        urls.select("u", host_u.alias("h"), path_u.alias("p"))
        .select("u", F.explode(F.flatten(F.array(*candidates))).alias("c"))
        .select("u", "c.c_host", "c.c_path")
        .withColumn("k", F.xxhash64("c_host", "c_path"))
        .withColumn("block", F.pmod("k", F.lit(blocks)))
        .join(bloom, "block")
        .filter(F.col("word").bitwiseAND(_bits(F.col("k"))) == _bits(F.col("k")))
    )
    hits = possible.join(rules, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_host"), F.col("r_path"))
    best = hits.groupBy("u").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), order).alias("best"))
    return pages.select(F.col(id_col), F.col(url_col).alias("u0"), host.alias("host"), path.alias("path")).join(best, F.col("u0") == F.col("u"), "left").select(
        id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_verdicts(read_table(spark, sf_dir, "pages"), rules)


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT page_id, host, path,
       CASE WHEN ex AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN ex AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule,
       CASE WHEN ex AND starts_with(path, '/en/1') THEN 'block'
            WHEN ex AND starts_with(path, '/es/') THEN 'block'
            WHEN com AND starts_with(path, '/fr/') THEN 'allow'
            WHEN com AND starts_with(path, '/de/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM (SELECT *, host = 'example.org' OR ends_with(host, '.example.org') AS ex, host = 'com' OR ends_with(host, '.com') AS com,
             host = 'org' OR ends_with(host, '.org') AS org FROM parts)
"""
