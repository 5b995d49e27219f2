"""URL filters, native: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The list is held as a Bloom filter of 256-bit blocks, one row each, built by bit_or per block. A URL is tested against the
four words of its one block; possible hits alone go to an exact hash join with the list, which removes false positives,
so that the verdict is exact. The filter is broadcast only if its size, known from the number of listed URLs, is below
max_filter_mb; beyond that it is joined by block like any table.

Canonical: host (lower case, without a leading www., m. or blog. and without :80 and :443) and path, without .html and closing
slashes; scheme, query and fragment don't count.

In op5 the list is that of the pages whose page_id is divisible by 100 (a stated query set, held against all rows): pages with the
canonical URL of any of them are blocked where no rule fits.

Defined cases: a null url, or one without ://, has empty host, path and canonical form, matches no rule and no list entry and is
allowed; repeated rows get equal verdicts; nulls in the list are dropped; very long URLs count whole; an empty table gives no rows, an empty list blocks
nothing; other columns are left out, whatever their names. Rules of equal length are taken in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path by the first ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(raw), path


def canonical(host: Column, path: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m|blog)\.(?=.)", ""), r":(?:80|443)$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(h, F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like net/, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _masks(url: Column, n_blocks: int) -> list[Column]:
    """Block number, and one bit or two in each of the block's four words."""
    h, g = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        n = F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", one, n)

    return [F.pmod(h, F.lit(n_blocks).cast("long")).alias("block"), *[bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"m{i}") for i in range(4)]]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of listed(canon)."""
    return listed.select(*_masks(F.col("canon"), n_blocks)).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def n_blocks_for(n: int, bits_per_key: int = 20) -> int:
    return max(1, -(-n * bits_per_key // 256))


def mark_listed(pages: DataFrame, listed: DataFrame, max_filter_mb: int = 64) -> DataFrame:
    """pages(canon, ...) with on_list: whether listed(canon) holds it, exactly. Only possible hits meet the list itself."""
    listed = stored(listed.where((F.col("canon") != "") & F.col("canon").isNotNull()).select("canon").distinct())
    n = n_blocks_for(listed.count())
    blocks = bloom_blocks(listed, n)
    if n * 64 <= max_filter_mb << 20:  # a row of five longs
        blocks = F.broadcast(blocks)
    cols = pages.columns
    tested = pages.select("*", *[c.alias(f"__{i}") for i, c in enumerate(_masks(F.col("canon"), n))])
    seen = tested.join(blocks.withColumnRenamed("block", "__0"), "__0", "left")
    maybe = F.lit(True)
    for i in range(4):
        maybe &= F.coalesce(F.col(f"w{i}").bitwiseAND(F.col(f"__{i + 1}")) == F.col(f"__{i + 1}"), F.lit(False))
    key = listed.select(F.concat(F.lit("="), "canon").alias("__key"), F.lit(True).alias("__listed"))  # in this guise a hot key's partition may be split
    exact = seen.where(maybe).select(*cols, F.concat(F.lit("="), "canon").alias("__key")).join(key, "__key", "left").select(*cols, F.coalesce("__listed", F.lit(False)).alias("on_list"))
    return exact.unionAll(seen.where(~maybe).select(*cols, F.lit(False).alias("on_list")))


def judge_urls(pages: DataFrame, listed_urls: DataFrame, rules=RULES, max_filter_mb: int = 64) -> DataFrame:
    """pages(page_id, url) with host, path, rule, verdict; listed_urls(url) is the block list."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("canon", canonical(F.col("host"), F.col("path")))
    lh, lp = url_parts(F.col("url"))
    listed = listed_urls.select(lh.alias("h"), lp.alias("p")).select(canonical(F.col("h"), F.col("p")).alias("canon"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", "canon", rule.alias("rule"), verdict.alias("verdict"))
    by_list = F.when(F.col("on_list"), "block").otherwise("allow")
    return mark_listed(ruled, listed, max_filter_mb).withColumn("verdict", F.coalesce("verdict", by_list)).drop("canon", "on_list")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), pages.where(F.col("page_id") % 100 == 0).select("url"))


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE WHEN host = '' THEN '' ELSE
        regexp_replace(CASE WHEN regexp_matches(host, '^(www|m|blog)\..') THEN regexp_replace(host, '^(www|m|blog)\.', '') ELSE host END, ':(80|443)$', '')
        || regexp_replace(path, '(\.html)?/*$', '') END AS canon FROM c),
e AS (SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM d),
l AS (SELECT DISTINCT canon FROM d WHERE page_id % 100 = 0 AND canon <> '')
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM e
"""
