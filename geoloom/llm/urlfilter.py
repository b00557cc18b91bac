"""URL filters: rules by host and path, then a blocked Bloom filter of listed URLs before an exact join.

The filter is a table of blocks of eight 64-bit words, built by combining bits before the shuffle. Each
canonical URL belongs to one block and sets one bit in each of its words. The table is at most
``MAX_BLOCKS`` rows whatever the list holds, so it may be broadcast; a list beyond that capacity only
lets more URLs through to the exact join, which removes every false positive.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is never
listed; repeated rows are judged alike; empty lists and tables work; other columns pass
through, and those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.names import free_names
from geoloom.plans.scratch import materialize

BITS_PER_URL = 16
#: 64 bytes of bits each
MAX_BLOCKS = 1 << 18
RESULTS = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: fixed values: the rules of the query, as (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: fixed values: host labels whose pages make up the query's list
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without its last slashes; null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null; a rule fits its host and all below it."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(url: Column) -> list[Column]:
    """One bit in each of the eight words of the URL's block."""
    h = F.xxhash64(F.lit(1), url)
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(8)
    ]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of the distinct URLs in column ``canonical``."""
    block = F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block")
    at = listed.select(block, *(b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("canonical")))))
    return at.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``listed`` has the URLs to block where no rule fits."""
    h, p = host(F.col(f"`{url}`")), path(F.col(f"`{url}`"))
    names = materialize(
        listed.select(canonical(h, p).alias("canonical")).where("canonical is not null").distinct(), "listed"
    )
    size = max(1, names.count() * BITS_PER_URL // 512)
    blocks = min(MAX_BLOCKS, 1 << (size - 1).bit_length())
    bloom = materialize(bloom_blocks(names, blocks), "bloom")
    name, rule, block, hit, found = free_names("canonical rule block hit found", pages)
    words = free_names(" ".join(f"w{k}" for k in range(8)), pages)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in RESULTS]
    judged = pages.select(*kept, h.alias("host"), p.alias("path"), canonical(h, p).alias(name), rule_of(h, p, rules).alias(rule))
    renamed = bloom.select(F.col("block").alias(block), *(F.col(f"w{k}").alias(w) for k, w in enumerate(words)))
    probed = judged.withColumn(block, F.pmod(F.xxhash64(name), F.lit(blocks))).join(F.broadcast(renamed), block, "left")
    possible = F.col(name).isNotNull() & F.col(rule).isNull()
    for w, bit in zip(words, _bits(F.col(name))):
        possible = possible & F.coalesce(F.col(w).bitwiseAND(bit) != 0, F.lit(False))
    probed = probed.withColumn(hit, possible).drop(block, *words)
    exact = names.select(F.col("canonical").alias(name), F.lit("block").alias(found))
    sure = probed.where(F.col(hit)).join(exact, name, "left")
    other = probed.where(~F.col(hit)).withColumn(found, F.lit(None).cast("string"))
    return sure.unionByName(other).select(
        *kept, "host", "path", F.col(rule)["rule"].alias("rule"), F.coalesce(F.col(rule)["verdict"], found, F.lit("allow")).alias("verdict")
    )


def _on_label(host: Column, labels: list[str]) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, labels)))


def report(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(_on_label(host(F.col("url")), LISTED_LABELS))
    return filter_urls(pages, listed, RULES).drop("url")


_CASES = "\n".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
SQL = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical,
             CASE {_CASES} END AS fit FROM u),
l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), {LISTED_LABELS}))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
       CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM c"""
