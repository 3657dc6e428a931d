"""URL filter: blocked Bloom filter first, exact join on its hits, rules on top.

The listed canonical URLs are hashed into blocks of four 64-bit words, two
bits in each. A URL whose bits aren't all set is certainly not listed; the
possible hits alone are joined with the list itself, which removes false
positives. Everything is DataFrame expressions. The filter takes about
``BITS`` bits a listed URL; its number of blocks is known before it is built,
and it is broadcast only up to ``BROADCAST_BLOCKS``; beyond that blocks and
URLs meet in a shuffle on the block number.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is never listed; repeated rows are judged alike; an empty
list allows all that no rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.shared import checked_broadcast, stage

BITS, WORDS = 16, 4
BROADCAST_BLOCKS = 1 << 17  # 5 MB

#: Rules of the registered query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Labels of hosts whose pages' canonical URLs the registered query lists.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., path without .html and closing slashes."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), F.regexp_replace(path, r"(?:\.html)?/*$", ""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def bloom_masks(key: Column, blocks: int) -> list[Column]:
    """Block number and a mask of two bits for each of its words."""
    one = F.lit(1).cast("long")
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    bit = lambda k: F.call_function("shiftleft", one, F.shiftrightunsigned(b, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [F.pmod(a, F.lit(blocks)).alias("block"), *(bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"mask{i}") for i in range(WORDS))]


def build_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per block that has a bit: block, word0 to word3."""
    masks = listed.select(*bloom_masks(F.col("canonical"), blocks))
    return masks.groupBy(F.col("block").alias("_block")).agg(*(F.bit_or(f"mask{i}").alias(f"word{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, keep: str = "page_id") -> DataFrame:
    """``keep``, host, path, rule, verdict, possible (Bloom hit), listed, of each row of ``pages`` (url).

    ``listed_urls``: a column url; verdict is the rule's, else block if the
    canonical URL is listed, else allow.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    listed = stage(listed_urls.select(canonical(host, path).alias("canonical")).filter("canonical <> ''").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS // (64 * WORDS)))
    bloom = build_bloom(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    named = pages.select(F.col(keep), host.alias("host"), path.alias("path"))
    judged = named.select("*", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    probed = judged.select("*", *bloom_masks(F.col("canonical"), blocks)).join(bloom, F.col("block") == F.col("_block"), "left")
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"word{i}").bitwiseAND(F.col(f"mask{i}")) == F.col(f"mask{i}"))
    probed = probed.select(keep, "host", "path", "rule", "ruled", "canonical", F.coalesce(hit, F.lit(False)).alias("possible"))
    # only possible hits bring their URL to the exact join; the others go by a hash of the row, so that they don't meet in one place
    key = F.when(F.col("possible"), F.col("canonical")).otherwise(F.concat(F.lit("\u0001"), F.xxhash64(keep, "canonical").cast("string")))
    met = probed.withColumn("_key", key).join(checked_broadcast(listed.select(F.col("canonical").alias("_listed")), of=F.octet_length("_listed") + 16), F.col("possible") & (F.col("_key") == F.col("_listed")), "left")
    return met.withColumn("listed", F.col("_listed").isNotNull()).select(keep, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "possible", "listed")


def listed_pages(pages: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    """URLs of the pages that are on a host with one of the labels."""
    return pages.filter(F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*map(F.lit, labels)))).select("url")
