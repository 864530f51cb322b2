"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs set four bits each in one 64-bit block. The list is
written and counted first, and the filter has a block for every
``KEYS_PER_BLOCK`` URLs (under 1 % of other URLs pass), ``MAX_BLOCKS`` at most:
its broadcast is bounded by that parameter, 16 bytes a block, whatever the
list's length. Beyond ``KEYS_PER_BLOCK * MAX_BLOCKS`` URLs more pages pass the
filter, and the exact join decides them as before. A page whose bits are all set is
a possible hit, and only possible hits go to the exact hash join with the list,
which removes the false positives. Beside the list, path-scoped host rules
(a short parameter) decide first: a rule fits its host and all subdomains when
the path starts with the rule's path, and the longest one wins.

Canonical form: host without a leading ``www.`` or ``m.``, and the path
without a trailing slash or ``.html``; scheme, query and fragment are dropped.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule, is not listed, and is allowed; rows that repeat a URL get
the same verdict; an empty list blocks nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


PRODUCTION_RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)
KEYS_PER_BLOCK = 4
MIN_BLOCKS, MAX_BLOCKS = 1 << 6, 1 << 20
BITS_PER_KEY = 4


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    found = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(found, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(found, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def _block_and_bits(key: Column, n_blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    bits = F.lit(0).cast("long")
    spread = F.xxhash64(key, F.lit("bits"))
    for i in range(BITS_PER_KEY):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                              F.pmod(F.shiftrightunsigned(spread, 6 * i), F.lit(64)).cast("int")))
    return F.pmod(h, F.lit(n_blocks)), bits


def blocks_for(n_keys: int) -> int:
    """The next power of two that gives every ``KEYS_PER_BLOCK`` keys a block, within the bounds."""
    wanted = -(-n_keys // KEYS_PER_BLOCK)
    return max(MIN_BLOCKS, min(MAX_BLOCKS, 1 << max(0, wanted - 1).bit_length()))


def bloom_filter(listed: DataFrame, key: str = "canonical", n_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``block, mask``: the filter of the keys, at most ``n_blocks`` rows."""
    block, bits = _block_and_bits(F.col(key), n_blocks)
    return listed.select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("mask"))


def _longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):    # later ones, which are longer, decide first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, rules=PRODUCTION_RULES, id_col: str = "page_id",
                url_col: str = "url", n_blocks: int | None = None) -> DataFrame:
    """``id_col, host, path, rule, listed, verdict`` for every page.
    ``listed`` has one column ``canonical``; ``n_blocks`` follows its count unless given."""
    listed = stage(listed.select("canonical").filter("canonical <> ''").distinct(), "listed-urls")
    n_blocks = n_blocks or blocks_for(listed.count())
    host, path = url_parts(pages[url_col])
    judged = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rule, by_rule = _longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"),
                           rule.alias("rule"), by_rule.alias("by_rule"))
    block, bits = _block_and_bits(F.col("canonical"), n_blocks)
    probed = (judged.select("*", block.alias("block"), bits.alias("bits"))
              .join(F.broadcast(bloom_filter(listed, n_blocks=n_blocks)), "block", "left")   # n_blocks rows at most
              .withColumn("possible", F.coalesce(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))))
    hits = (probed.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
            .withColumn("listed", F.coalesce("listed", F.lit(False))))
    misses = probed.filter("not possible").withColumn("listed", F.lit(False))
    columns = ["id", "host", "path", "rule", "by_rule", "listed"]
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return (hits.select(*columns).unionByName(misses.select(*columns))
            .select(F.col("id").alias(id_col), "host", "path", "rule", "listed", verdict.alias("verdict")))


#: Host labels whose URLs the production block list takes from the crawl.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_from_crawl(pages: DataFrame, labels=LISTED_LABELS, url_col: str = "url") -> DataFrame:
    """Canonical URLs of the crawl on hosts with a listed label."""
    host, path = url_parts(pages[url_col])
    wanted = F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))
    return pages.filter(wanted).select(canonical(host, path).alias("canonical"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                              ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(r.verdict, length(rh || rp)) AS by_rule
         FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, rule, l.canonical IS NOT NULL AS listed,
       coalesce(by_rule, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN l ON c.canonical = l.canonical LEFT JOIN best ON best.page_id = c.page_id
"""
