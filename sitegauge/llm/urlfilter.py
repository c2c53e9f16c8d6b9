"""URL filters: rules by host and path, and a blocked Bloom filter before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# verdict, host and path of a rule.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
# Bits of a block, and bits the filter has per listed address.
BLOCK_BITS, KEY_BITS = 256, 16
# Largest filter that is broadcast: 65,536 blocks of 32 bytes, 2 MB. Beyond, it is joined by block.
BROADCAST_BLOCKS = 1 << 16
# First host labels of the sites whose pages make up the list of the query.
LISTED_LABELS = ("spam-farm", "free-bets", "adult-x")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, ASCII letters lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.` or `m.`, path without `.html` and closing slashes; null without a host."""
    name, place = F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html?)?/*\z", "")
    return F.when(host != "", F.concat(name, place))


def _blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Adds `_block` and `_m0.._m3`: the two bits the key sets in each of the block's four 64-bit words."""
    bit = "shiftleft(1L, cast(shiftrightunsigned(xxhash64('bits', _url), {}) & 63 AS int))"
    masks = [F.expr(f"{bit.format(12 * i)} | {bit.format(12 * i + 6)}").alias(f"_m{i}") for i in range(4)]
    return keys.select("*", F.pmod(F.xxhash64("_url"), F.lit(n_blocks)).alias("_block"), *masks)


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter as a table: one row of four words per block that is not empty."""
    return _blocks(listed, n_blocks).groupBy("_block").agg(*(F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(4)))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct of rule and verdict; null if none does."""
    cases = [
        F.when(
            ((host == where) | host.endswith("." + where)) & path.startswith(start),
            F.struct(F.lit(where + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, where, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*cases)


def judge_urls(
    urls: DataFrame, listed: DataFrame, *, rules=RULES, key_bits: int = KEY_BITS, broadcast_blocks: int = BROADCAST_BLOCKS
) -> DataFrame:
    """Adds `host, path, rule, verdict, listed, possible` to `urls` (which has `url`).

    The rule that fits decides; where none does, an address whose canonical form is
    in `listed` (a table with a column `url`) is blocked, any other is allowed.

    `listed` becomes a blocked Bloom filter: an address sets eight bits of one
    256-bit block. Addresses that miss a bit are surely not listed (`possible` is
    false); only the others go to the exact hash join, so a false positive costs a
    lookup and never a verdict.

    Scale: the filter has a fixed number of bits per listed address. Up to 2 MB it
    is broadcast, so the crawl is not shuffled; a larger one is joined by block,
    whose number is spread evenly. The exact join sees possible hits only, and a
    hot address among them is a key the planner can split (one row per listed address).

    Null or malformed urls have empty host and path, fit no rule and are allowed;
    null or malformed list entries are ignored, repeated ones count once; columns
    of `urls` named like a result are replaced.
    """
    results = ["host", "path", "rule", "verdict", "listed", "possible"]
    base = urls.drop(*results)
    own = [F.col(f"`{c}`") for c in base.columns]
    # A row travels as one value, so none of its columns can clash with those used here.
    parts = base.select(F.struct(*own).alias("_in"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.select(
        "*", canonical(F.col("host"), F.col("path")).alias("_url"), matching_rule(F.col("host"), F.col("path"), rules).alias("_rule")
    )
    entries = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("_url"))
    entries = stored(entries.where(F.col("_url").isNotNull()).distinct(), "listed-urls")
    n_blocks = 1
    while n_blocks * BLOCK_BITS < key_bits * entries.count():
        n_blocks *= 2
    bloom = bloom_filter(entries, n_blocks)
    if n_blocks <= broadcast_blocks:
        bloom = F.broadcast(bloom)
    probed = _blocks(judged, n_blocks).join(bloom, "_block", "left")
    hit = F.lit(True)
    for i in range(4):
        hit &= F.col(f"_w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}")
    probed = probed.withColumn("possible", F.coalesce(hit & F.col("_url").isNotNull(), F.lit(False)))
    # Two branches, so that sure misses stay out of the exchange.
    sure = probed.where(~F.col("possible")).withColumn("listed", F.lit(False))
    exact = entries.withColumn("_found", F.lit(True))
    checked = probed.where("possible").join(exact, "_url", "left").withColumn("listed", F.col("_found").isNotNull())
    both = sure.unionByName(checked.drop("_found"))
    return both.select(
        "_in.*", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed", "possible",
    )


def seed_list(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """Addresses of the crawled pages of known bad sites."""
    return pages.where(host_of(F.col("url")).rlike(rf"^(www\.|m\.)?({'|'.join(labels)})\.")).select("url")


def query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, seed_list(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH h AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM h
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?)?/*$', '') END AS url FROM p
), l AS (
  SELECT DISTINCT url FROM c WHERE regexp_matches(host, '^(www\.|m\.)?(spam-farm|free-bets|adult-x)\.')
), r AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, rhost, rpath)
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, m.rule,
  coalesce(m.verdict, CASE WHEN c.url IN (SELECT url FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m USING (page_id)"""
