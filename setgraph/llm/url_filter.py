"""URL filters: a blocked Bloom filter in front of an exact hash join.

What is listed are keys: host and path of a rule ("net/es/"), or a whole canonical URL. A filter is a table of blocks
of eight 64-bit words; a key sets one bit in each word of its block. A URL's keys are all pairs of a suffix of its host
and a beginning of its path that the rules' shapes allow; each distinct key is tested once, those that pass meet the
listed keys in an exact join, so false positives end there. The longest rule that fits decides.

URLs that no rule fits are judged by a list of canonical URLs: those of pages that a rule blocks, and what the caller
lists. In a canonical URL user names, ports, trailing dots of the host, fragments and tracking parameters are left out,
an empty path is "/". So a page that a rule misses by such a disguise shares the verdict of its plain form.

A null URL, or one without "://", has an empty host and path, no rule and no canonical form, and is allowed. Repeated
rows and rows with null ids each get the verdict of their URL. An empty table gives an empty result. Rules without host
fit nothing, a null path of a rule counts as empty; of two rules with one host and path "block" wins. Of rules of equal
length the one with the longer host wins. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.guards import bounded_rows
from ..plans.lineage import cut_lineage
from .common import ascii_lower, join_counted, table

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of a block and listed keys a block: 16 bits a key.
WORDS, BLOCK_KEYS = 8, 32
#: A filter of at most so many blocks (72 bytes each, 36 MB) is sent to all tasks; a larger one is shuffled by block.
MOST_BLOCKS = 500_000
#: Listed keys of at most this number (and the keys that pass) are sent to all tasks.
MOST_SENT = 100_000
#: Pairs of (labels of the host, length of the path) among the rules.
MOST_SHAPES = 5_000
#: Names of query parameters that tell where a reader came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def _after(url: Column) -> Column:
    """What follows the first "://"; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host, path and query of a URL without what doesn't change the page; null where there is no host."""
    host = F.regexp_replace(F.substring_index(host_of(url), "@", -1), r":[0-9]*\z", "")
    host = F.rtrim(host, F.lit("."))
    path = path_of(url)
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.substring(F.regexp_replace(F.concat(F.lit("&"), query), f"&(?:{TRACKING})=[^&]*", ""), 2, 2**31 - 1)
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: str) -> list[Column]:
    """The bit of each word of the key's block."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {6 * j}) & 63 AS int))") for j in range(WORDS)]


def bloom_filter(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of the keys in column `key`, about n of them: rows (block, w0 ... w7) and the number of blocks."""
    blocks = max(1, -(-n // BLOCK_KEYS))
    set_bits = listed.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"w{j}") for j, m in enumerate(_masks("key"))))
    return set_bits.groupBy("block").agg(*(F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS))), blocks


def possible_hits(keys: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """The rows of keys whose `key` the filter of listed lets through: all that are listed, and about one in 500 others."""
    bits, blocks = bloom_filter(listed, n)
    bits = F.broadcast(bits) if blocks <= MOST_BLOCKS else bits
    all_set = F.lit(True)
    for j, mask in enumerate(_masks("key")):
        all_set &= F.col(f"w{j}").bitwiseAND(mask) == mask
    return keys.withColumn("block", _block(F.col("key"), blocks)).join(bits, "block").filter(all_set).select(*keys.columns)


def listed_hits(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of keys (distinct `key`, and others) that are listed, with the columns of listed (distinct `key`)."""
    n = listed.count()
    passed = possible_hits(keys, listed, n)
    return passed.join(F.broadcast(listed) if n <= MOST_SENT else listed, "key")


def _rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the rows (url, host, path) that a rule fits."""
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    entries = rules.select(F.concat("host", "path").alias("key"), F.length("host").alias("size"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    entries = cut_lineage(entries.groupBy("key").agg(F.max("verdict").alias("verdict"), F.first("size").alias("size"), F.first("labels").alias("labels"), F.first("chars").alias("chars")))
    shapes = bounded_rows(entries.select("labels", "chars").distinct(), MOST_SHAPES, "shapes of rules")
    if not shapes:
        return urls.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    cut = [F.when(F.length("path") >= s.chars, F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars))) for s in shapes]
    keyed = urls.select("url", F.explode(F.array_distinct(F.array_compact(F.array(*cut)))).alias("key"))
    counted = cut_lineage(keyed.groupBy("key").agg(F.count("*").alias("n")))
    hits = cut_lineage(listed_hits(counted, entries.select("key", "verdict", "size")))
    met = join_counted(keyed, hits, "key", counted.agg(F.sum("n")).first()[0] or 0, how="inner")
    longest = F.max(F.struct(F.length("key").alias("chars"), "size", F.col("key").alias("rule"), "verdict")).alias("best")
    return met.groupBy("url").agg(longest).select("url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every row of pages.

    rules has host, path and verdict ("allow" or "block"); listed has canonical URLs to be blocked in column canonical.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    counted = rows.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"))
    described = counted.select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("canonical"))
    urls = cut_lineage(described)
    ruled = cut_lineage(_rule_hits(urls, rules))
    judged = cut_lineage(urls.select("url", "n", "canonical").join(ruled, "url", "left"))
    # Canonical URLs that are listed, and those of URLs without a rule: each distinct one is tested once.
    block = judged.filter("verdict = 'block'").select(F.col("canonical").alias("key"))
    block = block if listed is None else block.unionByName(listed.select(F.col("canonical").cast("string").alias("key")))
    block = cut_lineage(block.filter("key IS NOT NULL").distinct())
    open_urls = judged.filter("rule IS NULL")
    asked = cut_lineage(open_urls.filter("canonical IS NOT NULL").groupBy(F.col("canonical").alias("key")).agg(F.count("*").alias("n")))
    found = cut_lineage(listed_hits(asked, block).select(F.col("key").alias("canonical"), "n", F.lit(True).alias("listed")))
    by_list = join_counted(open_urls.select("url", "canonical"), found, "canonical", asked.agg(F.sum("n")).first()[0] or 0, how="inner").select("url", "listed")
    known = judged.join(by_list, "url", "left").filter("rule IS NOT NULL OR listed").select("url", "n", "rule", "verdict", "listed")
    out = join_counted(rows, cut_lineage(known), "url", judged.agg(F.sum("n")).first()[0] or 0)
    url, hit = F.coalesce("url", F.lit("")), F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("verdict", F.when(hit, "block").otherwise("allow"))
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule", verdict.alias("verdict"), canonical_url(url).alias("canonical"), hit.alias("listed"))


def op12_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_LOWERED = "translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same in DuckDB.
ORACLE = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
cut AS (SELECT row_number() OVER () AS row_at, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT row_at, page_id, {_LOWERED.format("u")} AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace('&' || regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&(?:{TRACKING})=[^&]*', '', 'g')[2:] AS query FROM cut),
plain AS (SELECT *, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\\z', ''), '.') AS bare FROM parts),
named AS (SELECT row_at, page_id, host, path, CASE WHEN bare <> '' THEN bare || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM plain),
ruled AS (SELECT row_at, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY row_at),
judged AS (SELECT n.*, r.rule, r.verdict FROM named n LEFT JOIN ruled r USING (row_at)),
blocked AS (SELECT DISTINCT canonical FROM judged WHERE verdict = 'block' AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN b.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict, j.canonical,
    rule IS NULL AND b.canonical IS NOT NULL AS listed
FROM judged j LEFT JOIN blocked b ON j.canonical = b.canonical"""
