"""URL filtering: a blocked Bloom filter in front of an exact hash join.

A rule is a host with a path prefix, and fits the host and its subdomains. For a URL, every
host suffix with every path prefix of a length that the list knows is a possible rule. The
filter, 256-bit blocks of which a key touches one, passes the few that may be listed; the
hash join on the rule's text removes what it passed by mistake.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, materialise, replacing, unused

#: Rules, and judged pairs of host and path, up to this number are sent to all tasks; longer tables are joined by shuffle.
BROADCAST_RULES = 200_000
#: The filter never gets more 256-bit blocks than this; beyond, it passes more.
MAX_BLOCKS = 1 << 18
#: Parts that the rows of a popular rule are dealt to in the shuffled join.
SALTS = 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(h: Column) -> Column:
    """The eight bits of a key inside its block: one in each 32-bit word, packed as longs."""
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 5 * i), F.lit(32)).cast("int")) for i in range(8)])


def bloom_blocks(rules: DataFrame, n_blocks: int) -> DataFrame:
    """``block, w0..w7`` of the listed keys (column ``rule``)."""
    hashed = rules.select(F.xxhash64("rule").alias("h"), F.xxhash64(F.lit(7), "rule").alias("g"))
    bits = hashed.select(F.pmod("h", F.lit(n_blocks)).alias("block"), _bits(F.col("g")).alias("bits"))
    return bits.groupBy("block").agg(*[F.bit_or(F.get("bits", F.lit(i))).alias(f"w{i}") for i in range(8)])


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains when the
    URL's path starts with the rule's; of those that fit the longest (host and path) wins,
    of repeated rules ``block`` wins over ``allow``; without any, ``rule`` is null and the
    verdict ``default``. Rules with a null or empty host are ignored, a null path is empty.

    A null URL or one without ``://`` has an empty host and path and fits no rule. Repeated
    rows are judged alike; other columns pass through, those named like the new ones are
    replaced; empty tables give empty results.
    """
    listed = rules.where("host is not null and host != ''").select(
        ascii_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")
    )
    listed = listed.groupBy(F.concat("h", "p").alias("rule"), "h", "p").agg(F.max("v").alias("v"))
    n, lengths = listed.agg(F.count("*"), F.collect_set(F.length("p"))).first()
    base = replacing(urls, "host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if not n:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    n_blocks = min(MAX_BLOCKS, max(1, n // 16))
    blocks = bloom_blocks(listed, n_blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(known, lambda x: F.struct(s.alias("h"), F.substring(F.col("path"), F.lit(1), x).alias("p")))))
    # Rows of the same host and path are judged once.
    distinct = base.where("host != ''").select("host", "path").distinct()
    possible = distinct.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.h", "k.p", F.concat("k.h", "k.p").alias("rule"))
    hashed = possible.withColumn("block", F.pmod(F.xxhash64("rule"), F.lit(n_blocks))).withColumn("bits", _bits(F.xxhash64(F.lit(7), "rule")))
    passed = hashed.join(F.broadcast(blocks), "block")  # at most MAX_BLOCKS rows
    for i in range(8):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(F.get("bits", F.lit(i))) != 0)
    passed = passed.select("host", "path", "h", "p", "rule")
    if n <= BROADCAST_RULES:
        hits = passed.join(F.broadcast(listed), ["rule", "h", "p"])
    else:
        salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt")
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        hits = passed.withColumn("salt", salt).join(copies, ["rule", "h", "p", "salt"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "v"), F.struct(F.length("rule"), F.length("h"))).alias("best"))
    # Read from files, so that adaptive execution can split the rows of one very common URL.
    h, p, won = unused(base, "__h", "__p", "__best")
    best = materialise(best.toDF(h, p, won), "urls")
    # Sent to all tasks only if proven small; Spark's own bound is on the size of files.
    best = F.broadcast(best) if best.count() <= BROADCAST_RULES else best.hint("merge")
    out = base.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return out.select(*base.columns, F.col(won)["rule"].alias("rule"), F.coalesce(F.col(won)["v"], F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_digest(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict``."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages.select("page_id", "url"), rules).drop("url")


SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(h, p, v)),
u AS (SELECT row_number() OVER () AS i, page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (i)
"""
