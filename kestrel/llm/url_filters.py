"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression that a
rule could name. Expressions and rules meet in an equi-join on a short digest
prefix; the full digest then confirms the hit and the longest rule wins. All of
it is plain DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.tables import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Verdict for a URL that no rule fits.
DEFAULT_VERDICT = "allow"

#: Hex digits of the digest that the equi-join compares.
PREFIX_DIGITS = 8

#: Rule tables of up to this many rows are broadcast (under 4 MB of keys).
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' without one."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; '' without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """``a.b.c`` gives ``c``, ``b.c``, ``a.b.c``, of as many labels as rules have; no other number can fit."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    wanted = F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= dots + 1)
    return F.transform(wanted, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """Prefixes of the lengths that rules have; no other length can fit."""
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.transform(wanted, lambda n: F.substring(path, F.lit(1), n))


def expression(host: Column, path: Column) -> Column:
    """The text whose digest stands for a pair; a host holds no line feed before its path."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules as rows with digests. Of equal (host, path), ``block`` wins over ``allow``."""
    rows = [(r.verdict, r.host.translate(str.maketrans(UPPER, LOWER)), r.path) for r in rules]
    frame = spark.createDataFrame(rows, "verdict string, host string, path string")
    one = frame.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = expression(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"), "verdict",
        F.length("host").alias("host_len"), digest.alias("digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
    )


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``pages`` needs ``page_id`` and ``url``; other columns are not read. A null
    URL, or one without ``://``, has empty host and path and so meets no rule
    with a path. Repeated URLs are judged once and all their rows returned. The
    longest rule (host plus path) wins; at equal length the longer host, then
    ``block``. Without rules, or where none fits, the verdict is ``default``.
    """
    spark, rules = pages.sparkSession, list(rules)
    urls = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths, labels = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    expanded = (
        urls.select("host", "path").distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("suffix"))
        .select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), lengths)).alias("start"))
        .withColumn("full", expression(F.col("suffix"), F.col("start")))
        .select("host", "path", "full", F.substring("full", 1, PREFIX_DIGITS).alias("prefix"))
    )
    hits = (
        expanded.join(table, "prefix").where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", F.col("verdict").alias("verdict"), "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return urls.join(hits, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


OP8_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), urls AS (SELECT DISTINCT host, path FROM p
), hit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
"""
