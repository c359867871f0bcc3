"""URL filters by host-suffix and path-prefix expressions.

Rules are (host, path, verdict). A URL is expanded into the expressions that a
rule could have: each suffix of its host at a dot, with each beginning of its
path that is as long as some rule's path. Expressions and rules are joined on
the first ``PREFIX`` hex digits of their sha256, and the full digest confirms.
Of several rules that fit, the longest wins (host and path together, then path,
then block before allow). A URL that no rule fits gets the default verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null URL, or one
without ``://``, has an empty host and an empty path, and fits no rule but one
with an empty host. Each distinct (host, path) is judged once, so repeated URLs
cost little; repeated rows are kept. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = 8
DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


def with_parts(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    return out.withColumns({
        "host": F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER),
        "path": F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with the text and digest of each; of equal rules, block stays."""
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER)
    text = rules.select(F.concat(host, F.coalesce(F.col("path"), F.lit(""))).alias("rule"), F.length(F.coalesce(F.col("path"), F.lit(""))).alias("path_len"), "verdict")
    return text.groupBy("rule", "path_len").agg(F.max("verdict").alias("verdict")).withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX))


def expand(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct (host, path) with a row for each expression: path_len, digest, short."""
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sizes = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path"))
    return (
        urls.select("host", "path", F.explode(hosts).alias("_host"), sizes.alias("_sizes"))
        .select("host", "path", "_host", F.explode("_sizes").alias("path_len"))
        .withColumn("digest", F.sha2(F.concat("_host", F.expr("left(path, path_len)")), 256))
        .select("host", "path", "path_len", "digest", F.substring("digest", 1, PREFIX).alias("short"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict."""
    table = rule_table(rules)
    # Rule paths have few lengths, at most that of the longest rule.
    size, lengths = table.agg(F.sum(F.octet_length("rule") + 100), F.collect_set("path_len")).first()
    sized = F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table
    pages = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    if not lengths:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = pages.where("host <> '' or path <> ''").select("host", "path").distinct()
    hits = expand(urls, sorted(lengths)).alias("u").join(
        sized.alias("r"), (F.col("u.short") == F.col("r.short")) & (F.col("u.digest") == F.col("r.digest")) & (F.col("u.path_len") == F.col("r.path_len"))
    ).select("u.host", "u.path", "r.rule", "r.verdict", F.struct(F.length("r.rule"), "r.path_len", "r.verdict").alias("rank"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, length(r.path) DESC, r.verdict DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.k = 1
"""
