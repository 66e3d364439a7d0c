"""URL rules by hashed host-suffix and path-prefix expressions, with DataFrame functions only.

Each url expands into the expressions that a rule could have: its host suffixes at
label borders times its path prefixes of the lengths that occur among the rules.
Expressions meet the rules in an equi-join on a short prefix of their SHA-256
alone: the rules of one short prefix are one row, an array. The full digest then
picks the rule from that array; the longest rule wins. Results are gathered by row:
a row's expressions are aggregated in the task that made them, and no join leads
back to the pages.

Defined results: null url, or no "://": host and path are empty and no rule
fits. An empty path starts with no rule path but the empty one. Of two rules of
one length that fit, block wins, then the smaller text. Repeated pages each get
a row; extra columns are ignored, whatever their names. Rules with a null host or
path fit nothing. An empty rule table allows every page, an empty page table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the short hash prefix: four bytes.
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) rows as a DataFrame."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def keyed_rules(listed: DataFrame, prefix_digits: int) -> DataFrame:
    """rule_short, rules: the rules (digest, len, soft, rule, verdict) whose digests begin with it; a few, as digests are spread evenly."""
    digest, text = _digest(F.col("rule_host"), F.col("rule_path")), F.concat("rule_host", "rule_path")
    one = F.struct(digest.alias("digest"), (-F.length(text)).alias("len"), (F.col("verdict") != "block").alias("soft"), text.alias("rule"), "verdict")
    return listed.distinct().groupBy(F.left(digest, F.lit(prefix_digits)).alias("rule_short")).agg(F.collect_list(one).alias("rules"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT, prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """id, host, path, rule (or null) and verdict of each row of pages.

    What reaches the driver is one row with the label counts and path lengths of
    the rules, both bounded by the length of a rule.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    )
    shapes = listed.agg(F.sort_array(F.collect_set(_labels(F.col("rule_host")))).alias("n"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("l")).first()
    counts = F.array(*map(F.lit, shapes["n"])) if shapes["n"] else F.array().cast("array<int>")
    lengths = F.array(*map(F.lit, shapes["l"])) if shapes["l"] else F.array().cast("array<int>")
    hosts = F.transform(F.filter(counts, lambda k: k <= _labels(F.col("host"))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    paths = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substr(F.col("path"), F.lit(1), k))
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(h, p))))
    expressions = urls.select("row", "id", "host", "path", F.explode_outer(digests).alias("expression")).withColumn("short", F.left("expression", F.lit(prefix_digits)))
    met = expressions.join(keyed_rules(listed, prefix_digits), F.col("short") == F.col("rule_short"), "left")
    # the full digest confirms; of rules of one digest, the first in order of length, verdict and text
    fits = F.array_sort(F.filter("rules", lambda r: r["digest"] == F.col("expression")))
    best = met.withColumn("fit", F.get(fits, F.lit(0))).groupBy("row", "id", "host", "path").agg(F.min(F.when(F.col("fit").isNotNull(), F.struct("fit.len", "fit.soft", "fit.rule", "fit.verdict"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, rule_table(spark))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
hp AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
         FROM (SELECT DISTINCT host, path FROM hp) d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, hp.host, hp.path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN best ON hp.host = best.host AND hp.path = best.path
"""
