"""URL filters: host-suffix and path-prefix expressions looked up by hash prefix.

Every distinct (host, path) is expanded into ``suffix + directory prefix``
expressions.  Their SHA-256 digests meet the rules' digests in an equi-join on
the first hexadecimal digits; full digests and the rest of the rule's path are
then confirmed, and the longest fitting rule decides.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, action) rows as a DataFrame."""
    if not rules:
        return spark.createDataFrame([], "host string, path string, action string")
    row = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "action"), r, strict=True)]) for r in rules]))
    return spark.range(1, numPartitions=1).select(row.alias("r")).select("r.*")


def host_of(url):
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    found = F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url):
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def _prefixes(path, most: int):
    """Each part of ``path`` that ends with a slash, up to ``most`` slashes."""
    parts = F.split(path, "/", most + 1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def _suffixes(host, most: int):
    """The last labels of ``host``, up to ``most``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (or replaced).

    A rule (host, path, action) fits its host and all subdomains if the url's
    path starts with the rule's.  The longest rule wins; among equally long ones
    the longer host, then ``block``.  Without a rule the verdict is ``default``.
    A null url, or one without ``://``, has an empty host and path; a path with
    no slash fits no rule.  Repeated rows each get their verdict; null or empty
    rules fit nothing; other columns of ``pages`` stay as they are.
    """
    # The rows travel as one struct, so that none of their names can clash.
    kept = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.struct(F.lit(0).alias("_"), *kept).alias("row"))
    rules = rules.where("host is not null and path like '/%' and action is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action"
    )
    folder = F.regexp_extract("rule_path", r"^(.*/)", 1)
    rules = rules.withColumn("rule_digest", F.sha2(F.concat("rule_host", folder), 256)).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))

    # No url needs more labels or directories than the longest rule has.
    slashes, dots = (F.max(F.length(c) - F.length(F.replace(c, F.lit(x)))) for c, x in ((F.col("rule_path"), "/"), (F.col("rule_host"), ".")))
    most = rules.agg(F.coalesce(slashes, F.lit(1)).alias("slashes"), F.coalesce(dots, F.lit(0)).alias("dots")).first()
    places = pages.select("host", "path").where("path <> ''").distinct()
    suffixes, prefixes = _suffixes(F.col("host"), most.dots + 1), _prefixes(F.col("path"), most.slashes)
    expression = F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    looked_up = places.select("host", "path", expression.alias("expression")).withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hits = looked_up.join(rules, F.col("prefix") == F.col("rule_prefix")).where("digest = rule_digest and startswith(path, rule_path)")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "block").cast("int").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "action"))
    decided = hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    out = pages.join(decided, ["host", "path"], "left")
    return out.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).drop("_")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         row_number() OVER () AS n
  FROM pages),
rules(rule_host, rule_path, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (
  SELECT n, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, action = 'block' DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
