"""URL filters: host-suffix and path-prefix expressions matched by short digests, in DataFrame functions only.

Every URL is expanded into the expressions ``suffix-of-host + prefix-of-path``, cut at label and
segment boundaries and no deeper than the deepest rule, which loses nothing. Expressions meet the rules
in an equi-join on the first four bytes of their SHA-256; the full digest confirms each meeting and the
longest confirmed rule wins. Work is done once per distinct URL, so copies of one URL collapse before the
shuffle, and the verdicts go back to the rows in a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, verdict) of the rules that the registered query applies.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: The verdict where no rule fits: a list of rules blocks or allows only what it names.
DEFAULT = "allow"
#: Rules up to this many are broadcast; more of them are shuffled.
BROADCAST_RULES = 200_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as (rule_host, rule_path, verdict). Paths start and end with ``/``, hosts are not empty."""
    for host, path, verdict in rules:
        if not host or not path.startswith("/") or not path.endswith("/") or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {host!r}, {path!r}, {verdict!r}")
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    lower = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All host suffixes of at most ``labels`` labels with all path prefixes of at most ``slashes`` slashes."""
    parts, segments = F.split(host, r"\.", -1), F.split(path, "/", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    depth = F.least(F.size(segments) - 1, F.lit(slashes))
    prefixes = F.when(
        depth >= 1,
        F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(segments, 1, n), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict. Other columns are left out.

    Null URLs and URLs without ``://`` have an empty host and path and get ``default``, as do URLs no rule
    fits; a path that lacks the rule's leading slash does not fit. Repeated rows are judged alike. Of rules
    with the same text, block wins. An empty table gives an empty result.
    """
    rule = F.concat("rule_host", "rule_path")
    listed = (
        rules.select(rule.alias("rule"), "verdict", "rule_host", "rule_path")
        .groupBy("rule").agg(F.max("verdict").alias("verdict"), F.first("rule_host").alias("h"), F.first("rule_path").alias("p"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    at = listed.agg(
        F.max(F.size(F.split("h", r"\.", -1))).alias("labels"), F.max(F.size(F.split("p", "/", -1)) - 1).alias("slashes"), F.count("*").alias("n")
    ).first()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast(T.StringType()).alias("url"))
    if not at["n"]:
        return rows.select(
            "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    side = F.broadcast(listed) if at["n"] <= BROADCAST_RULES else listed
    urls = rows.filter(F.col("url").isNotNull()).select("url").distinct()
    expanded = urls.select(
        "url", F.explode(_expressions(host_of(F.col("url")), path_of(F.col("url")), at["labels"], at["slashes"])).alias("expression")
    ).select("url", F.sha2("expression", 256).alias("full"), F.substring(F.sha2("expression", 256), 1, 8).alias("prefix"))
    hits = (
        expanded.join(side.select("prefix", "digest", "rule", "verdict"), "prefix")
        .filter(F.col("full") == F.col("digest"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select(F.col("url").alias("hit_url"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return rows.join(hits, rows["url"] == hits["hit_url"], "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH u AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM u
"""
