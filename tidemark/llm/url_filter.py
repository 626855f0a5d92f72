"""URL filtering by host and path rules, with DataFrame functions only.

Each url is expanded into the expressions that a rule could be written as: a
suffix of its host's labels followed by a prefix of its path. The expressions
meet the rules in an equi-join on the first bytes of their SHA-256; the full
digests then confirm a match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text from the end of the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _expressions(host_labels: Column, labels: int, lengths: list[int]) -> Column:
    """The host's last `labels` labels, each time with the path's beginning of one of the given lengths; none for a shorter host or path."""
    suffix = F.array_join(F.slice(host_labels, -labels, labels), ".")
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    beginnings = F.transform(fitting, lambda n: F.concat(suffix, F.substring(F.col("path"), F.lit(1), n)))
    return F.when(F.size(host_labels) >= labels, beginnings).otherwise(F.array().cast("array<string>"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    prefix_bytes: int = 4,
    default: str = "allow",
    broadcast_rules: int = 100_000,
) -> DataFrame:
    """One row per row of `pages`: the id, host, path, rule (host and path of the winner, or null) and verdict.

    `rules` has the columns host, path and verdict. A rule fits its host and all
    subdomains if the url's path starts with the rule's. The longest rule wins,
    then the longer host, then `block` over `allow`. Urls without a rule get `default`.

    Defined cases: a null url, or one without `://`, has an empty host and path
    and gets `default`; an empty rule table gives `default` everywhere; null
    rules (any column) fit nothing; repeated rows of either table change no
    verdict, and every row of `pages` is kept; other columns of `pages` are not read.
    Rules are broadcast up to `broadcast_rules` rows and joined by shuffle beyond.
    Expressions are made for the label counts and path lengths that rules have,
    of which the driver gets one row a label count.
    """
    located = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    known = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("labels", F.size(F.split("rule_host", r"\.")))
        .withColumn("rule_digest", _digest(F.col("rule")))
        .withColumn("prefix", F.substring("rule_digest", 1, prefix_bytes))
    )
    shapes = known.groupBy("labels").agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).orderBy("labels").collect()
    host_labels = F.split("host", r"\.")
    listed = [_expressions(host_labels, row.labels, row.lengths) for row in shapes]
    expressions = F.flatten(F.array(*listed)) if listed else F.array().cast("array<string>")
    expanded = (
        located.where("host <> ''")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions).alias("expression"))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("prefix", F.substring("digest", 1, prefix_bytes))
        .drop("expression")
    )
    small = known.limit(broadcast_rules + 1).count() <= broadcast_rules
    matched = (
        expanded.join(F.broadcast(known) if small else known, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule_verdict", "rule")).alias("best"))
        .select(F.col("host").alias("m_host"), F.col("path").alias("m_path"), "best")
    )
    return located.join(matched, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
