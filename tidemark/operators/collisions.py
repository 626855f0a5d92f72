"""Names of a listing that a target cannot tell apart."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..plans.policies import Policy
from ..shared import Table
from .tree import canonical, prefixes


def objects(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """What can collide: each directory of an archive once, and each file entry (archive, kind, parts, node_id, members, index)."""
    node = F.col("node_id") if "node_id" in directories.columns else F.lit("")
    folders = directories.select("archive", F.lit("directory").alias("kind"), "parts", node.alias("node_id"), F.concat("explicit_entry_ids", "descendant_entry_ids").alias("members"), F.lit(-1).cast("long").alias("index"))
    files = entries.where((F.col("entry_type") == "file") & (F.size("parts") > 0)).select(
        "archive", F.lit("file").alias("kind"), "parts", F.lit("").alias("node_id"), F.array("entry_id").alias("members"), F.col("index").cast("long").alias("index")
    )
    return folders.unionByName(files)


def keyed_objects(found: DataFrame, target: Policy) -> DataFrame:
    """Each object under each rule of a policy: rule, rule_no, certainty and key added."""
    parts = [
        names.comparison_path(found, "parts", rule.name).withColumns({"rule": F.lit(rule.name), "rule_no": F.lit(number), "certainty": F.lit(rule.certainty)})
        for number, rule in enumerate(target.rules)
    ]
    return reduce(DataFrame.unionByName, parts)


@F.pandas_udf(T.StringType())
def group_id(rule: pd.Series, key: pd.Series, entry_ids: pd.Series, node_ids: pd.Series) -> pd.Series:
    rows = zip(rule, key, entry_ids, node_ids)
    return pd.Series(["g" + hashlib.sha256(canonical([r, k, list(e), list(n)]).encode()).hexdigest() for r, k, e, n in rows], dtype=object)


def collision_groups(found: DataFrame, target: Policy) -> DataFrame:
    """Groups of two objects or more with one key under a rule of the policy.

    Columns: archive, rule, rule_no, certainty, key, impact, first_difference,
    originals, entry_ids, node_ids. Rules other than `exact` need two spellings;
    folding rules are left out for ASCII names where the policy has `ascii-case`,
    and `windows-trim` where nothing ends in a space or dot.
    """
    has_ascii_case = any(rule.name == "ascii-case" for rule in target.rules)
    spelled = F.col("originals")
    all_ascii = F.forall(spelled, lambda p: names.is_ascii(F.array_join(p, "/")))
    trimmed = F.exists(spelled, lambda p: F.exists(p, lambda c: c.rlike(r"[ .]\z")))
    shown = (
        (F.col("n_objects") >= 2)
        & ((F.col("rule") == "exact") | (F.size("originals") >= 2))
        & ~(F.col("rule").isin("casefold", "nfc-casefold") & F.lit(has_ascii_case) & all_ascii)
        & ((F.col("rule") != "windows-trim") | trimmed)
    )
    impact = F.when(F.size("kinds") > 1, "file-directory").when(F.array_contains("kinds", "directory"), "directory-merge").otherwise("file-overwrite")
    depth = F.size(spelled[0])
    differs = F.filter(F.sequence(F.lit(0), depth - 1), lambda k: F.size(F.array_distinct(F.transform(spelled, lambda p: F.get(p, k)))) > 1)
    return (
        keyed_objects(found, target)
        .groupBy("archive", "rule", "rule_no", "certainty", "key")
        .agg(
            F.count(F.lit(1)).alias("n_objects"),
            F.array_sort(F.collect_set("parts")).alias("originals"),
            F.collect_set("kind").alias("kinds"),
            F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("members"))))).alias("entry_ids"),
            F.array_sort(F.array_remove(F.collect_set("node_id"), "")).alias("node_ids"),
        )
        .where(shown)
        .select("archive", "rule", "rule_no", "certainty", "key", impact.alias("impact"), F.coalesce(F.get(differs, F.lit(0)), depth - 1).alias("first_difference"), "originals", "entry_ids", "node_ids")
    )


def within_budget(groups: DataFrame, found: DataFrame, target: Policy, limit: int) -> tuple[DataFrame, DataFrame]:
    """The groups that a report takes before their entry and node ids exceed `limit` in an archive, with `exceeded` added, and the archives that exceed it.

    Such an archive may be left without any group.

    Groups come rule by rule and, within a rule, parents before children and later
    first appearances before earlier ones. Archives within the limit, as good as all, skip the ordering.
    """
    size = F.size("entry_ids") + F.size("node_ids")
    groups = Table(groups, "all-groups").df
    totals = groups.groupBy("archive").agg(F.sum(size).alias("members"))
    over = Table(totals.where(F.col("members") > limit).select("archive"), "over").df
    if not over.limit(1).count():
        return groups.withColumn("exceeded", F.lit(False)), over
    simple = groups.join(over, "archive", "left_anti").withColumn("exceeded", F.lit(False))
    numbered = found.join(over, "archive", "left_semi").withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("archive").orderBy(F.col("kind") == "file", F.when(F.col("kind") == "directory", F.col("parts")), "index"))
    )
    keyed = keyed_objects(numbered, target).withColumn("key_parts", F.split("key", "/", -1))
    places = keyed.select("archive", "rule", "ordinal", F.explode(prefixes(F.col("key_parts"))).alias("prefix")).groupBy("archive", "rule", "prefix").agg((-F.min("ordinal")).alias("place"))
    steps = (
        groups.join(over, "archive", "left_semi")
        .select("archive", "rule", "key", F.posexplode(prefixes(F.split("key", "/", -1))).alias("depth", "prefix"))
        .join(places, ["archive", "rule", "prefix"])
        .groupBy("archive", "rule", "key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "place"))), lambda s: s["place"]).alias("order"))
    )
    before = Window.partitionBy("archive").orderBy("rule_no", "order").rowsBetween(Window.unboundedPreceding, 0)
    ordered = groups.join(steps, ["archive", "rule", "key"]).withColumn("running", F.sum(size).over(before))
    return simple.unionByName(ordered.where(F.col("running") <= limit).drop("order", "running").withColumn("exceeded", F.lit(True))), over
