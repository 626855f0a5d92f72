"""Collisions among the target paths of a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans.policies import Policy
from .tree import prefixes


def keyed_prefixes(resolved: DataFrame, target: Policy, enforced: bool) -> DataFrame:
    """Every beginning of every target path with its comparison key under each enforced (or each advisory) rule.

    `resolved` has archive, entry_id, entry_type, target and source (arrays of components).
    """
    leaf = F.col("depth") == F.size("target")
    shift = F.size("target") - F.size("source")
    below = resolved.select("archive", "entry_id", "entry_type", "target", "source", F.posexplode(prefixes(F.col("target"))).alias("at", "prefix")).withColumn("depth", F.col("at") + 1)
    # A directory on the way is the source's own if it lies as deep below the leaf there as here.
    origin = F.when(F.col("depth") - shift > 0, F.concat(F.lit("s/"), F.array_join(F.slice("source", 1, F.greatest(F.col("depth") - shift, F.lit(1))), "/"))).otherwise(F.concat(F.lit("t/"), F.array_join("prefix", "/")))
    marked = below.select("archive", "entry_id", "prefix", "depth", (leaf & (F.col("entry_type") == "file")).alias("is_file"), origin.alias("origin"))
    rules = [rule for rule in target.rules if (rule.certainty != "advisory") == enforced]
    parts = [names.comparison_path(marked, "prefix", rule.name).withColumn("rule", F.lit(rule.name)) for rule in rules]
    return reduce(DataFrame.unionByName, parts) if parts else marked.withColumns({"key": F.lit(""), "rule": F.lit("")}).where("false")


def target_collisions(resolved: DataFrame, target: Policy) -> DataFrame:
    """Groups of target paths that the target's enforced rules confuse: archive, rule, key, code, members.

    Different spellings of one key, a file where there is a directory or another file, or directories of different sources that become one.
    """
    grouped = keyed_prefixes(resolved, target, enforced=True).groupBy("archive", "rule", "key").agg(
        F.size(F.collect_set("prefix")).alias("spellings"),
        F.sum(F.col("is_file").cast("int")).alias("files"),
        F.size(F.collect_set(F.when(~F.col("is_file"), F.col("origin")))).alias("origins"),
        F.array_sort(F.collect_set("entry_id")).alias("members"),
    )
    code = (
        F.when(F.col("spellings") > 1, "TARGET_COMPARISON_COLLISION")
        .when((F.col("files") > 1) | ((F.col("files") == 1) & (F.col("origins") > 0)), "TARGET_FILE_DIRECTORY_COLLISION")
        .when(F.col("origins") > 1, "TARGET_DIRECTORY_MERGE")
    )
    return grouped.select("archive", "rule", "key", code.alias("code"), "members").where("code IS NOT NULL")


def target_advisories(resolved: DataFrame, target: Policy) -> DataFrame:
    """Groups of target paths with several spellings under a rule that only advises: archive, rule, key, members."""
    grouped = keyed_prefixes(resolved, target, enforced=False).groupBy("archive", "rule", "key").agg(F.size(F.collect_set("prefix")).alias("spellings"), F.array_sort(F.collect_set("entry_id")).alias("members"))
    return grouped.where("spellings > 1").drop("spellings")
