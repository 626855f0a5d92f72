"""Logical directories of archive listings.

A listing has one row per entry: archive, entry_id, index, entry_type, parts
(array of name components; empty for entries that take no place in the tree).
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixes(parts: Column, depth: Column | None = None) -> Column:
    """All beginnings of a path, shortest first, up to a depth (its length if not given)."""
    last = F.size(parts) if depth is None else depth
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.slice(parts, 1, k))).otherwise(F.array().cast("array<array<string>>"))


def parent(parts: Column) -> Column:
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def logical_directories(entries: DataFrame) -> DataFrame:
    """One row per directory of an archive: archive, parts, owner_entry_id, owner_index, explicit_entry_ids, descendant_entry_ids.

    The owner is the first entry that needs the directory; an entry of type
    directory is explicit for its own path and a descendant of those above. Ids are listed in index order.
    """
    directory = F.col("entry_type") == "directory"
    depth = F.when(directory, F.size("parts")).otherwise(F.size("parts") - 1)
    members = entries.where(F.size("parts") > 0).select(
        "archive", "entry_id", "index", F.when(directory, F.size("parts")).otherwise(0).alias("own"), F.explode(prefixes(F.col("parts"), depth)).alias("parts")
    )
    member = F.struct("index", "entry_id")
    explicit = F.size("parts") == F.col("own")
    ids = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, member))), lambda m: m["entry_id"])
    return members.groupBy("archive", "parts").agg(
        F.min_by("entry_id", "index").alias("owner_entry_id"),
        F.min("index").alias("owner_index"),
        ids(explicit).alias("explicit_entry_ids"),
        ids(~explicit).alias("descendant_entry_ids"),
    )


def duplicate_directories(directories: DataFrame) -> DataFrame:
    """Directories that several entries describe."""
    return directories.where(F.size("explicit_entry_ids") > 1)


def canonical(value: object) -> str:
    """ASCII JSON with sorted keys and no blanks, the form that identities are hashed from."""
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def _identify(entries: pd.DataFrame, directories: pd.DataFrame) -> pd.DataFrame:
    """Ids of one archive's directories. They start from every entry's choice of name, hashed once for all of them."""
    entries = entries.sort_values("index")
    none = lambda v: v if isinstance(v, str) else None
    chosen = [[e, none(s), none(d)] for e, s, d in zip(entries.entry_id, entries.selected_candidate_id, entries.default_candidate_id)]
    shared = hashlib.sha256(('{"context":' + canonical(chosen)).encode())
    ids = {}
    for parts, owner in zip(directories.parts, directories.owner_index):
        state = shared.copy()
        state.update(f',"ownerIndex":{int(owner)},"sourceParts":{canonical(list(parts))}}}'.encode())
        ids[tuple(parts)] = "d" + state.hexdigest()
    directories = directories.astype(object)  # pandas' own string arrays may come in chunks, which Spark does not take
    nodes = pd.Series([ids[tuple(p)] for p in directories.parts], index=directories.index, dtype=object)
    parents = pd.Series([ids.get(tuple(p)[:-1]) for p in directories.parts], index=directories.index, dtype=object)
    return directories.assign(node_id=nodes, parent_id=parents)


def with_node_ids(directories: DataFrame, entries: DataFrame) -> DataFrame:
    """`directories` with node_id and parent_id; `entries` has selected_candidate_id and default_candidate_id beside the listing's columns."""
    kinds = {f.name: f.dataType.simpleString() for f in directories.schema.fields}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items()) + ", node_id string, parent_id string"
    choices = entries.select("archive", "entry_id", "index", "selected_candidate_id", "default_candidate_id")
    return choices.groupBy("archive").cogroup(directories.groupBy("archive")).applyInPandas(_identify, schema)


def implicit_directories(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """Directories (archive, path) above the files of `paths` (archive, parts) that `listed` (archive, path) does not name."""
    above = paths.select("archive", F.explode(prefixes(F.col("parts"), F.size("parts") - 1)).alias("parts")).select("archive", F.array_join("parts", "/").alias("path"))
    return above.distinct().join(listed.select("archive", "path"), ["archive", "path"], "left_anti")


def longest_mapped_ancestor(entries: DataFrame, mapped: DataFrame) -> DataFrame:
    """`entries` with the target of the deepest of their directories that `mapped` (archive, parts, target) names, or null, and its depth."""
    entry_id = ["archive", "entry_id"]
    above = entries.select(*entry_id, F.explode(prefixes(F.col("parts"))).alias("parts"))
    best = above.join(mapped.select("archive", "parts", "target"), ["archive", "parts"]).groupBy(*entry_id).agg(
        F.max_by("target", F.size("parts")).alias("ancestor_target"), F.max(F.size("parts")).cast("long").alias("ancestor_depth")
    )
    return entries.join(best, entry_id, "left")
