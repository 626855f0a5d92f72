"""Rename drafts: a deterministic proposal for every entry of an archive.

Names are given out in order, and each depends on those given before, so an archive
is one group; archives are drafted in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import components as C
from ..plans.policies import Options, Policy
from ..sources.wire import ENCRYPTION_FLAGS

ROW = "archive string, kind string, id string, action string, target_path string, candidate_id string, name_confirmed boolean, codes array<string>, entry_ids array<string>"


class _Folder:
    """The names taken under one target directory."""

    def __init__(self) -> None:
        self.taken: set[tuple[str, str]] = set()


class _Drafter:
    def __init__(self, target: Policy, options: Options):
        self.target, self.longest = target, options.limit("component_limit", target)
        self.rules = [rule.name for rule in target.enforced()]
        self.folders: dict[tuple[str, ...], _Folder] = defaultdict(_Folder)
        self.reserved: dict[tuple[str, ...], set[tuple[str, str]]] = defaultdict(set)

    def keys(self, name: str) -> set[tuple[str, str]]:
        return {(rule, C.key(name, rule)) for rule in self.rules}

    def reserve(self, source: tuple[str, ...]) -> None:
        """An original name that is fine as it is goes to its owner before any new spelling."""
        if C.cleaned(source[-1], self.target)[0] == source[-1] and C.measure(source[-1], self.target) <= self.longest:
            self.reserved[source[:-1]] |= self.keys(source[-1])

    def give(self, source: tuple[str, ...], owner: str, folder: tuple[str, ...]) -> tuple[str, tuple[str, ...]]:
        taken, reserved = self.folders[folder].taken, self.reserved[source[:-1]]
        clean, why = C.cleaned(source[-1], self.target)
        name, more = C.fitted_clean(clean, "", self.longest, self.target)
        why += more
        blocked = taken if name == source[-1] else taken | reserved
        tries = 0
        while self.keys(name) & blocked:
            tries += 1
            blocked = taken | reserved
            name, more = C.fitted_clean(clean, f"_{owner}" + (f"_{tries}" if tries > 1 else ""), self.longest, self.target)
        if tries:
            why += (*more, "NAME_COLLISION")
        taken |= self.keys(name)
        return name, tuple(dict.fromkeys(why))


def draft_archive(entries: list[dict], directories: list[dict], target: Policy, options: Options) -> list[tuple]:
    """Rows (kind, id, action, target_path, candidate_id, name_confirmed, codes, entry_ids) of one archive's draft."""
    entries = sorted(entries, key=lambda e: e["index"])
    usable = {e["entry_id"] for e in entries if e["name_state"] != "blocked" and len(e["parts"]) and e["method"] in (0, 8) and not e["flags"] & ENCRYPTION_FLAGS}
    folders = []
    for d in directories:
        members = {*d["explicit_entry_ids"], *d["descendant_entry_ids"]} & usable
        if members:
            folders.append((len(d["parts"]), d["owner_index"], tuple(d["parts"]), d, sorted(members)))
    folders.sort(key=lambda f: f[:3])
    drafter = _Drafter(target, options)
    for _, _, source, _, _ in folders:
        drafter.reserve(source)
    for e in entries:
        if e["entry_id"] in usable and e["entry_type"] == "file":
            drafter.reserve(tuple(e["parts"]))
    rows: list[tuple] = []
    note = lambda codes, ids: rows.append(("transform", None, None, None, None, None, list(codes), list(ids)))
    moved: dict[tuple[str, ...], tuple[str, ...]] = {(): ()}
    reasons: dict[tuple[str, ...], tuple[str, ...]] = {(): ()}
    for _, _, source, d, members in folders:
        above = moved.get(source[:-1], ())
        name, codes = drafter.give(source, d["owner_entry_id"], above)
        moved[source], reasons[source] = (*above, name), reasons.get(source[:-1], ()) + codes
        if codes:
            note(codes, members)
    for e in entries:
        own, sure = e["selected_candidate_id"], e["name_state"] in ("unambiguous", "selected")
        if e["entry_id"] not in usable:
            rows.append(("decision", e["entry_id"], "skip", None, own, sure, [], []))
            note(["SOURCE_BLOCKED"], [e["entry_id"]])
            continue
        source = tuple(e["parts"])
        if e["entry_type"] == "directory":
            path, codes = moved[source], reasons[source]
        else:
            above = moved.get(source[:-1], ())
            name, new = drafter.give(source, e["entry_id"], above)
            if new:
                note(new, [e["entry_id"]])
            path, codes = (*above, name), reasons.get(source[:-1], ()) + new
        if options.root_units and "PATH_LIMIT" in C.path_problems(path, e["entry_type"] == "directory", target, options):
            codes += ("PATH_LIMIT_EXPLICIT_MAPPING_REQUIRED",)
            note(codes[-1:], [e["entry_id"]])
        rows.append(("decision", e["entry_id"], "keep" if path == source else "rename", "/".join(path), own, sure, list(codes), []))
    for _, _, source, d, _ in sorted(folders, key=lambda f: f[3]["node_id"]):
        if moved[source] != source:
            rows.append(("directory", d["node_id"], None, "/".join(moved[source]), None, None, [], []))
    return rows


def records(frame: pd.DataFrame) -> list[dict]:
    """Rows as dicts, with nulls as None, arrays as lists and whole numbers as ints (pandas makes them floats beside nulls)."""

    def plain(v: object) -> object:
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return list(v)
        if v is None or v != v:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return [{k: plain(v) for k, v in row.items()} for row in frame.to_dict("records")]


def _draft(archive: tuple, entries: pd.DataFrame, directories: pd.DataFrame, *, target: Policy, options: Options) -> pd.DataFrame:
    rows = [(archive[0], *row) for row in draft_archive(records(entries), records(directories), target, options)]
    return pd.DataFrame(rows, columns=[part.split()[0] for part in ROW.split(", ")], dtype=object)


def suggest_plans(entries: DataFrame, directories: DataFrame, target: Policy, options: Options) -> DataFrame:
    """The draft of every archive: a row per decision, per changed directory and per transform (`kind` tells which).

    `entries` are entry reports, `directories` logical directories with node ids.
    """
    columns = ["archive", "entry_id", "index", "name_state", "entry_type", "parts", "method", "flags", "selected_candidate_id"]
    run = partial(_draft, target=target, options=options)
    wrapped = lambda key, left, right: run(key, left, right)  # noqa: E731  Spark counts a function's parameters
    return entries.select(*columns).groupBy("archive").cogroup(directories.groupBy("archive")).applyInPandas(wrapped, ROW)


def decisions(draft: DataFrame) -> DataFrame:
    return draft.where("kind = 'decision'").select("archive", F.col("id").alias("entry_id"), "action", "target_path", F.col("candidate_id").alias("encoding_candidate_id"), "name_confirmed")


def directory_mappings(draft: DataFrame) -> DataFrame:
    return draft.where("kind = 'directory'").select("archive", F.col("id").alias("node_id"), "target_path")
