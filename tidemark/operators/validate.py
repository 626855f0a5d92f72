"""Validation of rename plans. Nothing of a draft is trusted: entries are analysed anew with the plan's choices of names.

Every check of a plan is a generator of findings in a fixed order of phases, and
the first finding is the plan's error. Phases go through an archive in order, so an archive is one group.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import components as C
from ..plans.policies import ExtractLimits, Options, Policy, ScanLimits
from ..sources.wire import ENCRYPTION_FLAGS
from .draft import records
from .tree import canonical

Path = tuple[str, ...]
ROW = "archive string, plan_id string, error string, extractable boolean, resolved map<string,string>, diagnostics array<string>, advisories array<string>"
# Codes of an entry that keep a plan from being extracted, and the policy version that plans name.
NOT_EXTRACTABLE = ["UNKNOWN_CREATE_SYSTEM", "MISSING_DIRECTORY_METADATA", "ZERO_COMPRESSED_NONZERO_OUTPUT"]
POLICY_VERSION = "portability-v1"


@dataclass
class Case:
    """One archive with its plan."""

    entries: list[dict]  # entry reports, by index
    directories: list[dict]
    decisions: list[dict]
    mappings: list[dict]
    target: Policy
    options: Options
    limits: ScanLimits
    archive_id: str
    plan_archive_id: str
    usable: bool  # the report is complete
    resolved: dict[str, str] = field(default_factory=dict)
    placed: list[tuple[Path, dict]] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)
    advisories: list[str] = field(default_factory=list)
    extractable: bool = True
    moved: dict[Path, Path] = field(default_factory=dict)
    mapped: set[Path] = field(default_factory=set)
    trie_steps: int = 0

    def __post_init__(self) -> None:
        self.by_path = {tuple(d["parts"]): d for d in self.directories}
        self.decision = {d["entry_id"]: d for d in self.decisions}

    def mapped_above(self, path: Path, own: bool) -> Path | None:
        """The deepest mapped directory on the way to a path."""
        return next((path[:k] for k in range(len(path) - (not own), 0, -1) if path[:k] in self.mapped), None)


def _binding(case: Case) -> Iterator[str]:
    if not case.archive_id or case.plan_archive_id != case.archive_id:
        yield "ARCHIVE_ID_MISMATCH"
    if len(case.decision) != len(case.decisions) or set(case.decision) != {e["entry_id"] for e in case.entries}:
        yield "DECISIONS_MUST_COVER_EVERY_ENTRY_ONCE"
    if not case.usable:
        yield "INCOMPLETE_OR_INVALID_INDEX"


def _directories(case: Case) -> Iterator[str]:
    of_node = {d["node_id"]: tuple(d["parts"]) for d in case.directories}
    wanted: dict[Path, Path] = {}
    for mapping in case.mappings:
        source = of_node.get(mapping["node_id"])
        if source is None or source in wanted:
            yield "UNKNOWN_OR_DUPLICATE_DIRECTORY_NODE"
        parts = C.target_parts(mapping["target_path"])
        if len(parts) > case.limits.depth or C.unsafe(parts, True, case.target, case.options):
            yield "UNSAFE_DIRECTORY_TARGET"
        wanted[source] = parts
    case.mapped = set(wanted)
    for source in sorted(case.by_path, key=lambda p: (len(p), case.by_path[p]["node_id"])):
        inherited = (*case.moved.get(source[:-1], ()), source[-1])
        case.moved[source] = wanted.get(source, inherited)
        above = case.mapped_above(source, own=False)
        if source in wanted and above:
            base = case.moved[above]
            if case.moved[source][: len(base)] != base or len(case.moved[source]) <= len(base):
                yield "DIRECTORY_MAPPING_CONFLICT"


def _entries(case: Case) -> Iterator[str]:
    explicit: dict[Path, Path] = {}
    for entry in case.entries:
        decision, codes, source = case.decision[entry["entry_id"]], entry["codes"], tuple(entry["parts"])
        if "INVALID_CANDIDATE_CHOICE" in codes:
            yield "INVALID_CANDIDATE_CHOICE"
        if decision["action"] == "skip":
            case.diagnostics.append("ENTRY_SKIPPED")
            continue
        directory = entry["entry_type"] == "directory"
        if entry["name_state"] == "blocked" or entry["entry_type"] not in ("file", "directory"):
            yield "SOURCE_ENTRY_BLOCKED"
        if entry["flags"] & ENCRYPTION_FLAGS:
            yield "ENCRYPTED_ENTRY_MUST_SKIP"
        against = ["SOURCE_METHOD_OR_ENCRYPTION_UNSUPPORTED"] * (entry["method"] not in (0, 8)) + [code for code in NOT_EXTRACTABLE if code in codes]
        case.diagnostics += against
        case.extractable &= not against
        if "ENCODING_AMBIGUOUS" in codes and decision["encoding_candidate_id"] is None and not decision["name_confirmed"]:
            yield "ENCODING_CONFIRMATION_REQUIRED"
        path = C.target_parts(decision["target_path"])
        if len(path) > case.limits.depth:
            yield "TARGET_DEPTH_LIMIT"
        if C.unsafe(path, directory, case.target, case.options):
            yield "UNSAFE_TARGET_PATH"
        case.diagnostics += C.target_warnings(decision["target_path"])
        if decision["action"] == "keep" and path != source:
            yield "KEEP_TARGET_CHANGED"
        folder = source if directory else source[:-1]
        if case.mapped_above(folder, own=True):
            if (path if directory else path[:-1]) != case.moved[folder]:
                yield "DIRECTORY_ENTRY_MAPPING_CONFLICT"
        if directory and explicit.setdefault(source, path) != path:
            yield "DUPLICATE_DIRECTORY_MAPPING_CONFLICT"
        case.resolved[entry["entry_id"]] = decision["target_path"]
        case.placed.append((path, entry))
        if entry["entry_type"] == "file" and int(entry["declared_bytes"]) > ExtractLimits().file_bytes:
            case.extractable = False
            case.diagnostics.append("DECLARED_FILE_LIMIT")
    hard = ExtractLimits()
    files = [e for _, e in case.placed if e["entry_type"] == "file"]
    folders = {path[:k] for path, e in case.placed for k in range(1, len(path) + (e["entry_type"] == "directory"))}
    total = sum(int(e["declared_bytes"]) for e in files)
    over = [code for code, is_over in (("TARGET_FILE_COUNT_LIMIT", len(files) > hard.files), ("TARGET_DIRECTORY_COUNT_LIMIT", len(folders) > hard.directories), ("DECLARED_TOTAL_LIMIT", total > hard.total_bytes)) if is_over]
    case.diagnostics += over
    case.extractable &= not over
    for path, entry in case.placed:
        source = tuple(entry["parts"])
        for k in range(1, len(source) + (entry["entry_type"] == "directory")):
            base = explicit.get(source[:k])
            if base and (path[: len(base)] != base or (k < len(source) and len(path) <= len(base))):
                yield "DIRECTORY_ENTRY_MAPPING_CONFLICT"


def _origin(case: Case, path: Path, entry: dict, depth: int) -> object:
    """What a directory on the way to a target stands for: the source directory as far above the leaf, or else the target path."""
    source = tuple(entry["parts"])
    same = source[: max(0, depth - len(path) + len(source))]
    return case.by_path[same]["node_id"] if same in case.by_path else path[:depth]


def _collisions(case: Case) -> Iterator[str]:
    """Walks every target through one table per enforced rule, keyed by the beginnings of comparison paths."""
    rules = [rule.name for rule in case.target.enforced()]
    spelling: dict[tuple, str] = {}
    files: set[tuple] = set()
    folders: dict[tuple, object] = {}
    for path, entry in case.placed:
        for rule in rules:
            place: tuple = (rule,)
            for depth, part in enumerate(path, 1):
                if place in files:
                    yield "TARGET_FILE_DIRECTORY_COLLISION"
                place = (*place, C.key(part, rule))
                if spelling.setdefault(place, part) != part:
                    yield "TARGET_COMPARISON_COLLISION"
                if depth == len(path) and entry["entry_type"] == "file":
                    if place in files or place in folders:
                        yield "TARGET_FILE_DIRECTORY_COLLISION"
                    files.add(place)
                else:
                    if place in files:
                        yield "TARGET_FILE_DIRECTORY_COLLISION"
                    origin = _origin(case, path, entry, depth)
                    if folders.setdefault(place, origin) != origin:
                        yield "TARGET_DIRECTORY_MERGE"
                case.trie_steps += 1
                if case.trie_steps > case.limits.group_members * case.limits.depth:
                    yield "TARGET_TRIE_LIMIT"


def _advise(case: Case) -> Iterator[str]:
    for rule in (rule.name for rule in case.target.rules if rule.certainty == "advisory"):
        spellings: dict[Path, set[Path]] = {}
        members: dict[Path, set[str]] = {}
        for path, entry in case.placed:
            for k in range(1, len(path) + 1):
                place = tuple(C.key(p, rule) for p in path[:k])
                spellings.setdefault(place, set()).add(path[:k])
                members.setdefault(place, set()).add(entry["entry_id"])
        for place in sorted(spellings):
            if len(spellings[place]) > 1:
                case.advisories.append("TARGET_COMPARISON_ADVISORY")
                case.trie_steps += len(members[place])
                if case.trie_steps > case.limits.group_members * case.limits.depth:
                    yield "TARGET_TRIE_LIMIT"
    if any(rule.certainty == "approximation" for rule in case.target.rules):
        case.advisories.append("PROFILE_COMPARISON_APPROXIMATION")


def plan_id(case: Case) -> str:
    """Hash of what a plan does; its diagnostics are no part of it."""
    options = case.options
    text = lambda n: None if n is None else str(n)
    order = [e["entry_id"] for e in case.entries]
    value = {
        "schemaVersion": 1,
        "archiveId": case.archive_id,
        "profileId": case.target.profile_id,
        "profileVersion": POLICY_VERSION,
        "unicodeVersion": unicodedata.unidata_version,
        "targetOptions": {
            "rootUnits": text(options.root_units),
            "componentLimit": options.component_limit,
            "pathLimit": options.path_limit,
            "directoryPathLimit": options.directory_path_limit,
            "unicodeVersion": options.unicode_version,
        },
        "decisions": [
            {
                "entryId": d["entry_id"],
                "action": d["action"],
                "targetPath": d["target_path"],
                "encodingCandidateId": d["encoding_candidate_id"],
                "nameConfirmed": bool(d["name_confirmed"]),
                "reason": d.get("reason"),
            }
            for d in (case.decision[e] for e in order)
        ],
        "directoryMappings": [{"nodeId": m["node_id"], "targetPath": m["target_path"]} for m in sorted(case.mappings, key=lambda m: m["node_id"])],
        "resolvedPaths": case.resolved,
        "extractable": case.extractable,
    }
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def validate_case(case: Case) -> str | None:
    """The first error of a plan, or None; the case then holds what the plan resolves to."""
    case.entries.sort(key=lambda e: e["index"])
    if not case.options.root_units:
        case.extractable = False
        case.diagnostics.append("PATH_ROOT_UNKNOWN")
    for phase in (_binding, _directories, _entries, _collisions, _advise):
        try:
            error = next(phase(case), None)
        except ValueError as wrong:
            return str(wrong) if str(wrong).isupper() else "INVALID_MAPPING_INPUT"
        if error:
            return error
    return None


def _validate(key: tuple, plan: pd.DataFrame, report: pd.DataFrame, *, target: Policy, options: Options, limits: ScanLimits) -> pd.DataFrame:
    plans, reports = records(plan), records(report)
    of = lambda rows, kind: [r for r in rows if r["part"] == kind]
    head = of(reports, "archive")
    case = Case(
        of(reports, "entry"), of(reports, "directory"), of(plans, "decision"), of(plans, "mapping"), target, options, limits,
        head[0]["archive_id"] if head else "", plans[0]["plan_archive_id"] if plans else "", bool(head and head[0]["complete"]),
    )
    error = validate_case(case)
    done = (plan_id(case), None, case.extractable, case.resolved, case.diagnostics, case.advisories) if error is None else (None, error, False, {}, [], [])
    return pd.DataFrame([(key[0], *done)], columns=[part.split(" ")[0] for part in ROW.split(", ")], dtype=object)


def validate_plans(summary: DataFrame, entries: DataFrame, directories: DataFrame, decisions: DataFrame, mappings: DataFrame, target: Policy, options: Options, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """One row per archive with a plan: archive, plan_id, error, extractable, resolved, diagnostics, advisories.

    `summary`, `entries` and `directories` are a report made with the plan's choices of names;
    `decisions` has plan_archive_id, entry_id, action, target_path, encoding_candidate_id and name_confirmed, `mappings` plan_archive_id, node_id and target_path.
    """
    options.checked(target)
    tagged = lambda df, part: df.withColumn("part", F.lit(part))
    plan = tagged(decisions, "decision").unionByName(tagged(mappings, "mapping"), allowMissingColumns=True)
    wanted = ["archive", "entry_id", "index", "name_state", "entry_type", "parts", "codes", "flags", "method", F.col("declared_bytes").cast("string").alias("declared_bytes")]
    report = (
        tagged(summary.select("archive", "archive_id", "complete"), "archive")
        .unionByName(tagged(entries.select(*wanted), "entry"), allowMissingColumns=True)
        .unionByName(tagged(directories.select("archive", "parts", "node_id"), "directory"), allowMissingColumns=True)
    )
    run = partial(_validate, target=target, options=options, limits=limits)
    wrapped = lambda key, left, right: run(key, left, right)
    with_plan = report.join(plan.select("archive").distinct(), "archive", "left_semi")
    return plan.groupBy("archive").cogroup(with_plan.groupBy("archive")).applyInPandas(wrapped, ROW)


def imported_plan_differs(imported: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Archives whose imported plan (plan_id, extractable, resolved) is not what its decisions give."""
    other = rebuilt.select("archive", F.col("plan_id").alias("b_id"), F.col("extractable").alias("b_extractable"), F.map_entries("resolved").alias("b_resolved"))
    same = F.col("plan_id").eqNullSafe(F.col("b_id")) & F.col("extractable").eqNullSafe(F.col("b_extractable")) & F.array_sort(F.map_entries("resolved")).eqNullSafe(F.array_sort("b_resolved"))
    return imported.join(other, "archive").where(~same).select("archive", F.lit("IMPORTED_PLAN_DERIVATION_MISMATCH").alias("error"))
