"""Entry reports: what an archive's names mean for a delivery target.

Everything is a column of the entry's own row until directories and collision
groups, which group by archive. `entries` is what the ZIP source gives, with
`candidates`; `choices` (archive, entry_id, candidate_id) are a user's readings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans.policies import Options, Policy, ScanLimits
from ..shared import Table
from . import collisions, tree

KEY = ["archive", "entry_id"]


def with_choice(entries: DataFrame, choices: DataFrame | None) -> DataFrame:
    """`entries` with the user's candidate_id, or null (a left join)."""
    if choices is None:
        return entries.withColumn("chosen", F.lit(None).cast("string"))
    return entries.join(choices.select(*KEY, F.col("candidate_id").alias("chosen")), KEY, "left")


def unknown_choices(entries: DataFrame, choices: DataFrame) -> DataFrame:
    """Choices for entries that are not there (an anti join)."""
    return choices.join(entries.select(*KEY), KEY, "left_anti")


def name_state(selected: Column, text: Column, certainty: Column) -> Column:
    sure = (certainty == "config_rule") | names.is_ascii(text)
    return F.when(selected, "selected").when(F.coalesce(sure, F.lit(False)), "unambiguous").otherwise("ambiguous")


def entry_reports(entries: DataFrame, target: Policy, options: Options, choices: DataFrame | None = None, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """`entries` with selected_candidate_id, default_candidate_id, display_name, source, name_state, entry_type, parts, component_units, path_units and codes."""
    options.checked(target)
    valid = F.filter("candidates", lambda c: c["valid"])
    picked = F.filter(valid, lambda c: c["candidate_id"] == F.col("chosen"))
    wrong_choice = F.col("chosen").isNotNull() & (F.size(picked) == 0)
    df = with_choice(entries, choices)
    df = df.withColumn("selected", F.get(picked, F.lit(0))).withColumn("shown", F.coalesce("selected", F.get(valid, F.lit(0)))).withColumn("text", F.col("shown.text"))
    kind, type_codes = names.entry_type(F.col("text"), F.col("create_system"), F.col("external_attr"))
    state = name_state(F.col("selected").isNotNull(), F.col("text"), F.col("shown.certainty"))
    from_candidates = F.flatten(
        F.transform(
            "candidates",
            lambda c: F.concat(
                F.when(c["valid"], F.array().cast("array<string>")).otherwise(F.filter(c["evidence"], lambda e: ~F.startswith(e, F.lit("EXTRA_")) | (e == "EXTRA_TRUNCATED"))),
                F.when(c["text"].isNull(), F.array().cast("array<string>")).otherwise(F.array_intersect(names.path_evidence(c["text"]), F.array(*map(F.lit, names.BLOCKING)))),
            ),
        )
    )
    empty = F.array().cast("array<string>")
    df = df.withColumn("name_state", state).withColumn("entry_type", kind)
    split = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(F.when(F.col("entry_type") == "directory", F.left("text", F.length("text") - 1)).otherwise(F.col("text")), "/", -1))
    df = df.withColumn("parts", F.coalesce(split, empty)).withColumn("too_deep", F.size("parts") > limits.depth)
    evidence = F.concat(
        names.codes(("INVALID_CANDIDATE_CHOICE", wrong_choice), ("ENCODING_AMBIGUOUS", F.col("name_state") == "ambiguous")),
        from_candidates,
        F.when(F.col("text").isNull(), empty).otherwise(names.path_evidence(F.col("text"))),
        type_codes,
        names.codes(("DEPTH_LIMIT", F.col("too_deep"))),
    )
    df = df.withColumn("codes", evidence)
    has = lambda *wanted: F.arrays_overlap("codes", F.array(*map(F.lit, wanted)))
    blocked = has(*names.BLOCKING, "INVALID_CANDIDATE_CHOICE") | F.col("shown").isNull() | F.col("entry_type").isin("symlink", "special", "contradictory")
    odd = has("BACKSLASH_PATH", "NONSTANDARD_COMPONENT")
    df = df.withColumn("name_state", F.when(blocked, "blocked").when(odd | has("MISSING_DIRECTORY_METADATA"), "nonstandard").otherwise(F.col("name_state")))
    df = df.withColumn("parts", F.when(blocked | odd | F.col("too_deep"), empty).otherwise(F.col("parts")))
    checked = F.when(F.size("parts") > 0, names.check_path(F.col("parts"), F.col("entry_type") == "directory", target, options)).otherwise(empty)
    size_code = names.size_risk(F.col("declared_bytes"), F.col("compressed_bytes"))
    df = df.withColumn("codes", F.array_distinct(F.concat("codes", checked, F.array_compact(F.array(size_code)))))
    in_root = F.lit(options.root_units) + names.measure(F.array_join("parts", "/"), target)
    default = F.get(F.filter("candidates", lambda c: c["valid"] & (c["text"] == F.col("text"))), F.lit(0))
    return df.select(
        *entries.columns,
        F.col("selected.candidate_id").alias("selected_candidate_id"),
        default["candidate_id"].alias("default_candidate_id"),
        F.col("text").alias("display_name"),
        F.col("shown.source").alias("source"),
        "name_state",
        "entry_type",
        "parts",
        F.transform("parts", lambda p: names.measure(p, target)).alias("component_units"),
        F.when(F.lit(bool(options.root_units)) & (F.size("parts") > 0), in_root).alias("path_units"),
        "codes",
    )


def diagnostics(reports: DataFrame) -> DataFrame:
    """One row per code of an entry, in order: archive, entry_id, place, code, severity, certainty, details."""
    found = reports.select(*KEY, "source", F.posexplode("codes").alias("place", "code"))
    text = F.lit("Windows separator / POSIX literal; explicit mapping required")
    details = F.when(F.col("code") == "BACKSLASH_PATH", F.create_map(F.lit("source"), F.coalesce("source", F.lit("raw")), F.lit("pathInterpretation"), text))
    return found.select(*KEY, "place", "code", names.severity(F.col("code")).alias("severity"), names.certainty(F.col("code")).alias("certainty"), details.alias("details"))


@dataclass
class Report:
    """The tables of a report; `summary` has one row per archive, also of archives without entries, `over` the archives beyond the group budget."""

    entries: DataFrame
    diagnostics: DataFrame
    directories: DataFrame
    groups: DataFrame
    summary: DataFrame
    over: DataFrame


def inspect(archives: DataFrame, entries: DataFrame, target: Policy, options: Options, choices: DataFrame | None = None, limits: ScanLimits = ScanLimits()) -> Report:
    """The report of every archive. `archives` has archive, archive_id, state and scan_diagnostics (array of structs with code)."""
    reports = Table(entry_reports(entries, target, options, choices, limits), "reports").df
    directories = Table(tree.with_node_ids(tree.logical_directories(reports), reports), "directories").df
    found = collisions.objects(reports, directories)
    groups, beyond = collisions.within_budget(collisions.collision_groups(found, target), found, target, limits.group_members)
    groups = Table(groups, "groups").df.withColumn("group_id", collisions.group_id("rule", "key", "entry_ids", "node_ids")).withColumn("comparison_key", F.col("key"))
    coded = diagnostics(reports)
    per = lambda df, *aggs: df.groupBy("archive").agg(*aggs)
    counts = (
        archives.select("archive", "archive_id", "state", F.size("scan_diagnostics").alias("n_scan"))
        .join(per(reports, F.count(F.lit(1)).alias("entries"), F.bool_or(F.array_contains("codes", "DEPTH_LIMIT")).alias("deep"), F.sum(F.size("codes")).alias("n_codes")), "archive", "left")
        .join(per(directories, F.count(F.lit(1)).alias("directories"), F.sum((F.size("explicit_entry_ids") > 1).cast("int")).alias("n_doubled")), "archive", "left")
        .join(per(groups, F.count(F.lit(1)).alias("groups")), "archive", "left")
        .join(beyond.withColumn("over", F.lit(True)), "archive", "left")
    )
    if choices is not None:
        counts = counts.join(per(unknown_choices(entries, choices), F.lit(True).alias("unknown")), "archive", "left")
    else:
        counts = counts.withColumn("unknown", F.lit(False))
    zero = lambda name: F.coalesce(name, F.lit(0))
    limited = F.coalesce("deep", F.lit(False)) | F.coalesce("over", F.lit(False))
    anything = (zero("n_scan") + zero("n_codes") + zero("n_doubled") + zero("groups") > 0) | F.lit(not options.root_units)
    state = F.when(limited, "incomplete").when(F.coalesce("unknown", F.lit(False)), "invalid").when((F.col("state") == "ok") & anything, "findings").otherwise(F.col("state"))
    summary = counts.select(
        "archive",
        "archive_id",
        (F.col("state").isin("ok", "findings", "unsupported") & ~limited).alias("complete"),
        state.alias("state"),
        zero("entries").alias("entries"),
        zero("directories").alias("directories"),
        zero("groups").alias("collision_groups"),
    )
    return Report(reports, coded, directories, groups, summary, beyond)


def scan_exit(complete: Column, state: Column, findings: Column) -> Column:
    """Exit code of a report: 0 clean, 1 with findings, 2 invalid, 3 incomplete or not supported."""
    return F.when(state.isin("incomplete", "unsupported", "stale"), 3).when(state == "invalid", 2).when(~complete, 3).otherwise(findings.cast("int"))


def report_page(reports: DataFrame, members: DataFrame, *, text: str = "", risk: str = "all", kind: str = "all", colliding: bool | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of a report's entries: those whose id, name, target or codes hold a text, with any code or in a name state (`risk`), of a type, in a collision group or not.

    `members` has archive and entry_id of the entries in collision groups. A page is the result itself, so its size is a limit by design.
    """
    searched = [c for c in ("entry_id", "display_name", "target_path") if c in reports.columns]
    found = reports.where(F.contains(F.lower(F.concat_ws(" ", *searched, F.array_join("codes", " "))), F.lit(text.lower())))
    if risk != "all":
        found = found.where(F.size("codes") > 0 if risk == "findings" else F.col("name_state") == risk)
    if kind != "all":
        found = found.where(F.col("entry_type") == kind)
    if colliding is not None:
        found = found.join(members.select(*KEY).distinct(), KEY, "left_semi" if colliding else "left_anti")
    return found.orderBy("archive", "index").offset(page * size).limit(size)
