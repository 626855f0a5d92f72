"""Reports as JSON documents, one per archive."""

from __future__ import annotations

import json
import platform
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.policies import Options, Policy, ScanLimits
from ..sources import documents
from .analysis import Report


def _named(**columns: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _base64(column: str) -> Column:
    """Base64 in one line; the expression alone may break lines, as the session is set."""
    return F.translate(F.base64(column), "\r\n", "")


def _listed(rows: DataFrame, name: str, item: Column, *order: Column | str) -> DataFrame:
    """One JSON list per archive, in order."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"key{n}") for n, o in enumerate(order)]
    sorted_items = F.array_sort(F.collect_list(F.struct(*keys, _json(item).alias("item"))))
    return rows.groupBy("archive").agg(F.concat(F.lit("["), F.array_join(F.transform(sorted_items, lambda i: i["item"]), ","), F.lit("]")).alias(name))


def _entries(reports: DataFrame) -> DataFrame:
    raw = _named(
        entryId="entry_id", index="index", centralOffset=F.col("central_offset").cast("string"), rawNameBase64=_base64("raw_name"), rawExtraBase64=_base64("raw_extra"), flags="flags", method="method",
        crc32="crc32", compressedBytes=F.col("compressed_bytes").cast("string"), declaredBytes=F.col("declared_bytes").cast("string"), localOffset=F.col("local_offset").cast("string"),
        createSystem="create_system", externalAttr="external_attr",
    )
    readings = F.transform(
        "candidates",
        lambda c: _named(candidateId=c["candidate_id"], text=c["text"], source=c["source"], valid=c["valid"], evidence=c["evidence"], certainty=c["certainty"]),
    )
    entry = _named(
        entryId="entry_id", index="index", raw=raw, candidates=readings, selectedCandidateId="selected_candidate_id", defaultDisplayName="display_name", nameState="name_state", entryType="entry_type",
        sourceParts="parts", componentUnits="component_units", pathUnits=F.col("path_units").cast("string"), diagnosticIds="codes",
    )
    return _listed(reports, "entries", entry, "index")


def _folders(directories: DataFrame) -> DataFrame:
    folder = _named(nodeId="node_id", sourceParts="parts", ownerEntryId="owner_entry_id", parentNodeId="parent_id", descendantEntryIds="descendant_entry_ids", explicitEntryIds="explicit_entry_ids")
    return _listed(directories, "logicalDirectories", folder, F.size("parts"), "parts")


def _groups(groups: DataFrame) -> DataFrame:
    spelled = F.transform("originals", lambda p: F.array_join(p, "/"))
    group = _named(
        groupId="group_id", ruleId="rule", entryIds="entry_ids", nodeIds="node_ids", originalKeys=spelled, comparisonKey="comparison_key", firstDifferentComponent="first_difference", impact="impact",
        certainty="certainty",
    )
    return _listed(groups, "collisionGroups", group, "rule_no", "comparison_key")


def _diagnostics(scans: DataFrame, report: Report) -> DataFrame:
    """Those of the scan, of entries, of directories with several records and of the group budget, in this order."""
    none = F.create_map().cast("map<string,string>")
    ids = lambda column: F.when(column.isNull(), F.array().cast("array<string>")).otherwise(F.array(column))
    found = F.posexplode("scan_diagnostics").alias("place", "d")
    scanned = scans.select("archive", F.lit(0).alias("phase"), F.lit("").alias("owner"), found).select("archive", "phase", "owner", "place", "d.code", "d.severity", "d.certainty", ids(F.col("d.entry_id")).alias("entry_ids"), none.alias("details"))
    entries = report.diagnostics.select("archive", F.lit(1).alias("phase"), F.col("entry_id").alias("owner"), "place", "code", "severity", "certainty", F.array("entry_id").alias("entry_ids"), F.coalesce("details", none).alias("details"))
    doubled = report.directories.where(F.size("explicit_entry_ids") > 1).select(
        "archive", F.lit(2).alias("phase"), F.array_join("parts", "/").alias("owner"), F.lit(0).alias("place"), F.lit("DUPLICATE_DIRECTORY_METADATA").alias("code"), F.lit("info").alias("severity"),
        F.lit("advisory").alias("certainty"), F.col("explicit_entry_ids").alias("entry_ids"), F.create_map(F.lit("nodeId"), "node_id").alias("details"),
    )
    over = report.over.select(
        "archive", F.lit(3).alias("phase"), F.lit("").alias("owner"), F.lit(0).alias("place"), F.lit("GROUP_MEMBER_LIMIT").alias("code"), F.lit("error").alias("severity"), F.lit("config_rule").alias("certainty"),
        F.array().cast("array<string>").alias("entry_ids"), none.alias("details"),
    )
    rows = reduce(DataFrame.unionByName, (scanned, entries, doubled, over))
    return _listed(rows, "diagnostics", _named(code="code", severity="severity", entryIds="entry_ids", details="details", certainty="certainty"), "phase", "owner", "place")


def report_documents(scans: DataFrame, report: Report, target: Policy, options: Options, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """archive and document, its report as JSON that `load_report` takes, for each archive.

    An archive is the grain: its lists are made in one row, which the scan's limits bound.

    Defined cases: an archive without entries has empty lists; an archive that is no ZIP file
    has an empty archive id. `report` is an inspection without choices of readings.
    """
    size = lambda n: str(n)  # noqa: E731  sizes are strings
    fixed = {
        "schemaVersion": 1, "contentVerified": False, "localHeadersVerified": False, "transformations": [], "profile": documents.profile_document(target),
        "runtime": {"python": platform.python_version(), "spark": scans.sparkSession.version, "unicode": unicodedata.unidata_version},
        "options": documents.options_document(options),
        "limits": {
            "archiveBytes": size(limits.archive_bytes), "centralBytes": size(limits.central_bytes), "entries": limits.entries, "nameBytes": size(limits.name_bytes), "depth": limits.depth,
            "groupMembers": limits.group_members, "planBytes": size(limits.plan_bytes), "exportBytes": size(documents.EXPORT_BYTES), "seconds": 30,
        },
    }
    counts = _named(entries="entries", directories="directories", collisionGroups="collision_groups")
    head = report.summary.select("archive", _json(_named(archiveId=F.coalesce("archive_id", F.lit("")), complete="complete", state="state", summary=counts)).alias("head"))
    lists = [_entries(report.entries), _folders(report.directories), _groups(report.groups), _diagnostics(scans, report)]
    rows = reduce(lambda left, right: left.join(right, "archive", "left"), lists, head)
    named = [F.concat(F.lit(f',"{name}":'), F.coalesce(name, F.lit("[]"))) for name in ("entries", "logicalDirectories", "collisionGroups", "diagnostics")]
    opened = F.expr("substring(head, 1, length(head) - 1)")
    return rows.select("archive", F.concat(opened, *named, F.lit("," + json.dumps(fixed)[1:])).alias("document"))
