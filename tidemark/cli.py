"""Command line: inspect archives, validate a plan, extract it, show a demonstration, print a document's schema.

Exit codes: 0 clean, 1 findings, 2 invalid, 3 incomplete, unsupported or stopped by a limit.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Preflight
from .operators import analysis
from .plans.policies import ALIASES, POLICIES, ExtractLimits, Options, policy, root_units
from .sources import documents, synthetic

_LIMITS = {"PLAN_INPUT_LIMIT", "EXPORT_LIMIT", "TARGET_DEPTH_LIMIT", "TARGET_TRIE_LIMIT"}


def visible(text: str) -> str:
    """Text with everything but printable ASCII escaped."""
    return text.encode("unicode_escape").decode("ascii")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inspect", "validate-plan", "extract"):
        command = commands.add_parser(name)
        command.add_argument("zip")
        if name == "inspect":
            command.add_argument("--target", required=True, choices=[*ALIASES, *POLICIES])
            command.add_argument("--target-root")
            command.add_argument("--plan", help="where to write the draft")
            command.add_argument("--report", help="where to write the report")
        else:
            command.add_argument("plan")
        if name == "extract":
            command.add_argument("--accept-plan", required=True)
            command.add_argument("--output", required=True)
            command.add_argument("--seconds", type=float, default=60.0)
    demo = commands.add_parser("demo")
    demo.add_argument("--target", default="windows", choices=[*ALIASES, *POLICIES])
    demo.add_argument("--output", required=True, help="a folder to be made")
    commands.add_parser("schema").add_argument("document", choices=sorted(documents.SHAPES))
    return parser


def _plan_tables(spark: SparkSession, plan: dict, archive: str) -> tuple[DataFrame, DataFrame]:
    decisions = [(archive, plan["archiveId"], d["entryId"], d["action"], d["targetPath"], d["encodingCandidateId"], d["nameConfirmed"], d["reason"]) for d in plan["decisions"]]
    folders = [(archive, plan["archiveId"], m["nodeId"], m["targetPath"]) for m in plan.get("directoryMappings", [])]
    schema = "archive string, plan_archive_id string, entry_id string, action string, target_path string, encoding_candidate_id string, name_confirmed boolean, reason string"
    return spark.createDataFrame(decisions, schema), spark.createDataFrame(folders, "archive string, plan_archive_id string, node_id string, target_path string")


def _write_report(flight: Preflight, report: analysis.Report, path: str, inputs: tuple[str, ...]) -> None:
    document = flight.report_documents(report).first().document
    documents.load_report(document)
    documents.write_new(path, documents.dump(json.loads(document)), inputs=inputs)


def _inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    target = policy(args.target)
    options = Options(root_units=root_units(args.target_root, target) if args.target_root else 0)
    flight = Preflight.of_path(spark, args.zip, args.target, options)
    report = flight.inspect()
    for row in report.diagnostics.select("code").distinct().orderBy("code").collect():
        print(visible(row.code), file=sys.stderr)
    found = report.summary.withColumn("exit", analysis.scan_exit(F.col("complete"), F.col("state"), F.col("state") != "ok")).collect()
    for row in found:
        print(visible(row.archive), row.state, row.entries, row.directories, row.collision_groups)
    if (args.plan or args.report) and len(found) != 1:
        raise ValueError("Documents are written for one archive at a time")
    if args.report:
        _write_report(flight, report, args.report, (args.zip,))
    if args.plan:
        decisions, folders = flight.drafted_plan()
        rows = [[r.asDict() for r in df.collect()] for df in (decisions.orderBy("entry_id"), folders.orderBy("node_id"))]
        documents.write_new(args.plan, documents.mapping_document(found[0].archive_id, target.profile_id, options, *rows), inputs=(args.zip,))
    return max((row["exit"] for row in found), default=2)


def _validated(spark: SparkSession, args: argparse.Namespace) -> tuple[Preflight, DataFrame]:
    with open(args.plan, encoding="utf-8") as source:
        plan = documents.load(source.read(documents.PLAN_BYTES + 1).rstrip("\n"), documents.MAPPING)
    o = plan["targetOptions"]
    flight = Preflight.of_path(spark, args.zip, plan["profileId"], Options(o["rootUnits"], o["componentLimit"], o["pathLimit"], o["directoryPathLimit"], o["unicodeVersion"]))
    archive = flight.scans.select("archive").first()
    return flight, flight.validate(*_plan_tables(spark, plan, archive.archive if archive else args.zip))


def _demo(spark: SparkSession, args: argparse.Namespace) -> int:
    """One archive with findings of all kinds, inspected under every profile; the draft is of the target's."""
    os.mkdir(args.output)
    within = lambda name: os.path.join(args.output, name)
    with open(within("demo.zip"), "xb") as out:
        out.write(synthetic.risky())
    exits = {}
    for target in POLICIES.values():
        chosen = target == policy(args.target)
        root = "C:\\delivery" if target.windows else "/delivery"
        job = argparse.Namespace(zip=within("demo.zip"), target=target.profile_id, target_root=root, plan=within("draft.json") if chosen else None, report=within(f"{target.profile_id}.json"))
        print(target.profile_id)
        exits[chosen] = _inspect(spark, job)
    return exits[True]


def _schema(_: SparkSession | None, args: argparse.Namespace) -> int:
    print(documents.dump(documents.json_schema(documents.SHAPES[args.document])))
    return 0


def _error(code: str) -> int:
    print(visible(code), file=sys.stderr)
    return 3 if code in _LIMITS else 2


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    row = _validated(spark, args)[1].first()
    if row is None or row.error:
        return _error(row.error if row else "DECISIONS_MUST_COVER_EVERY_ENTRY_ONCE")
    print(row.plan_id, "extractable" if row.extractable else "not extractable")
    return int(bool(row.diagnostics or row.advisories))


def _extract(spark: SparkSession, args: argparse.Namespace) -> int:
    flight, plans = _validated(spark, args)
    row = plans.first()
    if row is None or row.error:
        return _error(row.error if row else "DECISIONS_MUST_COVER_EVERY_ENTRY_ONCE")
    result = flight.extract(plans.withColumn("accept_plan_id", F.lit(args.accept_plan)), args.output, ExtractLimits(seconds=args.seconds)).first()
    print(result.status, result.files, result.directories, result.bytes)
    return 0 if result.status == "verified" else _error(result.error)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    run = {"inspect": _inspect, "validate-plan": _validate, "extract": _extract, "demo": _demo, "schema": _schema}[args.command]
    if run is not _schema:
        spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        return run(spark, args)
    except (ValueError, OSError) as error:
        return _error(str(error))


if __name__ == "__main__":
    sys.exit(main())
