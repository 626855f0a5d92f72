"""inspect, validate and extract over many archives at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, draft, reports, validate
from .plans.policies import ExtractLimits, Options, Policy, ScanLimits, policy
from .sources import archives, extraction


class Preflight:
    """The archives of a path, or of a table (archive, content), against one target."""

    def __init__(self, scans: DataFrame, contents: DataFrame, target: str | Policy, options: Options = Options(), limits: ScanLimits = ScanLimits()):
        self.scans, self.contents, self.options, self.limits = scans, contents, options, limits
        self.target = policy(target) if isinstance(target, str) else target
        self.entries = archives.entries(scans)

    @classmethod
    def of_path(cls, spark: SparkSession, path: str, target: str, options: Options = Options()) -> Preflight:
        scans = archives.read_archives(spark, path)
        return cls(scans, scans.select("archive", F.lit(None).cast("binary").alias("content")), target, options)

    @classmethod
    def of_contents(cls, contents: DataFrame, target: str, options: Options = Options(), limits: ScanLimits = ScanLimits()) -> Preflight:
        return cls(archives.scan_contents(contents, limits), contents, target, options, limits)

    def inspect(self, choices: DataFrame | None = None) -> analysis.Report:
        return analysis.inspect(self.scans, self.entries, self.target, self.options, choices, self.limits)

    def report_documents(self, report: analysis.Report | None = None) -> DataFrame:
        """archive and document: the report of each archive as JSON."""
        return reports.report_documents(self.scans, report or self.inspect(), self.target, self.options, self.limits)

    def draft(self, report: analysis.Report | None = None) -> DataFrame:
        report = report or self.inspect()
        return draft.suggest_plans(report.entries, report.directories, self.target, self.options)

    def validate(self, decisions: DataFrame, mappings: DataFrame) -> DataFrame:
        """Plans checked against the archives as they are now; `decisions` and `mappings` as validate_plans takes them."""
        chosen = decisions.where("encoding_candidate_id IS NOT NULL").select("archive", "entry_id", F.col("encoding_candidate_id").alias("candidate_id"))
        report = self.inspect(chosen)
        found = validate.validate_plans(report.summary, report.entries, report.directories, decisions, mappings, self.target, self.options, self.limits)
        return found.join(report.summary.select("archive", "archive_id"), "archive")

    def drafted_plan(self) -> tuple[DataFrame, DataFrame]:
        """The draft as a plan's decisions and directory mappings, bound to the archives."""
        rows = self.draft()
        bound = self.scans.select("archive", F.col("archive_id").alias("plan_archive_id"))
        return draft.decisions(rows).join(bound, "archive"), draft.directory_mappings(rows).join(bound, "archive")

    def extract(self, plans: DataFrame, output: str, limits: ExtractLimits = ExtractLimits()) -> DataFrame:
        """Extracts plans that carry accept_plan_id, the caller's word for exactly this plan."""
        return extraction.extract(self.contents, plans, self.inspect().entries, output, limits)
