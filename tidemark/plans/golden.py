"""Queries over a few small archives whose results are known; their SQL is the table of these results."""

from __future__ import annotations

import stat
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Preflight
from ..operators import draft
from ..shared import Table, new_path
from ..sources import archives
from ..sources.decoding import decode_candidates
from ..sources.synthetic import make, unicode_path
from ..sources.wire import Budget, Ranged, extents, member_chunks, scan
from .policies import ExtractLimits, Options, ScanLimits

Rows = list[tuple]


def values(columns: str, rows: Rows) -> str:
    """SQL of a table of literals."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, row)) + ')' for row in rows)}) AS t({columns})"


def _contents(spark: SparkSession, zips: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(name, bytearray(data)) for name, data in zips.items()], "archive string, content binary")


def _folder(name: str) -> dict:
    return {"name": name, "data": b"", "attr": stat.S_IFDIR << 16 | 0x10}


DRAFTS = {
    "three": make(["Report.txt", "report.txt", "Report_e000002.txt"]),
    "mixed": make(["Dir/x", "dir/y", "a", "a/z"]),
    "nested": make(["Dir/Sub/x", "dir/sub/y", _folder("Dir/"), _folder("Dir/")]),
    "blocked": make(["../bad", {"name": b"\xff\xfe", "flags": 0x800}, "good"]),
    "devices": make(["CON.txt", "tail.", "bb:c"]),
}
DRAFTED: Rows = [
    ("three", "e000001", "keep", "Report.txt"), ("three", "e000002", "rename", "report_e000002_2.txt"), ("three", "e000003", "keep", "Report_e000002.txt"),
    ("mixed", "e000001", "keep", "Dir/x"), ("mixed", "e000002", "rename", "dir_e000002/y"), ("mixed", "e000003", "rename", "a_e000003"), ("mixed", "e000004", "keep", "a/z"),
    ("nested", "e000001", "keep", "Dir/Sub/x"), ("nested", "e000002", "rename", "dir_e000002/sub/y"), ("nested", "e000003", "keep", "Dir"), ("nested", "e000004", "keep", "Dir"),
    ("blocked", "e000001", "skip", None), ("blocked", "e000002", "skip", None), ("blocked", "e000003", "keep", "good"),
    ("devices", "e000001", "rename", "_CON.txt"), ("devices", "e000002", "rename", "tail"), ("devices", "e000003", "rename", "bb_c"),
]


def draft_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested decisions: names that differ in case, files against directories, nested merges, blocked and illegal names."""
    rows = Preflight.of_contents(_contents(spark, DRAFTS), "windows", Options(root_units=20)).draft()
    return draft.decisions(rows).select("archive", "entry_id", "action", "target_path")


VALIDATED: Rows = [
    ("as drafted", None, True), ("same target", "TARGET_COMPARISON_COLLISION", None), ("leaves the root", "INVALID_TARGET_PATH", None), ("device", "UNSAFE_TARGET_PATH", None),
    ("too long", "UNSAFE_TARGET_PATH", None), ("entry left out", "DECISIONS_MUST_COVER_EVERY_ENTRY_ONCE", None), ("another archive", "ARCHIVE_ID_MISMATCH", None),
]


def validate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drafted plan and changed ones against one archive each: the first error, and whether it may be extracted."""
    data = make(["CON.txt", "a.txt", "A.txt", "ok/y"])
    flight = Preflight.of_contents(_contents(spark, {case: data for case, _, _ in VALIDATED}), "windows", Options(root_units=10))
    decisions, mappings = (Table(df, "plan").df for df in flight.drafted_plan())
    case, entry = F.col("archive"), F.col("entry_id")
    first = F.when(case == "leaves the root", "../x").when(case == "device", "CON").when(case == "too long", "x" * 300)
    target = F.when(entry == "e000001", F.coalesce(first, "target_path")).when((entry == "e000002") & (case == "same target"), "A_E000003.TXT").otherwise(F.col("target_path"))
    action = F.when((entry == "e000002") & (case == "same target"), "rename").otherwise(F.col("action"))
    changed = decisions.withColumns({"target_path": target, "action": action, "plan_archive_id": F.when(case == "another archive", "0").otherwise(F.col("plan_archive_id"))})
    changed = changed.where(~((case == "entry left out") & (entry == "e000002")))
    found = flight.validate(changed, mappings)
    return found.select("archive", "error", F.when(F.col("error").isNull(), F.col("extractable")).alias("extractable"))


COLLIDING = {
    "case": make(["Report.txt", "report.txt"]), "file and directory": make(["a", "a/x"]), "merge": make(["Dir/Sub/x", "dir/sub/y"]),
    "directory twice": make([_folder("d/"), _folder("d/"), "d/x"]), "folded": make(["ß/x", "ss/y"]), "forms": make(["\u00e9.txt", "e\u0301.txt"]), "folded forms": make(["\u00c9", "e\u0301"]),
}
COLLIDED: Rows = [
    ("windows", "case", "ascii-case", "file-overwrite", 2), ("windows", "file and directory", "exact", "file-directory", 2), ("windows", "merge", "ascii-case", "directory-merge", 2), ("windows", "merge", "ascii-case", "directory-merge", 2),
    ("windows", "folded", "casefold", "directory-merge", 2),
    ("macos-ci", "case", "ascii-case", "file-overwrite", 2), ("macos-ci", "file and directory", "exact", "file-directory", 2), ("macos-ci", "merge", "ascii-case", "directory-merge", 2), ("macos-ci", "merge", "ascii-case", "directory-merge", 2),
    ("macos-ci", "folded", "casefold", "directory-merge", 2), ("macos-ci", "folded", "nfc-casefold", "directory-merge", 2), ("macos-ci", "forms", "nfc", "file-overwrite", 2), ("macos-ci", "forms", "nfc-casefold", "file-overwrite", 2),
    ("macos-ci", "folded forms", "nfc-casefold", "file-overwrite", 2),
    ("macos-cs", "file and directory", "exact", "file-directory", 2), ("macos-cs", "forms", "nfc", "file-overwrite", 2),
    # No ascii-case here, so ASCII names fold under both folding rules.
    *(("linux", case, rule, impact, 2) for rule in ("casefold", "nfc-casefold") for case, impact in (("case", "file-overwrite"), ("merge", "directory-merge"), ("merge", "directory-merge"), ("folded", "directory-merge"))),
    ("linux", "file and directory", "exact", "file-directory", 2), ("linux", "forms", "nfc", "file-overwrite", 2), ("linux", "forms", "nfc-casefold", "file-overwrite", 2), ("linux", "folded forms", "nfc-casefold", "file-overwrite", 2),
]


def collisions_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collision groups of the same names under the four policies, folded and normalised ones among them."""
    contents, out = _contents(spark, COLLIDING), None
    for target in ("windows", "macos-ci", "macos-cs", "linux"):
        groups = Preflight.of_contents(contents, target, Options(root_units=10)).inspect().groups
        found = groups.select(F.lit(target).alias("target"), "archive", "rule", "impact", F.size("entry_ids").cast("long").alias("n_entries"))
        out = found if out is None else out.unionAll(found)
    return out


BUDGETS: Rows = [("1", "incomplete", 0), ("2", "findings", 1), ("3", "findings", 1)]


def budget_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collision of two members under budgets of one, two and three of them."""
    out = None
    for limit in (1, 2, 3):
        flight = Preflight.of_contents(_contents(spark, {str(limit): make(["a", "A"])}), "windows", Options(root_units=10), ScanLimits(group_members=limit))
        found = flight.inspect().summary.select("archive", "state", F.col("collision_groups").cast("long").alias("collision_groups"))
        out = found if out is None else out.unionAll(found)
    return out


BROKEN = {
    "short": (b"PK", "unsupported", "NOT_ZIP"),
    "program": (b"MZ" + bytes(40), "unsupported", "SFX_OR_NOT_ZIP"),
    "no end": (b"PK\x03\x04" + bytes(40), "invalid", "EOCD_MISSING"),
    "two ends": (make([], comment=make([])), "invalid", "EOCD_AMBIGUOUS"),
    "large directory": (make(["a"], size=(16 << 20) + 1), "incomplete", "CENTRAL_LIMIT"),
    "wrong count": (make(["a"], count=2), "invalid", "ENTRY_COUNT"),
    "encrypted": (make([{"name": "a", "flags": 0x801}]), "unsupported", "ENCRYPTED"),
    "method": (make([{"name": "a", "method": 12}]), "unsupported", "METHOD_UNSUPPORTED"),
    "offset": (make([{"name": "a", "offset": 9}]), "invalid", "LOCAL_RANGE"),
    "prefix": (make([{"name": "a", "offset": 1}]), "unsupported", "SFX_PREFIX"),
    "extra": (make([{"name": "a", "extra": b"\x01\x00\x09"}]), "invalid", "EXTRA_TRUNCATED"),
    "long name": (make(["n" * 4097]), "incomplete", "NAME_LIMIT"),
    "many entries": (make([f"f{k}" for k in range(4)], count=50_001), "incomplete", "ENTRY_LIMIT"),
}


def broken_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and codes of archives that do not hold to the format or to a limit."""
    scans = archives.scan_contents(_contents(spark, {name: data for name, (data, _, _) in BROKEN.items()}))
    return scans.select("archive", "state", F.array_join(F.transform("scan_diagnostics", lambda d: d["code"]), ",").alias("codes"))


_BIG = b"A" * 200_000
MEMBERS = {
    "good": ({"name": "a", "data": _BIG, "method": 8}, None),
    "stored": ({"name": "a", "data": _BIG}, None),
    "empty": ({"name": "a", "data": b"", "method": 8}, None),
    "local name": ({"name": "a", "local_name": b"b"}, "LOCAL_NAME_MISMATCH"),
    "checksum": ({"name": "a", "crc": 1}, "CONTENT_SIZE_CRC_MISMATCH"),
    "more than declared": ({"name": "a", "data": _BIG, "method": 8, "declared": 1}, "ACTUAL_SIZE_LIMIT"),
    "no stream": ({"name": "a", "method": 8, "payload": b"\xff\xff"}, "DEFLATE_INVALID"),
    "junk after": ({"name": "a", "method": 8, "payload": zlib.compress(b"x")[2:-4] + b"junk"}, "DEFLATE_TRAILING_DATA"),
    "cut": ({"name": "a", "data": _BIG, "method": 8, "payload": zlib.compress(_BIG)[2:-8]}, "DEFLATE_TRUNCATED"),
}


def member_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verified stream of one member says, for good members and for each way one can be wrong."""

    @F.udf("string")
    def error(content: bytes) -> str | None:
        source = Ranged.of(bytes(content))
        try:
            for extent in extents(source, scan(source), {"e000001"}).values():
                for _ in member_chunks(source, extent, ExtractLimits(), Budget(1 << 30)):
                    pass
        except ValueError as found:
            return str(found)
        return None

    return _contents(spark, {name: make([entry]) for name, (entry, _) in MEMBERS.items()}).select("archive", error("content").alias("error"))


NAMES = [
    ("ascii", b"plain", b"", 0, "cp437", "plain", "SPEC_DEFAULT_NOT_INTENT,ALSO_utf-8,ALSO_gb18030,ALSO_cp932,ALSO_big5"),
    ("bit 11", "é".encode(), b"", 0x800, "utf-8-bit11", "é", None),
    ("wrong bit 11", b"\xff", b"", 0x800, None, None, "INVALID_UTF8"),
    ("unicode path", b"x", unicode_path(b"x", "ü"), 0, None, "ü", None),
]


def encoding_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading of names under each kind of evidence."""
    rows = [(case, bytearray(raw), bytearray(extra), flags) for case, raw, extra, flags, *_ in NAMES]
    read = spark.createDataFrame(rows, "name_case string, raw binary, extra binary, flags int").withColumn("c", F.get(decode_candidates("raw", F.col("extra"), F.col("flags")), F.lit(0)))
    known = F.col("name_case")
    return read.select(
        "name_case",
        F.when(known.isin("ascii", "bit 11"), F.col("c.source")).alias("source"),
        F.when(known != "wrong bit 11", F.col("c.text")).alias("text"),
        F.when(known.isin("ascii", "wrong bit 11"), F.array_join("c.evidence", ",")).alias("evidence"),
    )


REPORTED: Rows = [
    ("three", "20", "findings", 3, 0, 1, "UmVwb3J0LnR4dA==", 0), ("mixed", "20", "findings", 4, 3, 2, "RGlyL3g=", 0), ("nested", "20", "findings", 4, 4, 2, "RGlyL1N1Yi94", 1),
    ("blocked", "20", "findings", 3, 0, 0, "Li4vYmFk", 0), ("devices", "20", "findings", 3, 0, 0, "Q09OLnR4dA==", 0),
]


def report_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON documents, read back field by field: options, counts, the first raw name, directories with several records."""
    read = lambda path: F.get_json_object("document", path)
    doubled = F.filter(F.from_json(read("$.diagnostics"), "array<struct<code:string>>"), lambda d: d["code"] == "DUPLICATE_DIRECTORY_METADATA")
    listed = lambda path: F.json_array_length(read(path)).cast("long")
    return Preflight.of_contents(_contents(spark, DRAFTS), "windows", Options(root_units=20)).report_documents().select(
        "archive",
        read("$.options.rootUnits").alias("root_units"),
        read("$.state").alias("state"),
        listed("$.entries").alias("entries"),
        listed("$.logicalDirectories").alias("directories"),
        listed("$.collisionGroups").alias("collision_groups"),
        read("$.entries[0].raw.rawNameBase64").alias("raw_name"),
        F.size(doubled).cast("long").alias("doubled"),
    )


EXTRACTED: Rows = [("broken", "failed", "CONTENT_SIZE_CRC_MISMATCH", None, None), ("good", "verified", None, 3, 2)]


def extract_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafted plans extracted into the shared folder, read back and verified; what fails leaves nothing behind."""
    zips = {"good": make(["a.txt", {"name": "Dir/x", "data": _BIG, "method": 8}, "CON.txt", _folder("empty/")]), "broken": make(["a", {"name": "b", "crc": 5}])}
    flight = Preflight.of_contents(_contents(spark, zips), "windows", Options(root_units=10))
    plans = flight.validate(*(Table(df, "plan").df for df in flight.drafted_plan()))
    output = new_path(spark, "extracted").removeprefix("file://")
    found = Table(flight.extract(Table(plans.withColumn("accept_plan_id", F.col("plan_id")), "plan").df, output), "extraction").df
    good = F.col("status") == "verified"
    return found.select("archive", "status", "error", F.when(good, F.col("files").cast("long")).alias("files"), F.when(good, F.col("directories").cast("long")).alias("directories"))


QUERIES = {f.__name__: f for f in (draft_golden, validate_golden, collisions_golden, budget_golden, broken_archives, member_failures, encoding_golden, report_golden, extract_tree)}
ORACLES = {
    "draft_golden": values("archive, entry_id, action, target_path", DRAFTED),
    "validate_golden": values("archive, error, extractable", VALIDATED),
    "collisions_golden": values("target, archive, rule, impact, n_entries", COLLIDED),
    "budget_golden": values("archive, state, collision_groups", BUDGETS),
    "broken_archives": values("archive, state, codes", [(name, state, code) for name, (_, state, code) in BROKEN.items()]),
    "member_failures": values("archive, error", [(name, error) for name, (_, error) in MEMBERS.items()]),
    "encoding_golden": values("name_case, source, text, evidence", [(case, source, text, evidence) for case, _, _, _, source, text, evidence in NAMES]),
    "report_golden": values("archive, root_units, state, entries, directories, collision_groups, raw_name, doubled", REPORTED),
    "extract_tree": values("archive, status, error, files, directories", EXTRACTED),
}
