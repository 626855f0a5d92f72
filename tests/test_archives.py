from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import zips
from tidemark.api import Preflight
from tidemark.operators import collisions, draft, tree
from tidemark.plans import golden
from tidemark.plans.listings import zip_contents
from tidemark.plans.policies import LINUX, WINDOWS, ExtractLimits, Options, ScanLimits, policy, root_units
from tidemark.plans.queries import QUERIES
from tidemark.sources import content, extraction
from tidemark.sources.archives import scan_contents
from tidemark.sources.decoding import readings
from tidemark.sources.wire import Budget, Ranged, extents, fields_of, member_chunks, scan, scan_file

S_IFDIR, S_IFLNK = 0o040755 << 16 | 0x10, 0o120777 << 16


def codes(data, limits=ScanLimits()):
    found = scan(Ranged.of(data), limits)
    return found.state, [d[0] for d in found.diagnostics]


def test_scan_finds_entries_and_binds_them():
    data = zips.make(["a.txt", {"name": "d/", "data": b"", "attr": S_IFDIR}])
    found = scan(Ranged.of(data))
    assert (found.state, [e.entry_id for e in found.entries], [e.raw_name for e in found.entries]) == ("ok", ["e000001", "e000002"], [b"a.txt", b"d/"])
    central = data[found.central_offset : found.central_offset + found.central_bytes]
    assert found.archive_id == hashlib.sha256(str(len(data)).encode() + b"\0" + data[-22:] + central).hexdigest()


@pytest.mark.parametrize(
    "data, wanted",
    [
        (b"PK", ("unsupported", ["NOT_ZIP"])),
        (b"MZ" + b"\0" * 40, ("unsupported", ["SFX_OR_NOT_ZIP"])),
        (b"PK\x03\x04" + b"\0" * 40, ("invalid", ["EOCD_MISSING"])),
        (zips.make([], comment=zips.make([])), ("invalid", ["EOCD_AMBIGUOUS"])),
        (zips.make(["a"], size=(16 << 20) + 1), ("incomplete", ["CENTRAL_LIMIT"])),
        (zips.make(["a"], count=2), ("invalid", ["ENTRY_COUNT"])),
        (zips.make([{"name": "a", "flags": 0x801}]), ("unsupported", ["ENCRYPTED"])),
        (zips.make([{"name": "a", "method": 12}]), ("unsupported", ["METHOD_UNSUPPORTED"])),
        (zips.make([{"name": "a", "offset": 9}]), ("invalid", ["LOCAL_RANGE"])),
        (zips.make([{"name": "a", "offset": 1}]), ("unsupported", ["SFX_PREFIX"])),
        (zips.make([{"name": "a", "extra": b"\x01\x00\x09"}]), ("invalid", ["EXTRA_TRUNCATED"])),
    ],
)
def test_scan_rejections(data, wanted):
    assert codes(data) == wanted


@pytest.mark.parametrize("n, state", [(2, "ok"), (3, "ok"), (4, "incomplete")])
def test_entry_limit_boundary(n, state):
    assert codes(zips.make([f"f{k}" for k in range(n)]), ScanLimits(entries=3))[0] == state


def test_limits_can_only_be_lowered():
    with pytest.raises(ValueError):
        ScanLimits(entries=50_001)
    with pytest.raises(ValueError):
        Options(path_limit=260).checked(WINDOWS)


def test_scan_of_a_link_and_of_a_missing_file(tmp_path):
    (tmp_path / "a.zip").write_bytes(zips.make(["a"]))
    (tmp_path / "l.zip").symlink_to(tmp_path / "a.zip")
    assert scan_file(str(tmp_path / "a.zip")).state == "ok"
    assert scan_file(str(tmp_path / "l.zip")).state == "unsupported"
    assert [d[0] for d in scan_file(str(tmp_path / "no.zip")).diagnostics] == ["INPUT_IO_ERROR"]


def test_readings():
    assert [r["source"] for r in readings(b"plain", b"", 0)] == ["cp437"]
    assert readings(b"plain", b"", 0)[0]["evidence"] == ["SPEC_DEFAULT_NOT_INTENT", "ALSO_utf-8", "ALSO_gb18030", "ALSO_cp932", "ALSO_big5"]
    assert readings("é".encode(), b"", 0x800)[0]["certainty"] == "config_rule"
    assert readings(b"\xff", b"", 0x800)[0]["evidence"] == ["INVALID_UTF8"]
    assert readings(b"x", zips.unicode_path(b"x", "ü"), 0)[0]["text"] == "ü"
    assert "UNICODE_EXTRA_CRC" in readings(b"y", zips.unicode_path(b"x", "ü"), 0)[0]["evidence"]
    assert readings(b"x", zips.unicode_path(b"x", "ü"), 0x800)[0]["evidence"][0] == "UNICODE_EXTRA_CONFLICT"
    # 0x5C as a trailing byte of a two-byte character is no separator
    assert "\\" not in next(r["text"] for r in readings(b"\x95\x5c/file.txt", b"", 0) if r["source"] == "cp932")
    assert fields_of(zips.tlv(9, b"ab")) == [(9, b"ab")]


def test_content_checks():
    def read(entry, limits=ExtractLimits(), budget=None):
        source = Ranged.of(zips.make([entry]))
        listing = scan(source)
        extent = extents(source, listing, {"e000001"})["e000001"]
        return b"".join(member_chunks(source, extent, limits, budget or Budget(limits.total_bytes)))

    big = b"A" * 200_000
    assert read({"name": "a", "data": big, "method": 8}) == big
    for entry, code in [
        ({"name": "a", "local_name": b"b"}, "LOCAL_NAME_MISMATCH"),
        ({"name": "a", "crc": 1}, "CONTENT_SIZE_CRC_MISMATCH"),
        ({"name": "a", "data": big, "method": 8, "declared": 1}, "ACTUAL_SIZE_LIMIT"),
        ({"name": "a", "method": 8, "payload": b"\xff\xff"}, "DEFLATE_INVALID"),
        ({"name": "a", "method": 8, "payload": zlib.compress(b"x")[2:-4] + b"junk"}, "DEFLATE_TRAILING_DATA"),
        ({"name": "a", "data": big, "method": 8, "payload": zlib.compress(big)[2:-8]}, "DEFLATE_TRUNCATED"),
    ]:
        with pytest.raises(ValueError, match=code):
            read(entry)
    for total, fails in ((4, True), (5, False), (6, False)):
        if fails:
            with pytest.raises(ValueError, match="ACTUAL_SIZE_LIMIT"):
                read({"name": "a", "data": b"12345"}, budget=Budget(total))
        else:
            assert read({"name": "a", "data": b"12345"}, budget=Budget(total)) == b"12345"
    source = Ranged.of(zips.make(["a", {"name": "b", "offset": 0}]))
    with pytest.raises(ValueError, match="DUPLICATE_LOCAL_OFFSET"):  # a directory may say so, and its second member's header is never reached
        extents(source, scan(source), set())


def preflight(spark, archives, target="windows", options=Options(root_units=10), **more):
    contents = spark.createDataFrame([(k, bytearray(v)) for k, v in archives.items()], "archive string, content binary")
    return Preflight.of_contents(contents, target, options, **more)


EIGHT = zips.make(
    ["Read.txt", "read.TXT", "CON.txt", "tail.", "../escape.txt", {"name": "link", "attr": S_IFLNK}, "\u00e9.txt", "e\u0301.txt", {"name": "zeros", "data": b"A" * 131072, "method": 8}, "/".join(["long-directory"] * 28) + "/x"]
)


def test_report(spark):
    report = preflight(spark, {"eight": EIGHT, "none": zips.make([]), "bad": b"PK"}, options=Options(root_units=100)).inspect()
    entries = {r.entry_id: r for r in report.entries.where("archive = 'eight'").collect()}
    assert [entries[f"e{k:06d}"].name_state for k in (1, 5, 6, 7)] == ["unambiguous", "blocked", "blocked", "unambiguous"]
    assert entries["e000003"].codes == ["WINDOWS_DEVICE_NAME"] and entries["e000004"].codes == ["WINDOWS_TRAILING_DOT_SPACE"]
    assert entries["e000005"].codes == ["PATH_TRAVERSAL"] and entries["e000006"].entry_type == "symlink"
    assert "PATH_LIMIT" in entries["e000010"].codes and entries["e000009"].codes == ["DECLARED_RATIO_RISK"]
    groups = report.groups.collect()
    assert [(g.rule, sorted(g.entry_ids), g.impact) for g in groups] == [("ascii-case", ["e000001", "e000002"], "file-overwrite")]
    summary = {r.archive: r for r in report.summary.collect()}
    assert (summary["eight"].state, summary["none"].state, summary["bad"].state, summary["bad"].complete) == ("findings", "ok", "unsupported", True)
    assert summary["eight"].directories == 28


def test_macos_sees_equal_forms(spark):
    report = preflight(spark, {"eight": EIGHT}, "macos-ci").inspect()
    assert {g.rule for g in report.groups.collect()} == {"ascii-case", "nfc", "nfc-casefold"}


def test_tree_collisions_and_identities(spark):
    data = zips.make(["a", "a/x", "Dir/x", "dir/y", "dup", "dup", {"name": "empty/", "data": b"", "attr": S_IFDIR}, {"name": "empty/", "data": b"", "attr": S_IFDIR}])
    report = preflight(spark, {"t": data}).inspect()
    assert {(g.rule, g.impact, g.key) for g in report.groups.collect()} == {("exact", "file-directory", "a"), ("ascii-case", "file-directory", "a"), ("ascii-case", "directory-merge", "dir"), ("exact", "file-overwrite", "dup")} - {("ascii-case", "file-directory", "a")}
    dirs = {tuple(d.parts): d for d in report.directories.collect()}
    assert dirs[("empty",)].explicit_entry_ids == ["e000007", "e000008"] and dirs[("a",)].owner_entry_id == "e000002"
    entries = sorted(report.entries.collect(), key=lambda e: e["index"])
    context = [[e.entry_id, None, e.candidates[0].candidate_id] for e in entries]
    value = json.dumps({"context": context, "ownerIndex": 1, "sourceParts": ["a"]}, sort_keys=True, separators=(",", ":"))
    assert dirs[("a",)].node_id == "d" + hashlib.sha256(value.encode()).hexdigest()


@pytest.mark.parametrize("limit, exceeded", [(1, True), (2, False), (3, False)])
def test_group_member_budget(spark, limit, exceeded):
    report = preflight(spark, {"t": zips.make(["a", "A"])}, limits=ScanLimits(group_members=limit)).inspect()
    assert report.groups.count() == (0 if exceeded else 1)


def test_depth_limit(spark):
    deep = lambda n: zips.make(["/".join(["d"] * n)])
    report = preflight(spark, {str(n): deep(n) for n in (63, 64, 65)}, "linux", Options()).inspect()
    assert {r.archive: (r.state, r.complete) for r in report.summary.collect()} == {"63": ("findings", True), "64": ("findings", True), "65": ("incomplete", False)}
    found = {r.archive: r.codes for r in report.entries.collect()}
    assert "DEPTH_LIMIT" in found["65"] and "DEPTH_LIMIT" not in found["64"]


def test_draft_and_validation(spark, tmp_path):
    data = zips.make(["CON.txt", "a.txt", "A.txt", "bb:c/x", "Dir./x", "ok/y", {"name": "link", "attr": S_IFLNK}])
    flight = preflight(spark, {"z": data})
    rows = flight.draft().collect()
    targets = {r.id: r.target_path for r in rows if r.kind == "decision"}
    assert targets == {"e000001": "_CON.txt", "e000002": "a.txt", "e000003": "A_e000003.txt", "e000004": "bb_c/x", "e000005": "Dir/x", "e000006": "ok/y", "e000007": None}
    decisions, mappings = flight.drafted_plan()
    assert mappings.count() == 2
    plan = flight.validate(decisions, mappings).collect()[0]
    assert plan.error is None and plan.extractable and plan.resolved["e000003"] == "A_e000003.txt" and len(plan.plan_id) == 64
    other = decisions.withColumn("target_path", F.when(F.col("entry_id") == "e000002", "A_e000003.TXT").otherwise(F.col("target_path"))).withColumn("action", F.when(F.col("entry_id") == "e000002", "rename").otherwise(F.col("action")))
    assert flight.validate(other, mappings).collect()[0].error == "TARGET_COMPARISON_COLLISION"
    for change, error in [("../x", "INVALID_TARGET_PATH"), ("CON", "UNSAFE_TARGET_PATH"), ("x" * 300, "UNSAFE_TARGET_PATH")]:
        changed = decisions.withColumn("target_path", F.when(F.col("entry_id") == "e000001", change).otherwise(F.col("target_path")))
        assert flight.validate(changed, mappings).collect()[0].error == error
    assert flight.validate(decisions.where("entry_id <> 'e000002'"), mappings).collect()[0].error == "DECISIONS_MUST_COVER_EVERY_ENTRY_ONCE"
    assert flight.validate(decisions, mappings.withColumn("node_id", F.lit("d0"))).collect()[0].error == "UNKNOWN_OR_DUPLICATE_DIRECTORY_NODE"
    assert flight.validate(decisions.withColumn("plan_archive_id", F.lit("0")), mappings).collect()[0].error == "ARCHIVE_ID_MISMATCH"
    plans = flight.validate(decisions, mappings).withColumn("accept_plan_id", F.col("plan_id"))
    result = flight.extract(plans, str(tmp_path / "out")).collect()[0]
    assert (result.status, result.files, result.directories, result.error) == ("verified", 6, 3, None)
    assert sorted(p.name for p in (tmp_path / "out" / plan.plan_id).iterdir()) == ["A_e000003.txt", "Dir", "_CON.txt", "a.txt", "bb_c", "ok"]
    again = flight.extract(plans, str(tmp_path / "out")).collect()[0]
    assert (again.status, again.error) == ("failed", "OUTPUT_ALREADY_EXISTS_OR_INPUT")
    refused = flight.extract(plans.withColumn("accept_plan_id", F.lit("no")), str(tmp_path / "out2")).collect()[0]
    assert refused.error == "PLAN_ACCEPTANCE_REQUIRED" and not (tmp_path / "out2").exists()


def test_failed_extraction_leaves_nothing(tmp_path):
    data = zips.make(["a", {"name": "b", "crc": 5}])
    listing = scan(Ranged.of(data))
    plan = {"plan_id": "p", "archive_id": listing.archive_id, "extractable": True, "resolved": {"e000001": "a", "e000002": "b"}, "kinds": {"e000001": "file", "e000002": "file"}}
    result = extraction.extract_archive(Ranged.of(data), plan, "p", str(tmp_path / "out"))
    assert (result["status"], result["error"], result["cleanup"]) == ("failed", "CONTENT_SIZE_CRC_MISMATCH", "removed")
    assert (result["removed_files"], result["removed_directories"]) == (2, 1)
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("change", ["added", "replaced", "linked", "missing"])
def test_cleanup_leaves_what_others_touched(tmp_path, change):
    tree = extraction.Tree(str(tmp_path / "out"), ExtractLimits())
    tree.write(("d", "a"), iter([b"1"]))
    own = f"{tree.root}/d/a"
    if change == "added":
        open(f"{tree.root}/d/b", "w").close()
    elif change == "replaced":
        os.link(own, tmp_path / "kept")
        os.unlink(own)
        open(own, "w").close()
    elif change == "linked":
        os.rename(f"{tree.root}/d", tmp_path / "d")
        os.symlink(tmp_path / "d", f"{tree.root}/d")
    else:
        os.unlink(own)
    before = sorted(os.listdir(tree.root))
    assert tree.remove() == ("retained_ownership_unknown", 0, 0) and sorted(os.listdir(tree.root)) == before


def test_source_reads_files(spark, tmp_path):
    for name, data in (("a", zips.make(["x"])), ("b", EIGHT)):
        (tmp_path / f"{name}.zip").write_bytes(data)
    flight = Preflight.of_path(spark, str(tmp_path / "*.zip"), "windows", Options(root_units=root_units("C:\\data", WINDOWS)))
    assert {r.archive[-5:]: r.entries for r in flight.inspect().summary.collect()} == {"a.zip": 1, "b.zip": 10}


def test_policies():
    assert policy("linux") is LINUX and root_units("C:\\data\\", WINDOWS) == 8
    with pytest.raises(ValueError):
        policy("dos")


def test_empty_listing(spark):
    none = spark.createDataFrame([], "archive string, entry_id string, index long, entry_type string, parts array<string>")
    found = collisions.objects(none, tree.logical_directories(none))
    assert collisions.collision_groups(found, WINDOWS).count() == 0
    assert draft.records(none.toPandas()) == []


def test_rejected_archives_fail_the_digests(spark):
    good, bad = zips.make(["a.txt"]), zips.make([f"{k}" for k in range(50_001)])
    frame = lambda *data: spark.createDataFrame([(f"{k}.zip", bytearray(d)) for k, d in enumerate(data)], "archive string, content binary")
    assert content.member_digests(frame(good)).count() == 1
    for data in (bad, b"no archive" * 9):
        with pytest.raises(Exception, match="1.zip: "):
            content.member_digests(frame(good, data)).collect()


def test_archives_of_a_source_grow_in_number(spark, tmp_path):
    rows = [(k, "en", "x" * 100, "a" if k < 300 else "b") for k in range(310)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for limits, wanted in (({}, 8), ({"entries": 20}, 15), ({"text_bytes": 1000}, 30)):
        found = scan_contents(zip_contents(spark, str(tmp_path), **limits)).select("archive", "state", F.size("entries").alias("n")).collect()
        assert sum(r.n for r in found) == 310 and {r.state for r in found} == {"ok"}
        assert sum(r.archive.startswith("a-") for r in found) == wanted and sum(r.archive.startswith("b-") for r in found) == 8


def test_candidate_decode_reads_whole_texts(spark, tmp_path):
    texts = ["a" * 30, "a" * 30 + "b", "a" * 30 + "\u00e9", "a" * 30 + "\U0001f600" * 40]
    spark.createDataFrame([(3 * k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["candidate_decode"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        wanted, row = readings(text.encode(), b"", 0), found[3 * k + 1]
        assert (row.n_readings, row.first_id, row.sources) == (len(wanted), wanted[0]["candidate_id"], ",".join(w["source"] for w in wanted))
    assert len({r.first_id for r in found.values()}) == 4


@pytest.mark.parametrize("name", list(golden.QUERIES))
def test_small_archives_give_the_known_results(spark, name):
    found, wanted = golden.QUERIES[name](spark, ""), duckdb.sql(golden.ORACLES[name])
    assert found.columns == wanted.columns
    assert Counter(map(tuple, found.collect())) == Counter(wanted.fetchall())
