from __future__ import annotations

import json
import unicodedata

import pytest

from tests import zips
from tidemark import cli
from tidemark.api import Preflight
from tidemark.plans.policies import POLICIES, Options, policy
from tidemark.sources import documents as D

ROW = {"entry_id": "e000001", "action": "keep", "target_path": "a", "encoding_candidate_id": None, "name_confirmed": True}
GOOD = D.mapping_document("x", "linux-posix-bytes-v1", Options(root_units=5), [ROW], [{"node_id": "d1", "target_path": "t"}])


def changed(**more):
    return json.dumps(json.loads(GOOD) | more)


def test_round_trip():
    plan = D.load(GOOD, D.MAPPING)
    assert plan["targetOptions"]["rootUnits"] == 5 and plan["targetOptions"]["unicodeVersion"] == unicodedata.unidata_version
    assert json.dumps(json.loads(GOOD), sort_keys=True, separators=(",", ":")) == GOOD
    rest = json.loads(GOOD)
    del rest["directoryMappings"]
    assert "directoryMappings" not in D.load(json.dumps(rest), D.MAPPING)


@pytest.mark.parametrize(
    "bad",
    [
        changed(extra=1),
        changed(schemaVersion=2),
        changed(schemaVersion=True),
        GOOD.replace('"schemaVersion":1', '"schemaVersion":1.0'),
        GOOD.replace('"schemaVersion":1', '"schemaVersion":-0'),
        GOOD.replace('"schemaVersion":1', '"schemaVersion":NaN'),
        GOOD.replace('"archiveId":"x"', '"archiveId":"x","archiveId":"x"'),
        GOOD.replace('"rootUnits":"5"', '"rootUnits":5'),
        GOOD.replace('"rootUnits":"5"', '"rootUnits":"05"'),
        GOOD.replace('"action":"keep"', '"action":"move"'),
        GOOD.replace('"action":"keep"', '"action":"skip"'),
        GOOD.replace('"pathLimit":null', '"pathLimit":9999'),
        changed(profileId="dos"),
        changed(decisions={}),
        "[]",
        "{",
    ],
)
def test_rejections(bad):
    with pytest.raises(ValueError):
        D.load(bad, D.MAPPING)


def test_limits_and_sinks(tmp_path):
    with pytest.raises(ValueError, match="PLAN_INPUT_LIMIT"):
        D.load(GOOD, D.MAPPING, max_bytes=len(GOOD) - 1)
    assert D.load(GOOD, D.MAPPING, max_bytes=len(GOOD))
    with pytest.raises(ValueError, match="EXPORT_LIMIT"):
        D.dump("x" * 9, max_bytes=10)
    assert D.dump("x" * 8, max_bytes=10) == '"xxxxxxxx"'
    D.write_new(str(tmp_path / "a"), "1")
    for path, inputs, code in ((tmp_path / "a", (), "OUTPUT_ALREADY_EXISTS"), (tmp_path / "b", (str(tmp_path / "b"),), "OUTPUT_EQUALS_INPUT")):
        with pytest.raises(ValueError, match=code):
            D.write_new(str(path), "2", inputs=inputs)


def test_result_needs_evidence_for_missing_counts():
    result = {
        "status": "failed", "planId": "p", "archiveId": "a", "hostBackend": "posix", "actualFiles": None, "actualDirectories": None, "actualBytes": None, "entries": [], "skippedEntryIds": [],
        "diagnostics": [{"code": "ACTUAL_COUNTS_UNAVAILABLE", "severity": "error", "entryIds": [], "details": {}, "certainty": "config_rule"}],
        "cleanup": {"state": "not_created", "removedFiles": 0, "removedDirectories": 0, "diagnostics": []}, "schemaVersion": 1,
    }
    assert D.load(json.dumps(result), D.RESULT)["status"] == "failed"
    for wrong in ({"status": "verified"}, {"diagnostics": []}, {"actualFiles": 1}):
        with pytest.raises(ValueError):
            D.load(json.dumps(result | wrong), D.RESULT)


def test_command_line(spark, tmp_path, capsys):
    archive, plan = tmp_path / "a.zip", tmp_path / "plan.json"
    archive.write_bytes(zips.make(["CON.txt", "d/x"]))
    assert cli.main(["inspect", str(archive), "--target", "windows", "--target-root", "C:\\d", "--plan", str(plan)], spark) == 1
    assert cli.main(["validate-plan", str(archive), str(plan)], spark) in (0, 1)
    plan_id = capsys.readouterr().out.strip().splitlines()[-1].split()[0]
    assert cli.main(["extract", str(archive), str(plan), "--accept-plan", "no", "--output", str(tmp_path / "out")], spark) == 2
    assert cli.main(["extract", str(archive), str(plan), "--accept-plan", plan_id, "--output", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / plan_id / "_CON.txt").read_bytes() == b"x"


def report(**more):
    raw = {"entryId": "e1", "index": 0, "centralOffset": "0", "rawNameBase64": "YQ==", "rawExtraBase64": "", "flags": 0, "method": 0, "crc32": 1, "compressedBytes": "1", "declaredBytes": "1", "localOffset": "0", "createSystem": 3, "externalAttr": 0}
    reading = {"candidateId": "c1", "text": "a", "source": "ascii", "valid": True, "evidence": [], "certainty": "config_rule"}
    entry = {"entryId": "e1", "index": 0, "raw": raw, "candidates": [reading], "selectedCandidateId": None, "defaultDisplayName": "a", "nameState": "unambiguous", "entryType": "file", "sourceParts": ["a"], "componentUnits": [1], "pathUnits": "1", "diagnosticIds": []}
    limits = {"archiveBytes": str(8 << 30), "centralBytes": "1", "entries": 50000, "nameBytes": "4096", "depth": 64, "groupMembers": 1, "planBytes": "1", "exportBytes": "1", "seconds": 30}
    options = {"rootUnits": "5", "componentLimit": None, "pathLimit": 1023, "directoryPathLimit": None, "unicodeVersion": unicodedata.unidata_version}
    tables = {"entries": [entry], "logicalDirectories": [], "collisionGroups": [], "diagnostics": [], "transformations": []}
    checks = {"schemaVersion": 1, "contentVerified": False, "localHeadersVerified": False}
    return json.dumps({"archiveId": "x", "runtime": {}, "profile": D.profile_document(policy("macos-ci")), "options": options, "complete": True, "state": "ok", "summary": {"entries": 1}, "limits": limits} | tables | checks | more)


def test_reports_are_read():
    found = D.load_report(report())
    assert found["entries"][0]["raw"]["rawNameBase64"] == b"a" and found["limits"]["archiveBytes"] == 8 << 30 and found["profile"]["units"] == "utf8"
    with pytest.raises(ValueError, match="REPORT_INPUT_LIMIT"):
        D.load_report(report(), max_bytes=100)


@pytest.mark.parametrize(
    "bad",
    [
        report(contentVerified=True),
        report(contentVerified=0),
        report(state="fine"),
        report(extra=1),
        report(profile=D.profile_document(policy("macos-ci")) | {"pathLimit": 2000}),
        report(profile=D.profile_document(policy("windows"))),
        report().replace('"YQ=="', '"YR=="'),
        report().replace('"YQ=="', '"Y Q="'),
        report().replace('"seconds": 30', '"seconds": 31'),
        report().replace('"nameBytes": "4096"', '"nameBytes": "4097"'),
        report().replace('"depth": 64', '"depth": true'),
    ],
)
def test_bad_reports(bad):
    with pytest.raises(ValueError):
        D.load_report(bad)


def test_demo(spark, tmp_path, capsys):
    out = tmp_path / "demo"
    assert cli.main(["demo", "--target", "linux", "--output", str(out)], spark) == 1
    found = {p.stem: D.load_report(p.read_text().rstrip("\n")) for p in out.glob("*-v1.json")}
    assert set(found) == set(POLICIES)
    names = {name: sorted({d["code"] for d in r["diagnostics"]}) for name, r in found.items()}
    assert "WINDOWS_DEVICE_NAME" in names["windows-win32-conservative-v1"] and "WINDOWS_DEVICE_NAME" not in names["linux-posix-bytes-v1"]
    assert all({"PATH_TRAVERSAL", "SPECIAL_TYPE", "DECLARED_RATIO_RISK"} <= set(codes) for codes in names.values())
    nfc = [g["originalKeys"] for g in found["macos-apfs-cs-advisory-v1"]["collisionGroups"] if g["ruleId"] == "nfc"]
    assert nfc == [["nai\u0308ve.md", "na\u00efve.md"]]
    for r in found.values():
        assert [e["index"] for e in r["entries"]] == list(range(10)) and r["entries"][0]["raw"]["rawNameBase64"] == b"Notes.txt" and r["summary"]["entries"] == 10
    assert [g["originalKeys"] for g in found["windows-win32-conservative-v1"]["collisionGroups"] if g["ruleId"] == "ascii-case"] == [["Notes.txt", "notes.txt"]]
    assert D.load((out / "draft.json").read_text().rstrip("\n"), D.MAPPING)["profileId"] == "linux-posix-bytes-v1"
    assert cli.main(["demo", "--output", str(out)], spark) == 2
    assert cli.main(["schema", "report"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == D.json_schema(D.REPORT)


def test_reports_of_archives_without_entries(spark):
    contents = spark.createDataFrame([("none", bytearray(zips.make([]))), ("text", bytearray(b"no archive")), ("short", bytearray(zips.make(["a"], count=9)))], "archive string, content binary")
    flight = Preflight.of_contents(contents, "linux", Options(root_units=5))
    found = {r.archive: D.load_report(r.document) for r in flight.report_documents().collect()}
    assert found["none"]["entries"] == [] and found["none"]["state"] == "ok" and found["none"]["collisionGroups"] == []
    assert found["text"]["state"] == "unsupported" and found["text"]["archiveId"] == "" and len(found["text"]["diagnostics"]) == 1
    assert found["short"]["complete"] is False and found["short"]["state"] == "invalid" and len(found["short"]["entries"]) == 1


@pytest.mark.parametrize("name", list(D.SHAPES))
def test_schemas_name_every_field(name):
    found = json.loads(D.dump(D.json_schema(D.SHAPES[name])))
    assert set(found["properties"]) == set(D.SHAPES[name].fields) and set(found["required"]) == set(D.SHAPES[name].fields) - D.SHAPES[name].optional
    assert found["additionalProperties"] is False and found["properties"]["schemaVersion"] == {"const": 1}
