"""JSON documents of plans and results: one canonical form out, nothing but that accepted in.

A document is described by a `Shape`, a table of its fields. Reading is closed-world: an
unknown, missing or doubled field, a non-finite or non-canonical number, or a value of another type is an error.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..plans.policies import POLICIES, VERSION, Options, Policy, policy

_WHOLE = re.compile(r"0|[1-9][0-9]*")
#: Bytes of a plan and of a report that are read or written at most.
PLAN_BYTES, EXPORT_BYTES = 16 << 20, 64 << 20


def _fail(what: str) -> None:
    raise ValueError(what)


@dataclass(frozen=True)
class Kind:
    """Values of one kind: how one is read, and its JSON Schema."""

    read: Callable[[object], object]
    schema: dict

    def __call__(self, value: object) -> object:
        return self.read(value)


def _typed(wanted: type, schema: dict, holds: Callable[[object], bool] = lambda value: True) -> Kind:
    return Kind(lambda value: value if type(value) is wanted and holds(value) else _fail("value of another type or range"), schema)


text = _typed(str, {"type": "string"})
flag = _typed(bool, {"type": "boolean"})
count = _typed(int, {"type": "integer", "minimum": 0}, lambda value: value >= 0)
#: Sizes are decimal strings, so that no reader rounds them.
size = Kind(
    lambda value: int(value) if type(value) is str and _WHOLE.fullmatch(value) else _fail("not a size: digits in a string, without leading zeros"),
    {"type": "string", "pattern": r"^(?:0|[1-9][0-9]*)(?![\s\S])"},
)


def _decoded(value: object) -> bytes:
    """Bytes of base64 text, of which only the canonical spelling is taken."""
    raw = base64.b64decode(text(value), validate=True)
    return raw if base64.b64encode(raw).decode() == value else _fail("another spelling of base64")


octets = Kind(_decoded, {"type": "string", "contentEncoding": "base64"})


def only(fixed: object) -> Kind:
    return _typed(type(fixed), {"const": fixed}, lambda value: value == fixed)


def one_of(*allowed: str) -> Kind:
    return _typed(str, {"enum": list(allowed)}, lambda value: value in allowed)


def up_to(most: int) -> Kind:
    return _typed(int, {"type": "integer", "minimum": 1, "maximum": most}, lambda value: 0 < value <= most)


def size_up_to(most: int) -> Kind:
    """A size from 1 on. The schema bounds the number of its digits, reading bounds the number itself."""
    return Kind(lambda value: size(value) if 0 < size(value) <= most else _fail("size over its limit"), {"type": "string", "pattern": r"^[1-9][0-9]*(?![\s\S])", "maxLength": len(str(most))})


def maybe(kind: Kind | Shape) -> Kind:
    return Kind(lambda value: None if value is None else kind(value), {"anyOf": [kind.schema, {"type": "null"}]})


def many(kind: Kind | Shape) -> Kind:
    return Kind(lambda value: [kind(v) for v in value] if type(value) is list else _fail("not a list"), {"type": "array", "items": kind.schema})


def mapping(kind: Kind) -> Kind:
    return Kind(lambda value: {text(k): kind(v) for k, v in value.items()} if type(value) is dict else _fail("not a table of names"), {"type": "object", "additionalProperties": kind.schema})


@dataclass(frozen=True)
class Shape:
    """Objects with these fields and no others. `rule` holds across fields; `stated` is what of it JSON Schema can say."""

    fields: dict[str, Kind | Shape]
    optional: frozenset[str] = frozenset()
    rule: Callable[[dict], object] | None = None
    stated: dict | None = None

    def __call__(self, value: object) -> dict:
        given = value.keys() if type(value) is dict else _fail("not an object")
        if strange := given - self.fields.keys() or self.fields.keys() - given - self.optional:
            _fail(f"field {min(strange)} is unknown or missing")
        found = {name: self.fields[name](value[name]) for name in self.fields if name in given}
        if self.rule:
            self.rule(found)
        return found

    @property
    def schema(self) -> dict:
        own = {"type": "object", "properties": {name: kind.schema for name, kind in self.fields.items()}, "required": [name for name in self.fields if name not in self.optional], "additionalProperties": False}
        return own | (self.stated or {})


def json_schema(shape: Shape) -> dict:
    """JSON Schema of a document. Byte limits, doubled fields and the spelling of numbers are for `load` alone."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **shape.schema}



def _decision_rule(d: dict) -> None:
    if (d["action"] == "skip") != (d["targetPath"] is None) or d["targetPath"] == "":
        _fail("a path is given exactly where the entry stays, and is not empty")


def _plan_rule(p: dict) -> None:
    _options(p["targetOptions"]).checked(policy(p["profileId"]))
    if p.get("unicodeVersion", unicodedata.unidata_version) != unicodedata.unidata_version or p.get("profileVersion", VERSION) != VERSION:
        _fail("made under other rules")


def _result_rule(r: dict) -> None:
    """Counts are known together or not at all, and where they are not, a failure says why."""
    unknown = {name for name in ("actualFiles", "actualDirectories", "actualBytes") if r[name] is None}
    explained = any(d["code"] == "ACTUAL_COUNTS_UNAVAILABLE" for d in r["diagnostics"])
    if unknown and not (len(unknown) == 3 and explained and r["status"] != "verified"):
        _fail("counts are missing without a failure that explains it")


def _options(given: dict) -> Options:
    return Options(given["rootUnits"], given["componentLimit"], given["pathLimit"], given["directoryPathLimit"], given["unicodeVersion"])


def profile_document(target: Policy) -> dict:
    rules = [[rule.name, rule.certainty] for rule in target.rules]
    limits = {"componentLimit": target.component_limit, "pathLimit": target.path_limit, "directoryPathLimit": target.directory_path_limit}
    return {"profileId": target.profile_id, **limits, "units": target.units, "rules": rules, "version": VERSION}


def _report_rule(r: dict) -> None:
    _options(r["options"]).checked(policy(r["profile"]["profileId"]))


def _profile(value: object) -> dict:
    found = [p for p in map(profile_document, POLICIES.values()) if dump(p) == dump(value)]
    return found[0] if found else _fail("not a published profile")


_COUNTS = ("actualFiles", "actualDirectories", "actualBytes")
_NULL = {"type": "null"}
#: A path is given exactly where the entry stays.
_DECIDED = {
    "oneOf": [
        {"properties": {"action": {"const": "skip"}, "targetPath": _NULL}},
        {"properties": {"action": {"enum": ["keep", "rename"]}, "targetPath": {"type": "string", "minLength": 1}}},
    ]
}
#: All counts are known, or none is and a failure says why.
_COUNTED = {
    "oneOf": [
        {"properties": {name: {"not": _NULL} for name in _COUNTS}},
        {
            "properties": dict.fromkeys(_COUNTS, _NULL)
            | {"status": {"not": {"const": "verified"}}, "diagnostics": {"contains": {"properties": {"code": {"const": "ACTUAL_COUNTS_UNAVAILABLE"}}}}}
        },
    ]
}


def _lowered(options: str, profile: Callable[[Policy], dict]) -> dict:
    """One case a published profile: its limits can be lowered, never raised."""
    most = lambda p: {"componentLimit": p.component_limit, "pathLimit": p.path_limit, "directoryPathLimit": p.directory_path_limit}
    limits = lambda p: {name: maybe(up_to(limit)).schema for name, limit in most(p).items()}
    return {"oneOf": [{"properties": {**profile(p), options: {"properties": limits(p)}}} for p in POLICIES.values()]}


_PLAN_LIMITS = _lowered("targetOptions", lambda p: {"profileId": {"const": p.profile_id}})
_REPORT_LIMITS = _lowered("options", lambda p: {"profile": {"properties": {"profileId": {"const": p.profile_id}}}})

CERTAINTY = one_of("config_rule", "approximation", "advisory")
OPTIONS = Shape({"rootUnits": size, "componentLimit": maybe(count), "pathLimit": maybe(count), "directoryPathLimit": maybe(count), "unicodeVersion": text})
DECISION = Shape({"entryId": text, "action": one_of("keep", "rename", "skip"), "targetPath": maybe(text), "encodingCandidateId": maybe(text), "nameConfirmed": flag, "reason": maybe(text)}, rule=_decision_rule, stated=_DECIDED)
DIRECTORY = Shape({"nodeId": text, "targetPath": text})
DIAGNOSTIC = Shape({"code": text, "severity": one_of("info", "warning", "error"), "entryIds": many(text), "details": mapping(text), "certainty": CERTAINTY})
MAPPING = Shape(
    {"archiveId": text, "profileId": text, "targetOptions": OPTIONS, "decisions": many(DECISION), "directoryMappings": many(DIRECTORY), "schemaVersion": only(1)},
    frozenset({"directoryMappings"}),
    _plan_rule,
    _PLAN_LIMITS,
)
PLAN = Shape(
    {
        "planId": text, "archiveId": text, "profileId": text, "profileVersion": text, "unicodeVersion": text, "targetOptions": OPTIONS, "decisions": many(DECISION),
        "directoryMappings": many(DIRECTORY), "resolvedPaths": mapping(text), "extractable": flag, "diagnostics": many(DIAGNOSTIC), "remainingAdvisories": many(DIAGNOSTIC), "schemaVersion": only(1),
    },
    rule=_plan_rule,
    stated=_PLAN_LIMITS,
)
WRITTEN = Shape({"entryId": maybe(text), "targetPath": text, "kind": one_of("file", "directory"), "size": size, "crc32": maybe(count), "sha256": maybe(text)})
CLEANUP = Shape({"state": one_of("not_created", "removed", "retained_ownership_unknown", "cleanup_failed", "not_needed"), "removedFiles": count, "removedDirectories": count, "diagnostics": many(DIAGNOSTIC)})
RESULT = Shape(
    {
        "status": one_of("verified", "failed", "unsupported_host"), "planId": text, "archiveId": text, "hostBackend": text, "actualFiles": maybe(count), "actualDirectories": maybe(count),
        "actualBytes": maybe(size), "entries": many(WRITTEN), "skippedEntryIds": many(text), "diagnostics": many(DIAGNOSTIC), "cleanup": CLEANUP, "schemaVersion": only(1),
    },
    rule=_result_rule,
    stated=_COUNTED,
)
# Reports.
RAW = Shape(
    {
        "entryId": text, "index": count, "centralOffset": size, "rawNameBase64": octets, "rawExtraBase64": octets, "flags": count, "method": count, "crc32": count,
        "compressedBytes": size, "declaredBytes": size, "localOffset": size, "createSystem": count, "externalAttr": count,
    }
)
CANDIDATE = Shape({"candidateId": text, "text": maybe(text), "source": text, "valid": flag, "evidence": many(text), "certainty": CERTAINTY})
ENTRY = Shape(
    {
        "entryId": text, "index": count, "raw": RAW, "candidates": many(CANDIDATE), "selectedCandidateId": maybe(text), "defaultDisplayName": maybe(text),
        "nameState": one_of("unambiguous", "ambiguous", "selected", "blocked", "nonstandard"), "entryType": one_of("file", "directory", "symlink", "special", "contradictory"),
        "sourceParts": many(text), "componentUnits": many(count), "pathUnits": maybe(size), "diagnosticIds": many(text),
    }
)
FOLDER = Shape({"nodeId": text, "sourceParts": many(text), "ownerEntryId": text, "parentNodeId": maybe(text), "descendantEntryIds": many(text), "explicitEntryIds": many(text)})
GROUP = Shape(
    {
        "groupId": text, "ruleId": text, "entryIds": many(text), "nodeIds": many(text), "originalKeys": many(text), "comparisonKey": text,
        "firstDifferentComponent": count, "impact": text, "certainty": CERTAINTY,
    }
)
# The hard limits of a scan, as reports state them.
SCAN_LIMITS = Shape(
    {
        "archiveBytes": size_up_to(8 << 30), "centralBytes": size_up_to(16 << 20), "entries": up_to(50_000), "nameBytes": size_up_to(4096), "depth": up_to(64),
        "groupMembers": up_to(200_000), "planBytes": size_up_to(16 << 20), "exportBytes": size_up_to(64 << 20), "seconds": up_to(30),
    }
)
REPORT = Shape(
    {
        "archiveId": text, "runtime": mapping(text), "profile": Kind(_profile, {"enum": [profile_document(p) for p in POLICIES.values()]}), "options": OPTIONS, "complete": flag,
        "state": one_of("ok", "findings", "incomplete", "invalid", "unsupported", "stale"), "entries": many(ENTRY), "logicalDirectories": many(FOLDER), "collisionGroups": many(GROUP),
        "summary": mapping(count), "limits": SCAN_LIMITS, "diagnostics": many(DIAGNOSTIC), "schemaVersion": only(1), "contentVerified": only(False), "localHeadersVerified": only(False),
        "transformations": many(Shape({"reasonCodes": many(text), "entryIds": many(text)})),
    },
    rule=_report_rule,
    stated=_REPORT_LIMITS,
)
SHAPES = {"mapping": MAPPING, "plan": PLAN, "result": RESULT, "report": REPORT}


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    return out if len(out) == len(pairs) else _fail("a field comes twice")


def _integer(token: str) -> int:
    return int(token) if _WHOLE.fullmatch(token) else _fail("an integer with leading zeros or a sign")


def load(source: str, shape: Shape, *, max_bytes: int = PLAN_BYTES, too_long: str = "PLAN_INPUT_LIMIT") -> dict:
    """The fields of a document, sizes as integers."""
    if type(source) is not str or len(source) > max_bytes or len(source.encode()) > max_bytes:
        _fail(too_long)
    try:
        return shape(json.loads(source, object_pairs_hook=_unique, parse_int=_integer, parse_constant=lambda _: _fail("not a finite number")))
    except (TypeError, RecursionError, UnicodeError) as error:
        raise ValueError("not a JSON document") from error


def load_report(source: str, *, max_bytes: int = EXPORT_BYTES) -> dict:
    """The fields of a report, sizes as integers and raw names as bytes. A report never allows an extraction."""
    return load(source, REPORT, max_bytes=max_bytes, too_long="REPORT_INPUT_LIMIT")


def _bounded(parts: Iterable[str], room: int) -> Iterator[str]:
    for part in parts:
        room -= len(part)
        yield part if room >= 0 else _fail("EXPORT_LIMIT")


def dump(value: object, *, max_bytes: int = EXPORT_BYTES) -> str:
    """ASCII JSON with sorted keys and no blanks; stops as soon as it is too long."""
    encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"), allow_nan=False)
    return "".join(_bounded(encoder.iterencode(value), max_bytes))


def write_new(path: str, content: str, *, inputs: tuple[str, ...] = ()) -> None:
    """Writes a file that must not exist and is no input."""
    if os.path.realpath(path) in {os.path.realpath(p) for p in inputs}:
        _fail("OUTPUT_EQUALS_INPUT")
    try:
        with open(path, "x", encoding="utf-8", newline="\n") as out:
            out.write(content + "\n")
    except FileExistsError:
        raise ValueError("OUTPUT_ALREADY_EXISTS") from None


def options_document(options: Options) -> dict:
    limits = {"componentLimit": options.component_limit, "pathLimit": options.path_limit, "directoryPathLimit": options.directory_path_limit}
    return {"rootUnits": str(options.root_units), **limits, "unicodeVersion": options.unicode_version}


def mapping_document(archive_id: str, profile_id: str, options: Options, decisions: list[dict], directories: list[dict]) -> str:
    """A plan as its document, from rows of decisions and directory mappings."""
    camel = lambda d, names: {to: d.get(own) for own, to in names.items()}
    fields = {"entry_id": "entryId", "action": "action", "target_path": "targetPath", "encoding_candidate_id": "encodingCandidateId", "name_confirmed": "nameConfirmed", "reason": "reason"}
    rows = [camel(d, fields) for d in decisions]
    folders = [camel(d, {"node_id": "nodeId", "target_path": "targetPath"}) for d in directories]
    return dump({"schemaVersion": 1, "archiveId": archive_id, "profileId": profile_id, "targetOptions": options_document(options), "decisions": rows, "directoryMappings": folders})
