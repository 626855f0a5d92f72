"""Readings of raw entry names."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wire import Rejected, fields_of

CANDIDATE = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("certainty", T.StringType()),
    ]
)
EXTRA_FIELD = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType())])
# The codecs tried on names without a declared encoding, in order, and the kind of the Unicode path field.
CODECS = ["cp437", "utf-8", "gb18030", "cp932", "big5"]
UNICODE_PATH = 0x7075


def _reading(source: str, text: str | None, evidence: Iterable[str] = (), valid: bool = True, certainty: str = "advisory") -> dict:
    evidence = list(evidence)
    said = text if text is not None else "\0".join(evidence)
    return {
        "candidate_id": "c" + hashlib.sha256(f"{source}\0{said}".encode()).hexdigest(),
        "text": text,
        "source": source,
        "valid": valid,
        "evidence": evidence,
        "certainty": certainty,
    }


def _strict(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _path_field(data: bytes, name: bytes) -> tuple[str | None, str | None]:
    """(text, problem) of a Unicode path field."""
    if len(data) < 5 or data[0] != 1:
        return None, "UNICODE_EXTRA_VERSION_OR_LENGTH"
    if int.from_bytes(data[1:5], "little") != zlib.crc32(name):
        return None, "UNICODE_EXTRA_CRC"
    text = _strict(data[5:], "utf-8")
    return text, None if text is not None else "UNICODE_EXTRA_UTF8"


def readings(name: bytes, extra: bytes, flags: int) -> list[dict]:
    """Possible readings of a raw name, the preferred one first. A declared encoding that does not hold is never replaced by a guess."""
    try:
        found = fields_of(extra)
    except Rejected:
        return [_reading("raw", None, ["EXTRA_TRUNCATED"], valid=False)]
    seen = [f"EXTRA_{kind:04X}_LENGTH_{len(data)}" for kind, data in found]
    paths = [_path_field(data, name) for kind, data in found if kind == UNICODE_PATH]
    texts, problems = [t for t, p in paths if p is None], [p for _, p in paths if p is not None]
    declared = _strict(name, "utf-8") if flags & 0x800 else None
    if flags & 0x800 and declared is None:
        return [_reading("utf-8-bit11", None, ["INVALID_UTF8", *seen], valid=False)]
    if len({*texts, *([declared] if declared is not None else [])}) > 1:
        problems.append("UNICODE_EXTRA_CONFLICT")
    if problems:
        return [_reading("unicode-extra", declared, [*problems, *seen], valid=False)]
    if declared is not None:
        return [_reading("utf-8-bit11", declared, seen, certainty="config_rule")]
    if texts:
        return [_reading("unicode-extra", texts[0], seen, certainty="config_rule")]
    by_text: dict[str, dict] = {}
    for codec in CODECS:
        text = _strict(name, codec)
        if text in by_text:
            by_text[text]["evidence"].append(f"ALSO_{codec}")
        elif text is not None:
            by_text[text] = _reading(codec, text, [*seen, *(["SPEC_DEFAULT_NOT_INTENT"] if codec == "cp437" else [])])
    return list(by_text.values())


@F.pandas_udf(T.ArrayType(CANDIDATE))
def decode_candidates(raw_name: pd.Series, raw_extra: pd.Series, flags: pd.Series) -> pd.Series:
    """Readings of names: raw_name and raw_extra binary, flags int."""
    return pd.Series([readings(bytes(n), bytes(x), int(f)) for n, x, f in zip(raw_name, raw_extra, flags)])


@F.pandas_udf(T.ArrayType(EXTRA_FIELD))
def extra_fields(raw_extra: pd.Series) -> pd.Series:
    """The extra fields of a record, or null if they are cut off."""

    def parsed(data: bytes) -> list[dict] | None:
        try:
            return [{"kind": kind, "data": value} for kind, value in fields_of(bytes(data))]
        except Rejected:
            return None

    return raw_extra.map(parsed, na_action="ignore")
