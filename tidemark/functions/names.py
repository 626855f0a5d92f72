"""Checks and comparison keys of entry names, as Catalyst expressions wherever Spark has them.

Case folding and NFC exist in Python only; `comparison_path` sends them just the rows with non-ASCII names.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.policies import Options, Policy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Codes that block an entry, and codes that only warn.
BLOCKING = ["EMPTY_NAME", "NUL_NAME", "ABSOLUTE_OR_DEVICE_PATH", "PATH_TRAVERSAL"]
ADVISORY = ["PATH_ROOT_UNKNOWN", "ENCODING_AMBIGUOUS", "UNKNOWN_CREATE_SYSTEM", "CONTROL_CHARACTER", "BIDI_CHARACTER", "DECLARED_RATIO_RISK"]
# Names that Windows keeps for devices.
DEVICES = ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$"]
DEVICE_PORT = "^(COM|LPT)[1-9¹²³]$"
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
_BIDI = "[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"


def codes(*tests: tuple[str, Column]) -> Column:
    """The codes whose test holds, in the order given."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))


def without_slash(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("/")), F.left(text, F.length(text) - 1)).otherwise(text)


def path_evidence(text: Column) -> Column:
    """Codes of a decoded name: escapes, device paths, backslashes, empty or dot components, control and bidi characters."""
    alternate = F.translate(text, "\\", "/")
    components = F.split(without_slash(text), "/", -1)
    return codes(
        ("EMPTY_NAME", text == ""),
        ("NUL_NAME", F.contains(text, F.lit("\0"))),
        ("ABSOLUTE_OR_DEVICE_PATH", alternate.rlike("^(/|[A-Za-z]:)")),
        ("PATH_TRAVERSAL", F.array_contains(F.split(alternate, "/", -1), "..")),
        ("BACKSLASH_PATH", F.contains(text, F.lit("\\"))),
        ("NONSTANDARD_COMPONENT", F.array_contains(components, ".") | F.array_contains(components, "")),
        ("CONTROL_CHARACTER", text.rlike(r"[\x00-\x1f\x7f]")),
        ("BIDI_CHARACTER", text.rlike(_BIDI)),
    )


def entry_type(text: Column, create_system: Column, external_attr: Column) -> tuple[Column, Column]:
    """(type, codes) of an entry. A Unix mode counts for the creators 3 and 19 only; attributes are unsigned 32-bit numbers in a long."""
    directory = F.coalesce(F.endswith(text, F.lit("/")), F.lit(False))
    dos = external_attr.bitwiseAND(F.lit(0x10)) != 0
    unix = create_system.isin(3, 19)
    mode = F.shiftrightunsigned(external_attr, 16).bitwiseAND(F.lit(0o170000))
    is_file, is_dir = mode == 0o100000, mode == 0o040000
    clash = (unix & ((is_file & directory) | (is_dir & ~directory))) | (dos & ~directory)
    kind = (
        F.when(unix & (mode == 0o120000), "symlink")
        .when(unix & ~(is_file | is_dir | (mode == 0)), "special")
        .when(clash, "contradictory")
        .when(directory, "directory")
        .otherwise("file")
    )
    found = codes(
        ("UNKNOWN_CREATE_SYSTEM", ~create_system.isin(0, 3, 19)),
        ("MISSING_DIRECTORY_METADATA", directory & ~dos & ~(unix & is_dir)),
    )
    special = F.when(kind.isin("symlink", "special"), F.array(F.lit("SPECIAL_TYPE"))).when(kind == "contradictory", F.array(F.lit("TYPE_CONFLICT")))
    return kind, special.otherwise(found)


def measure(text: Column, target: Policy) -> Column:
    """Length in the policy's units: UTF-16 code units or UTF-8 bytes."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int") if target.windows else F.octet_length(text)


def is_device(component: Column) -> Column:
    base = F.upper(F.rtrim(F.substring_index(component, ".", 1), F.lit(" .")))
    return base.isin(DEVICES) | base.rlike(DEVICE_PORT)


def check_path(parts: Column, directory: Column, target: Policy, options: Options) -> Column:
    """Codes of a path under a policy, each once, in order of first appearance."""
    longest = options.limit("component_limit", target)
    found = [codes(("COMPONENT_LIMIT", F.exists(parts, lambda p: measure(p, target) > longest)))]
    if target.windows:
        each = lambda p: codes(
            ("WINDOWS_ILLEGAL_CHARACTER", p.rlike(ILLEGAL)),
            ("WINDOWS_TRAILING_DOT_SPACE", p.rlike(r"[ .]\z")),
            ("WINDOWS_DEVICE_NAME", is_device(p)),
        )
        found.append(F.flatten(F.transform(parts, each)))
    if options.root_units:
        limit = F.when(directory, options.limit("directory_path_limit", target)).otherwise(options.limit("path_limit", target))
        found.append(codes(("PATH_LIMIT", F.lit(options.root_units) + measure(F.array_join(parts, "/"), target) > limit)))
    else:
        found.append(F.array(F.lit("PATH_ROOT_UNKNOWN")))
    return F.array_distinct(F.concat(*found))


def size_risk(declared: Column, compressed: Column) -> Column:
    """The code of a size that content could not or should not have, or null."""
    return F.when((declared > 0) & (compressed == 0), "ZERO_COMPRESSED_NONZERO_OUTPUT").when(declared > compressed * 100, "DECLARED_RATIO_RISK")


def severity(code: Column) -> Column:
    return F.when(code.isin(ADVISORY), "warning").otherwise("error")


def certainty(code: Column) -> Column:
    return F.when(code.isin(ADVISORY), "advisory").otherwise("config_rule")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def native_key(component: Column, rule: str) -> Column:
    """The comparison key of one component under a rule that Spark can express; for ASCII that is every rule."""
    if rule in ("exact", "nfc"):
        return component
    if rule == "windows-trim":
        component = F.rtrim(component, F.lit(" ."))
    return F.translate(component, UPPER, LOWER)


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s.casefold()), na_action="ignore")


_IN_PYTHON = {"casefold": casefold, "nfc": nfc, "nfc-casefold": nfc_casefold}


def comparison_path(df: DataFrame, parts: str, rule: str, out: str = "key") -> DataFrame:
    """`df` with the comparison key of a path, its components' keys joined by slashes.

    Neither folding nor NFC reaches across a slash, so they take the joined path.
    """
    joined = F.array_join(parts, "/")
    native = F.array_join(F.transform(parts, lambda p: native_key(p, rule)), "/")
    if rule not in _IN_PYTHON:
        return df.withColumn(out, native)
    plain = F.coalesce(is_ascii(joined), F.lit(True))  # a null path keeps its row
    return df.where(plain).withColumn(out, native).unionByName(df.where(~plain).withColumn(out, _IN_PYTHON[rule](joined)))


def clean_component(name: Column, target: Policy) -> Column:
    """struct(name, codes): the name a policy can take in place of a component, and why it differs."""
    found = []
    if target.windows:
        replaced = F.regexp_replace(name, ILLEGAL, "_")
        trimmed = F.rtrim(replaced, F.lit(" ."))
        found += [("WINDOWS_ILLEGAL_CHARACTER", replaced != name), ("WINDOWS_TRAILING_DOT_SPACE", trimmed != replaced), ("WINDOWS_DEVICE_NAME", is_device(trimmed))]
        name = F.when(is_device(trimmed), F.concat(F.lit("_"), trimmed)).otherwise(trimmed)
    empty = name.isin("", ".", "..")
    return F.struct(F.when(empty, "unnamed").otherwise(name).alias("name"), codes(*found, ("EMPTY_COMPONENT", empty)).alias("codes"))


def display_escaped(text: Column) -> Column:
    """Text with control and non-ASCII characters visibly replaced, for terminals."""
    return F.regexp_replace(text, r"[^\x20-\x7e]", "?")
