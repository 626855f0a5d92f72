"""The name rules in plain Python, for steps that go through an archive in order (drafting and validating plans)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..plans.policies import Options, Policy
from . import names

_ILLEGAL = re.compile(names.ILLEGAL)
_PORT = re.compile(names.DEVICE_PORT)
_FOLD = str.maketrans(names.UPPER, names.LOWER)
_BIDI = re.compile("[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")

_KEY = {
    "exact": lambda s: s,
    "ascii-case": lambda s: s.translate(_FOLD),
    "windows-trim": lambda s: s.rstrip(" .").translate(_FOLD),
    "casefold": str.casefold,
    "nfc": lambda s: unicodedata.normalize("NFC", s),
    "nfc-casefold": lambda s: unicodedata.normalize("NFC", s.casefold()),
}


@lru_cache(1 << 16)
def key(component: str, rule: str) -> str:
    return _KEY[rule](component)


def measure(text: str, target: Policy) -> int:
    return len(text.encode("utf-16-le")) // 2 if target.windows else len(text.encode())


def is_device(component: str) -> bool:
    base = component.partition(".")[0].rstrip(" .").upper()
    return base in names.DEVICES or bool(_PORT.match(base))


def path_problems(parts: tuple[str, ...], directory: bool, target: Policy, options: Options) -> set[str]:
    """Codes of a path under a policy whose root is known, or taken to be of the least length."""
    found = set()
    longest = options.limit("component_limit", target)
    limit = options.limit("directory_path_limit" if directory else "path_limit", target)
    if any(measure(p, target) > longest for p in parts):
        found.add("COMPONENT_LIMIT")
    if target.windows:
        found |= {"WINDOWS_ILLEGAL_CHARACTER" for p in parts if _ILLEGAL.search(p)}
        found |= {"WINDOWS_TRAILING_DOT_SPACE" for p in parts if p.endswith((" ", "."))}
        found |= {"WINDOWS_DEVICE_NAME" for p in parts if is_device(p)}
    if (options.root_units or 1) + measure("/".join(parts), target) > limit:
        found.add("PATH_LIMIT")
    return found


def unsafe(parts: tuple[str, ...], directory: bool, target: Policy, options: Options) -> bool:
    """Whether a target path cannot be taken, its own directory included."""
    return bool(path_problems(parts, directory, target, options) or (not directory and len(parts) > 1 and path_problems(parts[:-1], True, target, options)))


def target_parts(path: str | None) -> tuple[str, ...]:
    """Components of a relative target path; anything else raises."""
    parts = tuple(path.split("/")) if path else ()
    if not parts or {"", ".", ".."} & set(parts) or "\0" in path or "\\" in path or re.match("[A-Za-z]:", path):
        raise ValueError("INVALID_TARGET_PATH")
    path.encode()  # lone surrogates name no portable path
    return parts


def target_warnings(path: str) -> list[str]:
    return [code for code, test in (("TARGET_CONTROL_CHARACTER", _CONTROL), ("TARGET_BIDI_CHARACTER", _BIDI)) if test.search(path)]


def cleaned(name: str, target: Policy) -> tuple[str, tuple[str, ...]]:
    """A name that the policy can take in place of `name`, and why it differs."""
    codes = []
    if target.windows:
        steps = [("WINDOWS_ILLEGAL_CHARACTER", lambda s: _ILLEGAL.sub("_", s)), ("WINDOWS_TRAILING_DOT_SPACE", lambda s: s.rstrip(" .")), ("WINDOWS_DEVICE_NAME", lambda s: "_" + s if is_device(s) else s)]
        for code, step in steps:
            after = step(name)
            if after != name:
                codes.append(code)
            name = after
    if name in ("", ".", ".."):
        return "unnamed", (*codes, "EMPTY_COMPONENT")
    return name, tuple(codes)


def cut(text: str, room: int, target: Policy) -> str:
    """The longest beginning of a text within a number of units."""
    for n, char in enumerate(text):
        room -= measure(char, target)
        if room < 0:
            return text[:n]
    return text


def fitted(name: str, suffix: str, longest: int, target: Policy) -> str:
    """Stem, suffix and extension within a length; the extension keeps 32 units at most and the stem one character at least."""
    stem, dot, rest = name.rpartition(".")
    stem, extension = (stem, dot + rest) if stem else (name, "")
    whole = stem + suffix + extension
    if measure(whole, target) <= longest:
        return whole
    room = longest - measure(suffix, target)
    if room <= 0:
        raise ValueError("SUFFIX_BUDGET_TOO_SMALL")
    extension = cut(extension, min(32, room - 1), target)
    stem = cut(stem, room - measure(extension, target), target)
    if not stem:
        raise ValueError("SUFFIX_BUDGET_TOO_SMALL")
    return stem + suffix + extension


def fitted_clean(name: str, suffix: str, longest: int, target: Policy) -> tuple[str, tuple[str, ...]]:
    """`fitted`, cleaned again until cutting and cleaning agree."""
    codes: list[str] = ["COMPONENT_LIMIT"] if measure(name, target) + measure(suffix, target) > longest else []
    now = fitted(name, suffix, longest, target)
    while (after := cleaned(now, target))[0] != now:
        codes += after[1]
        now = fitted(after[0], "", longest, target)
    return now, tuple(dict.fromkeys(codes))
