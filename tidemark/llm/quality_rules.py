"""Quality filtering by learned decision lists over text statistics.

Sequential covering: a rule, a conjunction of thresholds on statistics, is grown
condition by condition on two thirds of the labelled sample, pruned on the rest,
and kept if it is right in at least three of four cases there; the rows it covers are set
aside and the next rule is learned. Rows weigh as much as their label is frequent among all
labelled ones. The list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling
from .text import WordHashes, raw_texts, shingles, with_columns

_SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words"]
_SCHEMA = ", ".join(f"{name} long" for name in BASE + EXTRA)
_IS_UPPER, _IS_DIGIT, _IS_MARK = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"))


def statistics(raw: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    """The statistics of a text, in the order of BASE and EXTRA; all 0 for a null text.

    Words are runs of anything but ASCII white space. n_dup_lines counts lines with a word that equal an
    earlier line, n_repeat_words the words inside a three-word window found twice or more.
    """
    if not raw:
        return (0,) * len(BASE + EXTRA)
    tokens = raw.split()
    letters = np.frombuffer(raw, dtype=np.uint8)
    points = int(((letters & 0xC0) != 0x80).sum())
    blank = sum(raw.count(c) for c in (_WHITE[k : k + 1] for k in range(len(_WHITE))))
    symbols = sum(raw.count(_SYMBOLS[k : k + 1]) for k in range(len(_SYMBOLS)))
    seen: set[bytes] = set()
    lines = raw.split(b"\n")
    doubled = 0
    for line in lines:
        if line in seen:
            doubled += 1
        elif line.split(None, 1):
            seen.add(line)
    repeated, distinct = 0, 0
    if tokens:
        values = hashes.of(tokens)
        distinct = len(np.unique(values))
        if len(tokens) >= 3:
            _, place, count = np.unique(shingles(values, 3), return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[place] > 1)
            inside = np.zeros(len(tokens), dtype=bool)
            for k in range(3):
                inside[at + k] = True
            repeated = int(inside.sum())
    byte_counts = np.bincount(letters, minlength=256)
    kinds = (int(byte_counts[kind].sum()) for kind in (_IS_UPPER, _IS_DIGIT, _IS_MARK))
    return (len(tokens), points - blank, symbols, doubled, repeated, len(lines), *kinds, distinct)


def text_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with the statistics of its whole texts added."""

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        hashes = WordHashes()
        return lambda batch: [pa.array(c, pa.int64()) for c in zip(*(statistics(raw, hashes) for raw in raw_texts(batch.column("text"))))]

    return with_columns(docs, _SCHEMA, start)


#: Features as a ratio (over, under) of statistics; None stands for 1.
FEATURES: dict[str, tuple[str, str | None]] = {
    "n_words": ("n_words", None),
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_words": ("n_distinct_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        over, under = FEATURES[self.feature]
        value = F.col(over).cast("double") if under is None else F.col(over) / F.greatest(F.col(under), F.lit(1))
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def feature_table(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Feature values from rows of statistics."""
    of = {name: rows[:, k].astype(float) for k, name in enumerate(BASE + EXTRA)}
    return {name: of[over] if under is None else of[over] / np.maximum(of[under], 1) for name, (over, under) in FEATURES.items()}


def _covered(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), dtype=bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, longest: int) -> Rule:
    """Adds the condition of the greatest information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad[inside]).any():
        p0, n0 = weight[inside & bad].sum(), weight[inside].sum()
        best, chosen = 1e-9, None
        for feature, values in table.items():
            cuts = np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, 33)))
            for threshold in cuts.tolist():
                for above in (True, False):
                    held = inside & (values >= threshold if above else values <= threshold)
                    p, n = weight[bad & held].sum(), weight[held].sum()
                    gain = p * (np.log2(p / n) - np.log2(p0 / n0)) if p else 0
                    if gain > best:
                        best, chosen = gain, Condition(feature, above, threshold)
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(table)
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most on rows it was not grown on."""

    def worth(part: Rule) -> float:
        held = _covered(part, table)
        p, n = weight[bad & held].sum(), weight[~bad & held].sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part))) if rule else rule


def learn(rows: np.ndarray, bad: np.ndarray, weight: np.ndarray | None = None, *, longest: int = 4, most: int = 16, precision: float = 0.75, seed: int = 3) -> list[Rule]:
    """An ordered list of rules that tell bad rows; a third of the rows is held back for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    weight = np.ones(len(bad)) if weight is None else weight
    third = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    table = feature_table(rows)
    part = lambda mask: {name: values[mask] for name, values in table.items()}
    while len(rules) < most and (bad & left & ~third).any():
        grow, prune = left & ~third, left & third
        rule = _prune(_grow(part(grow), bad[grow], weight[grow], longest), part(prune), bad[prune], weight[prune])
        held = _covered(rule, part(prune)) if rule else np.zeros(int(prune.sum()), dtype=bool)
        if not held.any() or weight[prune][held & bad[prune]].sum() < precision * weight[prune][held].sum():
            break
        rules.append(rule)
        left &= ~_covered(rule, table)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: false at the first rule that fits, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(labelled: DataFrame, docs: DataFrame, *, per_label: int = 3000) -> list[Rule]:
    """Rules for the documents labelled 0, from at most `per_label` documents of each label."""
    known = labelled.where("label IN (0, 1)")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = sampling.sample(known, docs, per_label=per_label)
    hashes = WordHashes()
    rows = np.array([statistics(text.encode(), hashes) for _, text in drawn], dtype=np.int64).reshape(-1, len(BASE + EXTRA))
    bad = np.array([label == 0 for label, _ in drawn], dtype=bool)
    return learn(rows, bad, np.where(bad, totals.get(0, 0) / max(1, bad.sum()), totals.get(1, 0) / max(1, (~bad).sum())))


def judge_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with the statistics, base_failed and kept added (replacing columns of such names).

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows. kept: false if base_failed, else the verdict of the rules.
    Defined cases: a null text has statistics of 0 and fails the base rules, as
    does an empty one; repeated rows are each judged; without rules every row that passes
    the base rules is kept; ratios over nothing are taken over 1; other columns pass through.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = text_statistics(docs.drop("base_failed", "kept")).withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules))
