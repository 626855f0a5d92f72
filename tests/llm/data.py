"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while many small birds sing near river banks under warm light every morning".split(),
    "fr": "le petit chat noir dort sous une grande table verte avec des enfants qui jouent dehors chaque matin d'été très calme".split(),
}
EXTRA = "score double, predicted int, n_words long, contaminated boolean, digest binary, key string"


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 9)) * (rng.random() < 0.3) for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Plain, copied, nearly copied, empty, null, long and repeated documents."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(k, sentence(rng, rng.choice(["en", "fr"]), rng.randint(8, 120))) for k in range(n)]
    base = rows[0][1].split()
    for k in range(1, 25):
        changed = list(base * 2)
        changed[rng.randrange(len(changed))] = f"edit{k}"
        rows.append((100 + k, " ".join(changed)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, ""), (203, None), (204, "  \n\n "), (205, "one"), (206, "one"), (207, "x " * 30_000), (None, rows[5][1]), (None, None), rows[7], rows[7]]
    return rows


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """The rows with columns whose names the operators use themselves."""
    full = [(i, t, "en", "src", None if t is None else len(t), 9.0, 9, 9, True, bytearray(b"d"), "k") for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
