"""Removal of lines that recur across documents, with DataFrame functions only.

Line hashes live in levelled sorted runs, as in a log-structured merge tree. A run holds, for each
hash that its batches brought, the documents counted and whether the hash has reached the threshold:

* a batch of documents is reduced to (hash, documents) and merge-joined with every run: hashes that
  a run has as reached are dropped (the anti-join), the others learn how many documents the runs have counted;
* what is left becomes a new run at level 0, its hashes marked as reached where both together reach the threshold;
* when a level holds `fanout` runs they are merged into one run of the next level.

All runs are bucketed and sorted alike, so neither the joins nor the merges shuffle a run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Bucketed, Table, buckets, release

#: Batches of a table that comes as a whole, and hashes in one of them beyond which there are more.
BATCHES, BATCH_HASHES = 6, 100_000_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased; `lower` is the fast way and agrees on ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """The key of each line: stripped of ASCII white space and A-Z lower-cased."""
    return F.transform(text_lines(folded(text)), lambda line: F.trim(line, F.lit(_SPACE)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def line_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (h) per row of `docs` and distinct key of a code point or more."""
    keys = F.array_distinct(F.filter(line_keys(F.col(text_col)), lambda key: key != ""))
    return docs.select(F.explode(keys).alias("key")).select(_hash(F.col("key")).alias("h"))


class LineRuns:
    """Document counts of line hashes in levelled sorted runs (columns `h` binary, `n` long, `reached` boolean).

    `joined` and `compacted` count the merge-anti-joins of a batch with a run and the compactions so far.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, count: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = count or buckets(spark)
        self.levels: list[list[Bucketed]] = []
        self.joined = self.compacted = 0

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Counts a batch: each row of `docs` is a document and counts a key once, however often it repeats."""
        self.add_hashes(line_hashes(docs, text_col))

    def add_hashes(self, hashes: DataFrame) -> None:
        """Counts a batch given as the rows of `line_hashes`."""
        batch = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.lit(0).cast("long"))
        for run in (run for level in self.levels for run in level):
            known = run.df.hint("merge").select("h", F.col("n").alias("m"), "reached")
            batch = batch.join(known, "h", "left").where("reached IS NULL OR NOT reached")
            batch = batch.select("h", "n", (F.col("before") + F.coalesce("m", F.lit(0))).alias("before"))
            self.joined += 1
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(Bucketed(batch.select("h", "n", (F.col("n") + F.col("before") >= self.min_docs).alias("reached")), "run", "h", self.buckets))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1
        release(self.spark)

    def _compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next; a hash has reached the threshold if it has in any of them."""
        runs, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(Bucketed(reduce(_merged, [run.df for run in runs]), "run", "h", self.buckets))
        for run in runs:
            run.drop()
        self.compacted += 1

    def settled(self) -> DataFrame:
        """Hashes (h) found in at least `min_docs` documents: the batch that brings a hash over the threshold marks it."""
        found = [run.bare.where("reached").select("h") for level in self.levels for run in level]
        return reduce(DataFrame.unionAll, found).distinct() if found else self.spark.createDataFrame([], "h binary")

    def drop(self) -> None:
        for run in (run for level in self.levels for run in level):
            run.drop()
        self.levels = []


def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of what is sorted already; each task keeps to its bucket, so nothing is dealt again."""
    right = right.hint("merge").select("h", F.col("n").alias("m"), F.col("reached").alias("also"))
    both = left.join(right, "h", "full_outer")
    return both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), (F.coalesce("reached", F.lit(False)) | F.coalesce("also", F.lit(False))).alias("reached"))


def _arrivals(docs: DataFrame, text_col: str) -> tuple[Table, int]:
    """The line hashes of a whole table with the number (slice) of the batch that each row belongs to, from one scan; and how many batches there are."""
    parts = 1024
    keys = F.array_distinct(F.filter(line_keys(F.col(text_col)), lambda key: key != ""))
    staged = docs.select((F.monotonically_increasing_id() % parts).cast("int").alias("slice"), F.explode(keys).alias("key")).select("slice", _hash(F.col("key")).alias("h"))
    table = Table(staged.sortWithinPartitions("slice"), "arrivals")  # sorted, so that a batch reads its own row groups
    return table, min(parts, max(BATCHES, -(-table.df.count() // BATCH_HASHES)))


def drop_common_lines(
    docs: DataFrame,
    *,
    batches: Sequence[DataFrame] | None = None,
    text_col: str = "text",
    min_docs: int = 10,
    fanout: int = 4,
    broadcast_hashes: int = 200_000,
    runs: LineRuns | None = None,
) -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept_text added (or replaced, if it has such columns).

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of one code point or more found in `min_docs` rows or more lose all
    their lines in every row; the other lines stay, joined by a newline.
    `batches` are the same rows as `docs`, in the order they arrived. If not given, the rows are dealt into
    BATCHES batches or more, each of BATCH_HASHES lines or fewer, from one scan. `runs` are empty runs to use.

    Defined cases: a null or empty text is one empty line, which stays; blank
    lines always stay; a text that loses all its lines is kept as an empty text;
    a repeated row is another document; an empty table gives an empty table.
    The settled hashes are broadcast up to `broadcast_hashes` and joined by shuffle beyond.
    """
    runs = runs or LineRuns(docs.sparkSession, min_docs, fanout)
    if batches is None:
        arrivals, number = _arrivals(docs, text_col)
        for k in range(number):
            low, high = (1024 * x // number for x in (k, k + 1))
            runs.add_hashes(arrivals.df.where((F.col("slice") >= low) & (F.col("slice") < high)).select("h"))
        arrivals.drop()
    else:
        for batch in batches:
            runs.add(batch, text_col)
    settled = Table(runs.settled(), "settled").df
    runs.drop()
    if settled.count() <= broadcast_hashes:
        settled = F.broadcast(settled)
    text_key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    hits = (
        docs.select(text_key.alias("__key"), F.posexplode(line_keys(F.col(text_col))).alias("__pos", "__line"))
        .where("__line <> ''")
        .select("__key", "__pos", _hash(F.col("__line")).alias("h"))
        .join(settled, "h")
        .groupBy("__key")
        .agg(F.array_sort(F.collect_set(F.col("__pos") + 1)).alias("__hits"))
        .withColumnRenamed("__key", "__hit_key")
    )
    hits = Table(hits, "line-hits").df  # read back bare, so that adaptive execution can split the copies of one text in the join
    lines = text_lines(F.col(text_col))
    kept_lines = lambda xs, edges: F.flatten(  # noqa: E731  the stretches between the dropped lines
        F.transform(
            F.sequence(F.lit(2), F.size(edges)),
            lambda k: F.slice(xs, F.element_at(edges, k - 1) + 1, F.element_at(edges, k) - F.element_at(edges, k - 1) - 1),
        )
    )
    edges = F.concat(F.array(F.lit(0)), F.col("__hits"), F.array(F.size("__lines") + 1))
    kept = F.when(F.col("__hits").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept_lines(F.col("__lines"), edges), "\n"))
    n_lines = F.size("__lines").cast("long")
    added = {"n_lines": n_lines, "n_dropped": F.when(F.col("__hits").isNull(), F.lit(0)).otherwise(F.size("__hits")).cast("long"), "kept_text": kept}
    own = [c for c in docs.columns if c not in added]
    return (
        docs.withColumn("__key", text_key)
        .join(hits, F.col("__key") == F.col("__hit_key"), "left")
        .withColumn("__lines", lines)
        .select(*own, *[column.alias(name) for name, column in added.items()])
    )
