"""Similarity self-join of documents on sets of word n-grams.

1. Every document gets its set of word n-gram hashes, a 128-bit key of that set,
   and a MinHash signature cut into bands. Documents with equal sets are copies:
   from here on one set stands for them, whatever their number.
2. The band hashes are shuffled; a band hash shared by several sets links each to
   the least of them, never each to each. Connected sets are a candidate component.
3. The texts of the sets in components, and only these, are fetched once, and
   every pair inside a component is verified on the full n-gram sets. A component
   beyond a fixed size is dealt into blocks, and each pair of blocks is a task of
   its own. Tasks return a row for each set (links found, root of its group), not pairs.
4. The verified links are joined into classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups
from .graph import components
from .store import Table, release
from .text import WordHashes, mixed, raw_texts, shingles, slices, words

#: Sets, and n-grams of sets, in a block of a large component.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 18
_STRIPE = 2048


def bands_for(threshold: float, recall: float = 0.995, permutations: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall at the threshold."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = (bands, rows)
    return best


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def gram_set(hashes: WordHashes, raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text."""
    return np.unique(shingles(hashes.of(words(raw)), width))


def set_key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _sign(batches: Iterator[pa.RecordBatch], *, width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    a, b = _coefficients(bands * rows)
    place = mixed(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32))
    hashes = WordHashes()
    for batch in slices(batches):
        keys, sizes, signed = [], [], []
        for raw in raw_texts(batch.column("text")):
            grams = gram_set(hashes, raw, width)
            keys.append(set_key(grams))
            sizes.append(len(grams))
            if not len(grams):
                signed.append(None)
                continue
            short = (grams >> np.uint64(32)).astype(np.uint32)
            least = np.full(bands * rows, 0xFFFFFFFF, dtype=np.uint32)
            for low in range(0, len(short), _STRIPE):
                np.minimum(least, (short[low : low + _STRIPE, None] * a + b).min(axis=0), out=least)
            value = place.copy()
            for column in least.reshape(bands, rows).T:
                value = mixed(value ^ column.astype(np.uint64))
            signed.append(value.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))],
            ["doc_id", "digest", "set_key", "n_grams", "bands"],
        )


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, ratio: tuple[int, int]) -> np.ndarray:
    """Which sets of `left` are similar to which of `right` (or of `left` itself): a boolean matrix."""
    sides = [left, left if right is None else right]
    both = left if right is None else left + right
    values, column, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = counts > 1  # an n-gram of one set alone is in no intersection
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n, m = len(sides[0]), len(sides[1])
    common = np.zeros((n, m), dtype=np.float32)
    total = int(shared.sum())
    edges = np.searchsorted(column, np.arange(0, total + _STRIPE, _STRIPE))
    for k in range(len(edges) - 1):
        part = np.zeros((len(both), min(_STRIPE, total - k * _STRIPE)), dtype=np.float32)
        part[owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * _STRIPE] = 1
        common += part[:n] @ (part if right is None else part[n:]).T
    sizes = [np.array([len(x) for x in side], dtype=np.float64) for side in sides]
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common * float(ratio[1]) >= union * ratio[0]


def _roots(linked: np.ndarray) -> np.ndarray:
    """Index of the first node of each node's component, from a symmetric adjacency matrix."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        front = np.array([start])
        root[start] = start
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = start
    return root


def _verify(batches: Iterator[pa.RecordBatch], *, width: int, ratio: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for table in groups.runs(batches, "task"):
        found: dict[bytes, tuple[np.ndarray, int, int]] = {}
        for key, block, copies, raw in zip(table["set_key"].to_pylist(), table["block"].to_pylist(), table["copies"].to_pylist(), table["raw"].to_pylist()):
            grams = gram_set(hashes, raw, width)
            if set_key(grams) == key:  # a doc_id that stands for several texts brings the others along
                found[key] = (grams, block, copies)
        blocks = sorted({block for _, block, _ in found.values()})
        first = [k for k in sorted(found) if found[k][1] == blocks[0]]
        second = [k for k in sorted(found) if found[k][1] != blocks[0]]
        crossed = table["crossed"][0].as_py()
        if not found or crossed and not second:
            continue
        if crossed:
            part = _linked([found[k][0] for k in first], [found[k][0] for k in second], ratio)
            n = len(first)
            linked = np.zeros((n + len(second),) * 2, dtype=bool)
            linked[:n, n:], linked[n:, :n] = part, part.T
        else:
            linked = _linked([found[k][0] for k in first], None, ratio)
            np.fill_diagonal(linked, False)
        keys = first + second
        links = linked @ np.array([found[k][2] for k in keys], dtype=np.float64)
        roots = [keys[k] for k in _roots(linked)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(roots, pa.binary()), pa.array(links.astype(np.int64))], ["set_key", "root", "links"])


def ngram_classes(
    docs: DataFrame,
    *,
    width: int = 5,
    threshold: float = 0.8,
    recall: float = 0.995,
    permutations: int = 256,
) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text): doc_id, digest (MD5 of the text), class_id, class_digest, n_links, n_copies.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word
    n-grams is at least `threshold`; n_links counts the documents linked to a
    row, copies among them, without itself. n_copies counts the rows with the
    same set of n-grams, itself included. Linked documents form a class, directly
    or through others; class_id is its least doc_id and class_digest that document's.

    Bands and rows are chosen for `recall` of the pairs at the threshold itself;
    inside a candidate component all pairs are verified, which only adds to it.

    Defined cases: a text of fewer than `width` words is one n-gram of all its
    words; a null text, or one without words, is linked to nothing and is a class
    of its own; null doc_ids are kept and name a class only if no member has an
    id; repeated rows are copies of each other; an empty table gives an empty
    table; other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall, permutations)
    ratio = (round(threshold * 10_000), 10_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    sign = partial(_sign, width=width, bands=bands, rows=rows)
    signed = Table(texts.mapInArrow(sign, "doc_id long, digest binary, set_key binary, n_grams long, bands array<long>"), "signed")
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    sets = Table(
        signed.df.where("n_grams > 0").groupBy("set_key").agg(F.min(least).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.max("bands").alias("bands")),
        "sets",
    )
    banded = sets.df.select("set_key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most").drop("most")
    edges = banded.join(shared, "band").where("set_key <> least").select(F.col("set_key").alias("a"), F.col("least").alias("b")).distinct()
    candidates = Table(
        components(edges).join(sets.df.drop("bands"), F.col("node") == F.col("set_key")).select("set_key", "component", "rep", "copies", "n_grams"), "candidates"
    )
    sizes = candidates.df.groupBy("component").agg(F.sum("n_grams").alias("grams"), F.count(F.lit(1)).alias("members"))
    blocks = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("members") / BLOCK_SETS))
    dealt = (
        candidates.df.join(sizes.select("component", blocks.alias("blocks")), "component")
        .withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
        .select("set_key", "component", "copies", "blocks", "block", F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    )
    fetched = texts.join(dealt, (F.col("digest") == F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    tasks = (
        fetched.select("set_key", "component", "copies", "block", F.encode("text", "UTF-8").alias("raw"), F.explode(others).alias("pair"))
        .select("set_key", "copies", "block", "raw", F.xxhash64("component", "pair.i", "pair.j").alias("task"), "component", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
        .withColumn("task", F.struct("component", "i", "j"))
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .select(F.concat_ws("/", F.hex("component"), F.col("i").cast("string"), F.col("j").cast("string")).alias("task"), (F.col("i") != F.col("j")).alias("crossed"), "set_key", "copies", "block", "raw")
    )
    verified = Table(tasks.mapInArrow(partial(_verify, width=width, ratio=ratio), "set_key binary, root binary, links long"), "verified")
    linked = verified.df.groupBy("set_key").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if sizes.where(blocks > 1).limit(1).count():
        joined = components(verified.df.where("set_key <> root").select(F.col("set_key").alias("a"), F.col("root").alias("b")))
        linked = linked.join(joined, F.col("set_key") == F.col("node"), "left").select("set_key", "links", F.coalesce("component", "set_key").alias("root"))
    candidates_rep = candidates.df.select("set_key", "rep")
    # Read back bare, so that adaptive execution can split the sets of one class in the join.
    classes = Table(linked.join(candidates_rep, "set_key"), "classes")
    named = Table(classes.df.groupBy("root").agg(F.min("rep").alias("class_rep")), "classes")
    placed = Table(classes.df.join(named.df, "root").select("set_key", "class_rep", "links"), "placed")
    of_sets = sets.df.select("set_key", "rep", "copies").join(placed.df, "set_key", "left")
    of_sets = of_sets.select("set_key", F.coalesce("class_rep", "rep").alias("class_rep"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    of_sets = Table(of_sets, "of-sets").df  # read back bare, so that adaptive execution can split the copies of one set in the join
    for table in (candidates, verified, classes, named, placed, sets):
        table.drop()
    release(spark)
    return signed.df.select("doc_id", "digest", "set_key").join(of_sets, "set_key", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("class_rep").isNull(), F.col("doc_id")).otherwise(F.col("class_rep.doc_id")).alias("class_id"),
        F.coalesce("class_rep.digest", "digest").alias("class_digest"),
        (F.coalesce(F.col("links") + F.col("copies"), F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each class of near-duplicates, that of the least doc_id; rows that agree in doc_id and text are one document."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    kept = ngram_classes(docs, **options).where("doc_id <=> class_id AND digest = class_digest").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    found = held.join(kept, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return found.dropDuplicates(["id", "digest"]).select("row.*")
