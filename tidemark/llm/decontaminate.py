"""Benchmark passages in documents: a prefix-filtered containment join.

The windows of the benchmark items (10 consecutive words; a shorter item whole)
are sets of shingles. For a window to be contained in a text, all its shingles
must be, so its rarest shingle alone is a sufficient prefix: documents meet the
windows on that shingle only. Rarity is the number of documents with the shingle,
counted over the whole corpus. A meeting place is dropped if the window would
reach over either end of the text (length and position), and is otherwise
verified word by word.

The items are worked off in blocks of a fixed size, so what a task holds and
what is broadcast does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table
from .text import WordHashes, raw_texts, shingles, slices, with_columns, words

#: Bytes of item texts in one block.
BLOCK_BYTES = 8 << 20
_SHINGLE = 3
_BITS = 22


class _Lookup:
    """Positions of known shingle hashes in an array of hashes."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.known >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `values`, places in `known`) of the values that are known."""
        at = np.flatnonzero(self.seen[(values >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.searchsorted(self.known, values[at])
        place[place == len(self.known)] = 0
        hit = self.known[place] == values[at]
        return at[hit], place[hit]


def item_windows(texts: list[tuple[str | None, bytes | None]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of the items, each with the ids of its items; an item without an id names none."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, raw in texts:
        tokens = words(raw)
        size = min(width, len(tokens))
        for k in range(len(tokens) - size + 1 if size else 0):
            found.setdefault(tuple(tokens[k : k + size]), set()).update([item_id] if item_id is not None else [])
    return found


def _count(batches: Iterator[pa.RecordBatch], *, vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each known shingle."""
    hashes = WordHashes()
    looks = {size: _Lookup(known) for size, known in vocabulary.value.items()}
    totals = {size: np.zeros(len(look.known), dtype=np.int64) for size, look in looks.items()}
    for batch in slices(batches):
        for raw in raw_texts(batch.column("text")):
            values = hashes.of(words(raw))
            for size, look in looks.items():
                if len(values) >= size:
                    totals[size][np.unique(look.find(shingles(values, size))[1])] += 1
    for size, look in looks.items():
        held = totals[size] > 0
        if held.any():
            found = [pa.array(np.full(held.sum(), size, dtype=np.int32)), pa.array(look.known[held].view(np.int64)), pa.array(totals[size][held])]
            yield pa.RecordBatch.from_arrays(found, ["size", "shingle", "n"])


class _Index:
    """The windows of a block under their rarest shingle."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], frequency: dict[tuple[int, int], int]):
        hashes = WordHashes()
        self.by_shingle: dict[int, dict[int, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]] = {}
        for window in sorted(windows):
            size = min(_SHINGLE, len(window))
            values = shingles(hashes.of(list(window)), size).tolist()
            rarity = [(frequency.get((size, v), 0), v) for v in values]
            least = min(rarity)
            if least[0]:  # else a shingle of it is in no document
                self.by_shingle.setdefault(size, {}).setdefault(least[1], []).append((rarity.index(least), window, tuple(sorted(windows[window]))))


def _scan(index: Broadcast):
    hashes = WordHashes()
    tables = index.value.by_shingle
    looks = {size: _Lookup(np.array(list(table), dtype=np.uint64)) for size, table in tables.items()}

    def hits(raw: bytes | None, spans: list[tuple[int, int]], items: set[str]) -> int:
        tokens = words(raw)
        values = hashes.of(tokens)
        for size, look in looks.items():
            if len(values) < size:
                continue
            places, known = look.find(shingles(values, size))
            for place, shingle in zip(places.tolist(), look.known[known].tolist()):
                for offset, window, names in tables[size][shingle]:
                    start = place - offset
                    if start >= 0 and start + len(window) <= len(tokens) and tuple(tokens[start : start + len(window)]) == window:
                        spans.append((start, start + len(window)))
                        items.update(names)
        return len(tokens)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        n = batch.num_rows
        old_spans = batch.column("hit_spans").to_pylist() if "hit_spans" in batch.schema.names else [[]] * n
        old_items = batch.column("hit_items").to_pylist() if "hit_items" in batch.schema.names else [[]] * n
        counts, all_spans, all_items = [], [], []
        for raw, before, named in zip(raw_texts(batch.column("text")), old_spans, old_items, strict=True):
            spans, items = [(s["start"], s["end"]) for s in before], set(named)
            counts.append(hits(raw, spans, items))
            all_spans.append([{"start": a, "end": b} for a, b in merged(spans)])
            all_items.append(sorted(items))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array(all_spans, kind), pa.array(all_items, pa.list_(pa.string()))]

    return make


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, hit_spans, hit_items, n_hit, n_items and contaminated added (replacing columns of such names).

    Words are runs of A-Z (lower-cased), a-z, 0-9 and non-ASCII characters.
    hit_spans holds the word ranges (start, end exclusive) covered by an occurrence of a
    window, n_hit their words, hit_items the sorted ids, as strings, of items with such a window.

    Defined cases: a null text has no words; an item without words has no window;
    an item with a null id hits words but is not named; items of one id count
    once, and repeated items are dropped before they are dealt into blocks; repeated documents are each judged; an empty benchmark hits nothing;
    other columns of `docs` pass through, those of `benchmark` are not read.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items", "n_hit", "n_items", "contaminated")]
    state, held = docs.select(*own), None
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("raw")).where("raw IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = "n_words long, hit_spans array<struct<start:long,end:long>>, hit_items array<string>"
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == block)
        windows = item_windows([(r.item_id, bytes(r.raw)) for r in mine.collect()], width)  # block_bytes of text, about
        hashes, vocabulary = WordHashes(), {}
        for window in windows:
            size = min(_SHINGLE, len(window))
            vocabulary.setdefault(size, set()).update(shingles(hashes.of(list(window)), size).tolist())
        known = spark.sparkContext.broadcast({size: np.array(sorted(values), dtype=np.uint64) for size, values in vocabulary.items()})
        counted = docs.select("text").mapInArrow(partial(_count, vocabulary=known), "size int, shingle long, n long")
        frequency = {(r.size, r.shingle & 0xFFFFFFFFFFFFFFFF): r.n for r in counted.groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect()} if windows else {}
        index = spark.sparkContext.broadcast(_Index(windows, frequency))
        state = with_columns(state, schema, partial(_scan, index))
        if block + 1 < blocks:
            table = Table(state, "decontaminated")
            if held:
                held.drop()
            held, state = table, table.df
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return state.withColumn("n_hit", n_hit).withColumn("n_items", F.size("hit_items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
