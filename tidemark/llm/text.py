"""Words, word hashes and shingles of UTF-8 texts, for the Python-side operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, types as T

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, and makes the rest a space.
WORD_TABLE = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)
#: Texts handled at once, so that a batch of very long texts is not expanded in one go.
SLICE_BYTES = 1 << 20
_CACHE_ENTRIES = 1 << 17


def words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of a text, none for a null text."""
    return raw.translate(WORD_TABLE).split() if raw else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of `width` words, in text order; a shorter text is one run, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    value = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    return mixed(value)


#: Bytes hashed at once, and the most bytes of a word that are hashed together with others; a longer word is hashed by itself.
_BLOCK, _LONG = 1 << 16, 127
_BASE = 0x9E3779B97F4A7C15
_POWERS, _BACK = (np.multiply.accumulate(np.full(_BLOCK + _LONG + 1, x, dtype=np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
_IS_WORD = np.frombuffer(WORD_TABLE, dtype=np.uint8) != 0x20
_LETTERS = np.where(_IS_WORD, mixed((np.frombuffer(WORD_TABLE, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) << np.uint64(40)), np.uint64(0))


def word_starts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a string or binary column: its bytes, where each text starts in them (and the last ends), where each word starts, and the words of each text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, dtype=np.uint8)
    edges = edges - edges[0]
    inside = _IS_WORD[held]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(held)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    return held, edges, starts, np.diff(np.searchsorted(starts, edges))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string or binary column, in text order, and how many each text has.

    A word is a polynomial of its letters' numbers, made of the bytes of many words at once.
    """
    held, edges, starts, counts = word_starts(column)
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + _BLOCK))
        at = starts[low:high] - starts[low]
        stop = min(int(starts[high]) if high < len(starts) else len(held), int(starts[high - 1]) + _LONG + 1)
        values = _LETTERS[held[starts[low] : stop]]
        values *= _POWERS[: len(values)]
        out[low:high] = np.add.reduceat(values, at) * _BACK[at]
        low = high
    out = mixed(out)
    ends = np.append(starts[1:], len(held))
    for k in np.flatnonzero(ends - starts > _LONG):
        text_end = int(edges[np.searchsorted(edges, starts[k], "right")])
        word = words(held[starts[k] : min(int(ends[k]), text_end)].tobytes())[0]
        if len(word) > _LONG:
            out[k] = xxhash.xxh3_64_intdigest(word)
    return out, counts


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each hold about SLICE_BYTES at most (one text at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([0 if s is None else s for s in pa.compute.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        cut = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            yield batch.slice(low, high - low)
        pa.default_memory_pool().release_unused()


def with_columns(docs: DataFrame, added: str, start: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """`docs` with Python-made columns appended, or replaced where it has such names already.

    `start` runs once a task and returns a function from a batch (which holds
    `text`) to the added columns. The other columns pass through as Arrow buffers.
    """
    new = T.StructType.fromDDL(added)
    own = [f for f in docs.schema.fields if f.name not in new.names]
    names, kept = [f.name for f in own] + new.names, [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *make(batch)], names)

    return docs.mapInArrow(run, T.StructType([*own, *new.fields]))
