"""Groups of rows that arrive next to each other in a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _changes(column: pa.Array, n: int) -> list[bool]:
    """Whether each value but the first differs from the one before."""
    if n < 2:
        return []
    if pa.types.is_struct(column.type):
        return [any(x) for x in zip(*(_changes(part, n) for part in column.flatten()))]
    return pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True).to_pylist()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table for each stretch of equal values in `key`, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(key)
        changed = _changes(column, n)
        edges = [0, *(k + 1 for k, x in enumerate(changed) if x), n]
        for low, high in zip(edges, edges[1:]):
            value = column[low].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole stretches of equal integers in `keys`, and the edges of these stretches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        held.append(batch)
        if all(held[0].column(k)[0] == batch.column(k)[n - 1] for k in keys):
            continue  # one stretch so far
        table = pa.Table.from_batches(held).combine_chunks()
        edges = _edges(table, keys)
        yield table.slice(0, edges[-2]), edges[:-1]
        held = table.slice(edges[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _edges(table, keys)


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(max(0, len(table) - 1), dtype=bool)
    for key in keys:
        values = table[key].to_numpy()
        changed |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(table)]])
