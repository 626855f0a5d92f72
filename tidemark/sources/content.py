"""Member content of archives, verified while it streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.policies import ExtractLimits
from .wire import Budget, Ranged, extents, member_chunks, scan


def member_digests(contents: DataFrame, limits: ExtractLimits = ExtractLimits()) -> DataFrame:
    """One row per member of each archive (archive, content): archive, entry_id, n_bytes, sha256. A member that fails verification fails the job, and so does an archive whose listing is neither ok nor complete with findings.

    Members are inflated in chunks of 64 KiB, whatever their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                source, rows, budget = Ranged.of(data), [], Budget(limits.total_bytes)
                listing = scan(source)
                if listing.state not in ("ok", "findings"):
                    raise ValueError(f"{archive}: {listing.state}: {', '.join(d[0] for d in listing.diagnostics)}")
                for entry_id, extent in extents(source, listing, {e.entry_id for e in listing.entries}).items():
                    digest, size = hashlib.sha256(), 0
                    for chunk in member_chunks(source, extent, limits, budget):
                        digest.update(chunk)
                        size += len(chunk)
                    rows.append((archive, entry_id, size, digest.hexdigest()))
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "entry_id", "n_bytes", "sha256"])

    return contents.select("archive", "content").mapInArrow(run, "archive string, entry_id string, n_bytes long, sha256 string")
