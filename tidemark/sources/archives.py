"""ZIP archives as DataFrames: `spark.read.format("zip_index")`, or a column of bytes."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.policies import ScanLimits
from .decoding import decode_candidates
from .wire import Listing, Ranged, scan, scan_file

_DIAGNOSTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "severity", "certainty", "entry_id")])
_ENTRY = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("central_offset", T.LongType()),
        T.StructField("raw_name", T.BinaryType()),
        T.StructField("raw_extra", T.BinaryType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("method", T.IntegerType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("compressed_bytes", T.LongType()),
        T.StructField("declared_bytes", T.StringType()),  # unsigned 64 bits; a decimal(20,0) after `entries`
        T.StructField("local_offset", T.LongType()),
        T.StructField("create_system", T.IntegerType()),
        T.StructField("external_attr", T.LongType()),
    ]
)
SCAN = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("archive_id", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("central_offset", T.LongType()),
        T.StructField("central_bytes", T.LongType()),
        T.StructField("scan_diagnostics", T.ArrayType(_DIAGNOSTIC)),
        T.StructField("entries", T.ArrayType(_ENTRY)),
    ]
)


def scan_row(archive: str, found: Listing) -> tuple:
    entries = [
        (e.entry_id, e.index, e.central_offset, e.raw_name, e.raw_extra, e.flags, e.method, e.crc32, e.compressed_bytes, str(e.declared_bytes), e.local_offset, e.create_system, e.external_attr)
        for e in found.entries
    ]
    # A directory may be declared beyond any place in the file.
    bounded = lambda n: min(n, 2**63 - 1)
    return archive, found.archive_id, found.length, found.state, bounded(found.central_offset), bounded(found.central_bytes), found.diagnostics, entries


class _OneArchive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(p for part in options["path"].split(",") for p in (glob.glob(part) if glob.has_magic(part) else [part]) if not os.path.isdir(p))

    def partitions(self) -> list[InputPartition]:
        return [_OneArchive(path) for path in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is not None:
            yield scan_row(partition.path, scan_file(partition.path))


class ZipIndexSource(DataSource):
    """One row per archive of a glob (or several, by commas) in a file system that all executors mount; a task reads one archive's metadata by ranges."""

    @classmethod
    def name(cls) -> str:
        return "zip_index"

    def schema(self) -> T.StructType:
        return SCAN

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Listings of the archives that a path or glob names."""
    spark.dataSource.register(ZipIndexSource)
    return spark.read.format("zip_index").load(path)


def _arrow_scan(archives: list[str], contents: list[bytes], limits: ScanLimits) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCAN)
    rows = [dict(zip(SCAN.names, scan_row(a, scan(Ranged.of(c), limits)))) for a, c in zip(archives, contents)]
    for row in rows:
        row["scan_diagnostics"] = [dict(zip(_DIAGNOSTIC.names, d)) for d in row["scan_diagnostics"]]
        row["entries"] = [dict(zip(_ENTRY.names, e)) for e in row["entries"]]
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def scan_contents(contents: DataFrame, limits: ScanLimits = ScanLimits()) -> DataFrame:
    """Listings of archives held in a table (archive, content), as from `binaryFile` on a store that is not mounted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one archive at a time
                yield _arrow_scan([batch.column("archive")[k].as_py()], [batch.column("content")[k].as_py()], limits)

    return contents.select("archive", "content").mapInArrow(run, SCAN)


def entries(scans: DataFrame, decoded: bool = True) -> DataFrame:
    """One row per entry, with the readings of its name in `candidates`."""
    exploded = scans.select("archive", F.explode("entries").alias("e")).select("archive", "e.*").withColumn("declared_bytes", F.col("declared_bytes").cast("decimal(20,0)"))
    return exploded.withColumn("candidates", decode_candidates("raw_name", "raw_extra", "flags")) if decoded else exploded
