"""Checks between two relations of a plan or an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tree import prefixes


def bijection(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are not exactly once in both tables, with their counts there (a full outer join)."""
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), key, "full_outer")
    return both.select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_left", "n_right")]).where("n_left <> 1 OR n_right <> 1")


def listing_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one listing that the other lacks, repeated rows counted: side `missing` or `unexpected` added."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def next_offset(entries: DataFrame, order: list[str], boundary: Column, partition: str = "archive") -> DataFrame:
    """`entries` with the offset of the next one in its archive, the boundary after the last (an adjacent-row join)."""
    window = Window.partitionBy(partition).orderBy(*order)
    return entries.withColumn("next_offset", F.coalesce(F.lead("local_offset").over(window), boundary))


def range_findings(entries: DataFrame, order: list[str], boundary: Column) -> DataFrame:
    """Entries whose bytes reach beyond the next entry's offset, or share their offset with another: code added.

    `entries` has archive, local_offset and n_bytes.
    """
    placed = next_offset(entries, order, boundary)
    twins = F.count(F.lit(1)).over(Window.partitionBy("archive", "local_offset"))
    code = F.when(F.col("twins") > 1, "DUPLICATE_LOCAL_OFFSET").when(F.col("local_offset") + F.col("n_bytes") > F.col("next_offset"), "OVERLAPPING_LOCAL_RANGE")
    return placed.withColumn("twins", twins).withColumn("code", code).where("code IS NOT NULL").drop("twins")


def extraction_inventory(resolved: DataFrame) -> DataFrame:
    """Per archive: files kept, distinct directories they and explicit ones need, and declared bytes.

    `resolved` has archive, entry_type, target (array of components) and declared_bytes.
    """
    is_file = F.col("entry_type") == "file"
    sums = resolved.groupBy("archive").agg(
        F.sum(is_file.cast("long")).alias("files"), F.coalesce(F.sum(F.when(is_file, F.col("declared_bytes").cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)")).alias("declared_total")
    )
    depth = F.when(is_file, F.size("target") - 1).otherwise(F.size("target"))
    folders = resolved.select("archive", F.explode(prefixes(F.col("target"), depth)).alias("folder")).distinct().groupBy("archive").agg(F.count(F.lit(1)).alias("directories"))
    return sums.join(folders, "archive", "left").select("archive", "files", F.coalesce("directories", F.lit(0)).alias("directories"), "declared_total")


def inventory_findings(inventory: DataFrame, files: int, directories: int, total_bytes: int) -> DataFrame:
    """Limits of an extraction that an archive's inventory exceeds, one row each."""
    tests = [("TARGET_FILE_COUNT_LIMIT", F.col("files") > files), ("TARGET_DIRECTORY_COUNT_LIMIT", F.col("directories") > directories), ("DECLARED_TOTAL_LIMIT", F.col("declared_total") > total_bytes)]
    return inventory.select("archive", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))).alias("code"))


def content_digest(content: Column) -> Column:
    """struct(n_bytes, crc32, sha256) of binary content."""
    return F.struct(F.octet_length(content).cast("long").alias("n_bytes"), F.crc32(content).alias("crc32"), F.sha2(content, 256).alias("sha256"))


def parent_directories(directories: DataFrame) -> DataFrame:
    """Each directory (archive, parts, owner_entry_id) with its parent's owner, or null at the top (a self-join on the path above)."""
    above = directories.select("archive", F.col("parts").alias("above"), F.col("owner_entry_id").alias("parent_owner"))
    return directories.withColumn("above", F.slice("parts", 1, F.size("parts") - 1)).join(above, ["archive", "above"], "left").drop("above")
