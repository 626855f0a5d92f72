"""Bounded samples of labelled documents, to fit models on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id has the remainder of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(labelled: DataFrame, docs: DataFrame, *, per_label: int) -> list[tuple[object, str]]:
    """(label, text) of at most `per_label` labelled ids of each label, in a fixed pseudo-random order of ids.

    `labelled` has doc_id and label; rows with a null in either are never drawn,
    an id with several labels counts for its greatest, one with several texts for its least. Ids
    without a text are drawn like others and then missing. The order depends on the ids alone,
    so the sample is the same in every run over the same rows.

    Labels are counted first; then only ids whose hash is low enough for about `per_label` of the label
    (a little more, and more again if that was too few) reach the driver, so that no label is sorted in one task.
    """
    ids = labelled.dropna(subset=["doc_id", "label"]).groupBy("doc_id").agg(F.max("label").alias("label"))
    # The hash of an id as a number from 0 to 1.
    ids = ids.select("doc_id", "label", (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("order"))
    counts = {r.label: r.n for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    room, drawn = 1.25, {}
    while missing := [label for label in counts if label not in drawn]:
        bounds = {label: min(1.0, (room * per_label + 64) / counts[label]) for label in missing}
        low = reduce(lambda test, label: test | ((F.col("label") == F.lit(label)) & (F.col("order") <= bounds[label])), missing, F.lit(False))
        found: dict = {label: [] for label in missing}
        for r in ids.where(low).collect():
            found[r.label].append((r.order, r.doc_id))
        drawn |= {label: sorted(rows)[:per_label] for label, rows in found.items() if len(rows) >= min(per_label, counts[label])}
        room *= 2
    chosen = [(doc_id, label) for label, rows in drawn.items() for _, doc_id in rows]
    if not chosen:
        return []
    kinds = {f.name: f.dataType.simpleString() for f in ids.schema.fields}
    few = docs.sparkSession.createDataFrame(chosen, f"doc_id {kinds['doc_id']}, label {kinds['label']}")
    # At most per_label rows a label, so small enough to send everywhere.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id")
    found = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.xxhash64("doc_id").alias("h")).collect()
    return [(r.label, r.text) for r in sorted(found, key=lambda r: (r.h, r.doc_id))]
