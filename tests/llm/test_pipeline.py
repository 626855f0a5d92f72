from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm import data
from tests.llm.test_operators import brute_classes, brute_hits, brute_lines, labelled


def tables(path):
    rows = data.texts(n=40)
    rows += [(1000 + k, f"shared header line\n{data.sentence(random.Random(k), 'en', 40)}") for k in range(15)]
    rows += [(2000 + k, text) for k, text, _ in labelled(120)]
    labels = [(2000 + k, 1, bad) for k, _, bad in labelled(120)]
    items = [(1, " ".join(rows[2][1].split()[:14]))]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": [len(r[1] or "") for r in rows]}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), path / "benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = tables(tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    calm = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).cache()
    ids = {r.doc_id for r in calm.collect()}
    truth = {2000 + k: bad for k, _, bad in labelled(120)}
    assert calm.columns == columns and sum((k in ids) == (bad == 0) for k, bad in truth.items()) > 110

    lines = corpus_pipeline.drop_common_lines(spark, docs, str(tmp_path))
    wanted = Counter((doc_id, kept if dropped else dict(rows).get(doc_id, kept)) for (doc_id, _, dropped, kept), n in brute_lines(rows, 10).items() for _ in range(n))
    found = lines.collect()
    assert lines.columns == columns and sum(Counter((r.doc_id, r.text or "") for r in found).values()) == len(rows)
    assert {k for k, _ in wanted} == {r.doc_id for r in found} and all("shared header" not in (r.text or "") for r in found if r.doc_id is not None and r.doc_id >= 1000)
    assert all(r.n_chars == len(r.text or "") for r in found)

    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    kept = {r.doc_id for r in single.collect()}
    alone = {doc_id for (doc_id, name, _), _ in brute_classes(rows).items() if doc_id == name}
    assert single.columns == columns and kept - {None} == alone - {None}

    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    hit = {doc_id for (doc_id, _, _, _, bad), _ in brute_hits(rows, items).items() if bad}
    assert clean.columns == columns and 2 in hit and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - hit


def test_run(spark, tmp_path):
    tables(tmp_path)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None


def test_run_on_empty_tables(spark, tmp_path):
    (tmp_path / "full").mkdir()
    tables(tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(tmp_path / "full" / f"{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    pq.write_table(pq.read_table(tmp_path / "full" / "documents.parquet"), tmp_path / "documents.parquet")  # neither labels nor a benchmark
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
