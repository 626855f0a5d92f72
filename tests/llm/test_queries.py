"""The registered queries on small tables: columns, held-out rows, and that labels of held-out rows change nothing."""

from __future__ import annotations

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.test_operators import brute_classes, brute_hits, brute_lines, brute_statistics
from tests.llm.test_pipeline import tables
from tidemark.llm.queries import QUERIES

CONTRACT = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    rows, items = tables(path)
    return path, rows, items


def spoiled(path, target):
    """The tables with other labels and languages in every held-out row."""
    for name, columns, modulus, rest in (("documents", {"lang": "xx", "source": "other"}, 3, 1), ("labels", {"toxic": 1, "quality": 0}, 5, 0)):
        table = pq.read_table(path / f"{name}.parquet")
        held = [zlib.crc32(str("" if k is None else k).encode()) % modulus == rest for k in table["doc_id"].to_pylist()]
        for column, value in columns.items():
            values = [value if h else old for h, old in zip(held, table[column].to_pylist())]
            table = table.set_column(table.schema.get_field_index(column), column, pa.array(values, table[column].type))
        pq.write_table(table, target / f"{name}.parquet")


@pytest.mark.parametrize("name", list(CONTRACT))
def test_held_out_rows_teach_nothing(spark, small, tmp_path, name):
    path, rows, _ = small
    found = QUERIES[name](spark, str(path))
    assert dict(found.dtypes) == CONTRACT[name]
    modulus, rest = (3, 1) if name == "op1_language_id" else (5, 0)
    scored = sorted((r.asDict() for r in found.collect()), key=str)
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in scored if r["doc_id"] is not None)
    if "predicted" in found.columns:
        least = 0.5 if name == "op2_toxicity" else 0.3
        assert all(r["predicted"] == int(r["score"] >= least) for r in scored)
    spoiled(path, tmp_path)
    assert sorted((r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()), key=str) == scored


def test_exact_queries_equal_brute_force(spark, small):
    path, rows, items = small
    lines = QUERIES["op5_line_dedup"](spark, str(path)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in lines) == sorted((str(k), a, b) for (k, a, b, _), n in brute_lines(rows, 10).items() for _ in range(n))
    hits = QUERIES["op7_benchmark_decontamination"](spark, str(path)).collect()
    assert {r.doc_id for r in hits if r.contaminated} == {i for (i, _, _, _, bad), _ in brute_hits(rows, items).items() if bad}
    assert {(r.doc_id, r.class_id) for r in QUERIES["op3_ngram_join"](spark, str(path)).collect()} == {(i, c) for (i, c, _), _ in brute_classes(rows).items()}


def test_quality_rules_and_passages_return_what_they_must(spark, small):
    path, rows, _ = small
    found = QUERIES["op9_quality_rules"](spark, str(path))
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    text = dict(rows)
    for r in found.collect():
        if r.doc_id is not None:
            assert tuple(r[1:6]) == tuple(brute_statistics(text[r.doc_id])[:5]) and not (r.base_failed and r.kept)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    passages = QUERIES["op6_substring_dedup"](spark, str(path))
    assert passages.columns == ["doc_id", "partner_id", "class_id", "start", "end"] and passages.where("end - start < 50").count() == 0
