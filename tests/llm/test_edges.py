"""Nulls, empty and very long texts, repeats, empty tables and clashing columns, for all queries and stages."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from tests.llm.conftest import LONG, TRICKY
from trailstone.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_tricky_tables(spark, tricky, name):
    rows = QUERIES[name](spark, tricky).collect()
    if name == "op3_decontaminate":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1)] * 4 + [(6, 1)] * 2  # rows that repeat, in both tables
    elif name == "op8_chat":
        assert sorted((r.conv_id is None, r.conv_id or 0) for r in rows) == [(False, -1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    elif name == "op13_structure_repair":
        assert sorted((r.conv_id is None, r.conv_id or 0) for r in rows) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    elif name == "op11_hard_negatives":
        assert {r.anchor_id for r in rows} == {0, 50}
    else:
        assert len(rows) == len(TRICKY)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((t[0] is None, t[0] or 0) for t in TRICKY)
    if rows and "score" in rows[0] and name != "op10_lm_score":
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    rows = QUERIES[name](spark, nothing).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "op8_chat" else rows == []


def test_defined_results(spark, tricky):
    by = lambda name: {r.doc_id: r for r in QUERIES[name](spark, tricky).collect()}
    nine = QUERIES["op9_exact_dedup"](spark, tricky).collect()
    assert sum(r.kept for r in nine if r.doc_id == 1) == 1
    assert {r.doc_id: (r.keep_id, r.group_size) for r in nine if r.doc_id in (1, 2, 3, 4, 6)} == {1: (1, 3), 6: (1, 3), 2: (2, 2), 3: (2, 2), 4: (4, 1)}
    two = by("op2_near_dedup")
    assert (two[6].component_id, two[6].kept, two[2].n_shingles, two[2].component_id, two[5].n_shingles) == (1, False, 0, 2, 1)
    assert two[None].component_id is None and two[None].kept
    six = by("op6_language_id")
    assert [six[k].lang_pred for k in (2, 3, 4, 8)] == ["und"] * 4 and six[2].score == 0 and six[9].lang_pred != "und"
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in six.items() if k is not None)
    seven = by("op7_bpe")
    assert seven[2].n_tokens == 0 and seven[7].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    ten = by("op10_lm_score")
    assert ten[2].n_tokens == 1 and ten[4].n_tokens == 1 and ten[5].n_tokens == 2


def test_pipeline_stages_on_tricky_and_empty_tables(spark, tricky, nothing):
    for folder, empty in ((tricky, False), (nothing, True)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.staged(stage(spark, docs, folder))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == columns, name
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert ids == ([] if empty else [(False, 5), (False, 7), (False, 9), (False, 10), (True, 0)])
