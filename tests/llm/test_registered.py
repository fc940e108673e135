"""Every query of this folder against its SQL, its columns, and the pipeline end to end."""

from __future__ import annotations

import zlib

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from roomledger.llm import exact_dedup, language_id, mixing, near_dedup, queries
from roomledger.llm.common import table
from tests.compare import database, differences
from tests.conftest import STAR

COLUMNS = {
    "op1_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_": ["query_id", "rank", "vec_id", "score"],
    "op3_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op6_": ["doc_id", "source", "slot", "in_mix"],
    "op7_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op9_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op10_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11_": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op12_": ["lang", "source", "part", "item", "value", "rank"],
}


def test_one_query_per_operator():
    assert all(sum(q.startswith(n) for q in queries.QUERIES) == 1 for n in COLUMNS)
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(queries.SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, STAR), database(STAR), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    wanted = COLUMNS[name.split("_")[0] + "_"]
    assert set(wanted) <= set(queries.QUERIES[name](spark, STAR).columns)


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, STAR, "documents")
    held = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, STAR)
        assert held.columns == docs.columns
    ids = sorted(r.doc_id for r in held.select("doc_id").collect())
    # the same decisions, taken by the operators one by one
    known = {r.doc_id for r in language_id.identify(docs).where("lang_pred <> 'und' AND rate < 0.5").collect()}
    left = docs.where(docs["doc_id"].isin(list(known)))
    left = left.where(left["doc_id"].isin([r.doc_id for r in exact_dedup.exact_groups(left).where("kept").collect()]))
    left = left.where(left["doc_id"].isin([r.doc_id for r in near_dedup.near_groups(left).where("kept").collect()]))
    wanted = sorted(r.doc_id for r in mixing.schedule(left).where("in_mix").collect())
    assert ids == wanted and 0 < len(ids) < docs.count()
    rows = corpus_pipeline.run(spark, STAR).collect()
    assert {r.doc_id for r in rows} == set(wanted)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
