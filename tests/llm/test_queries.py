"""The registered text queries: their SQL, and their columns."""

import pytest

from tamis.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op2_toxicity": "doc_id held_out score predicted", "op3_quality": "doc_id held_out score predicted",
    "op4_knn_join": "query_id rank vec_id score", "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_url_filters": "page_id host path rule verdict", "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_warc": "page_id record_id warc_type refers_to", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_mixing": "doc_id size source_size target taken",
}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, name):
    compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns) and df.count() > 0


def test_native_plans(spark):
    for name in ("op1_fingerprints", "op10_mixing"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
