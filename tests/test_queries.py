"""Registered queries against DuckDB on the smallest tables; ``python -m tests.oracle`` runs them all."""

import pytest

from heldout.plans.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "group_holdout", "double_holdout", "coverage_blocks", "split_audit", "load_trials", "flatten_json_numeric", "flatten_benchmark_rows", "verify_file_manifest",
    "reconstruct_cued_trials", "parse_onset_trials", "pair_question_response", "parse_prompted_responses", "align_behavior_codes", "dataset_scope",
    "group_mean_prior", "prediction_table", "metrics_by_context", "classification_metrics", "condition_effects", "paired_contrasts",
    "coverage_summary", "workflow_audit", "resolve_claims", "cut_epochs", "pool_vectors",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF).startswith("ok")


def test_registry_shape():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150
    for sql in ORACLE.values():
        assert sql.lstrip().upper().startswith(("WITH", "SELECT"))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_assignments_do_not_depend_on_partitioning(spark, partitions):
    want = sorted(map(tuple, QUERIES["double_holdout"](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, QUERIES["double_holdout"](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
