"""Every registered query with an oracle, compared with DuckDB on the smallest tables."""

import importlib.util
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    got = check.rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert got == check.rows_of(names, result.fetchall())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 2


PAIRWISE = {"nemenyi_pairs"}


@pytest.mark.parametrize(
    "name",
    ["anti_join_positives", "doi_suffix_anti_join", "label_membership", "enrich_metadata", "dedup_text_doi", "undersample_negatives",
     "stratified_kfold", "optimal_threshold", "roc_curve_corners", "ensemble_mean", "nemenyi_pairs", "tfidf", "request_batches", "bce_loss"],
)
def test_no_pairwise_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
