"""Spark vs DuckDB on the driver's smallest tables for a cross-section of the
registry (the full list runs in scripts/check_oracle.py)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from coldsplit.plans import queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "build_tree", "build_tree_part", "candidate_scope_error", "split_error", "branch_stats",
    "route_users", "attitude_trace", "rmse_per_user", "evaluate_new_users", "interview_length_eval",
    "pseudo_user_ratings", "predict_pairs", "index_items", "read_sectioned_pairs", "read_reviews_json",
    "load_tree", "load_model", "fit_levels", "validation_held_out", "user_rating_map", "random_split",
    "rating_count_histogram", "user_bias", "matrix_vector", "probe_remove", "restrict_items_to_rated",
    "predict_all_items", "grid_rmse", "recommend_items", "recommend_users", "histogram_items", "histogram_users",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, bool):
        return int(v)
    return v if v is None or isinstance(v, int) else str(v)


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer supplier part orders lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(rows, df.columns) == _canon(drows, dcols)


def test_every_query_has_oracle_or_is_random():
    own = {name for name, _ in queries.REGISTRY.items()}
    no_sql = own - set(E.oracle_sql())
    random_or_iterative = {
        "als_baseline", "best_lambda", "evaluate_new_users_als", "evaluate_new_items_als", "lambda_curve",
        "recommend_items_als", "recommend_users_als", "regression_rmse", "tune_levels",
    }
    assert no_sql <= random_or_iterative


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert df.columns == ["rmse_macro", "n_users", "n_pairs", "n_skipped"]
