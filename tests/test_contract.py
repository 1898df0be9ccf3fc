"""The registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_oracles import difference
from flowsentry.operators.ordering import rank_rows
from flowsentry.plans import QUERIES as REGISTERED
from flowsentry.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
# Queries that fit all detectors run for minutes; check_oracles.py compares them.
SLOW = ["detector_quality"]
QUERIES = [name for name in contract.queries() if name in ORACLES and name not in SLOW]
MODELS = [name for name in REGISTERED if name not in ORACLES]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    left = [tuple(r) for r in df.select(*columns).collect()]
    right = found.select(*[f'"{c}"' for c in columns]).fetchall()
    assert difference(left, right) is None


def test_every_query_without_sql_fits_a_model():
    assert sorted(MODELS) == ["cv_f1", "encoded_features", "ensemble_ml", "feature_importance",
                              "gbt_predictions", "mlp_predictions", "pca_anomaly", "rf_grid",
                              "rf_predictions", "session_autoencoder", "svm_predictions"]


@pytest.mark.parametrize("name", ["pca_anomaly", "encoded_features", "rf_predictions", "feature_importance"])
def test_model_query_runs(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    text = plan(contract.queries()["alerts_by_severity"](spark, FOLDER).select("id"))
    assert "PushedFilters: [" in text and "ReadSchema: struct<event_id:bigint,event_type:string>" in text
    recent = t.traffic.filter("ts >= timestamp_ntz'2024-01-20 00:00:00'").select("bytes")
    assert "GreaterThanOrEqual(ts" in plan(recent) and "user_id" not in plan(recent).split("ReadSchema")[-1]


def test_no_query_plans_a_cross_join(spark):
    for name in ("dashboard_stats", "report_summary", "report_horizons", "traffic_buckets", "zscore_features",
                 "anomaly_verdict", "attack_heatmap"):
        text = plan(contract.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_global_ranks_use_no_single_partition_window_over_rows(spark):
    t = Tables(spark, FOLDER)
    text = plan(rank_rows(t.alerts.select("id", "ts"), [F.col("ts").asc(), F.col("id").asc()]))
    assert "Window [coalesce" not in text and text.count("SinglePartition") <= 2
