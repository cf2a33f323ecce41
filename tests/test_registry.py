"""Registered queries against their SQL twins, on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_point
from basketlake.plans.registry import ORACLES, QUERIES
from conftest import SMALL

FITTED = set(QUERIES) - set(ORACLES)
STREAMED = {name for name in QUERIES if name.startswith("stream_")}
CHECKED = sorted(set(ORACLES) - STREAMED)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(float(value)) if isinstance(value, (int, float)) else str(value)

    return sorted([cell(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_twin(spark, duck, name, capsys):
    frame = entry_point.queries()[name](spark, SMALL)
    capsys.readouterr()
    frame.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "MapInPandas" not in plan
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert comparable(frame.collect(), frame.columns) == comparable(result.fetchall(), names)


def test_only_fits_and_the_preview_lack_a_twin():
    assert FITTED == {
        "preview", "cart_offers_scored", "train_rf_v3", "train_gbt_v3", "training_report",
        "tuned_thresholds", "final_threshold_eval", "score_conversion_v1",
        "propensity_metrics_v1", "feature_importance_v1", "compare_abandonment_models",
        "recommend_batch", "abandonment_7f", "profile_classifier", "customer_clusters",
        "cluster_profiles", "centroids", "silhouette",
    }


def test_entry(spark):
    assert entry_point.entry(spark).count() == 165
