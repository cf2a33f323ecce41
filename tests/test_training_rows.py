from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.operators import features, history, splits
from basketlake.operators.skew import heavy_keys
from conftest import rows_of

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sessions(spark):
    """One user with a third of the sessions, ties in time among them."""
    rows = []
    for i in range(600):
        user = 7 if i % 3 == 0 else i % 40
        at = START + timedelta(seconds=(i * 7919) % 5000 // 4 * 4)
        rows.append((f"s{i:04d}", user, at, i % 2, 1 - i % 2))
    frame = spark.createDataFrame(
        rows, "session_id string, user_id long, first_cart_time timestamp, converted int, "
              "is_abandoned int")
    return frame, rows


def brute_force(rows):
    result = {}
    for sid, user, at, _, _ in rows:
        prior = [r for r in rows if r[1] == user and (r[2], r[0]) < (at, sid)]
        n = len(prior)
        first = min((r[2] for r in prior), default=None)
        hours = 0.0 if first is None else (at - first).total_seconds() / 3600.0
        c, a = sum(r[3] for r in prior), sum(r[4] for r in prior)
        result[sid] = (n, c, a, c / n if n else 0.0, a / n if n else 0.0, hours)
    return result


@pytest.mark.parametrize("cut", [False, True])
def test_history_against_brute_force(sessions, cut):
    frame, rows = sessions
    heavy = heavy_keys(frame, ["user_id"], min_rows=100 if cut else 10**9)
    assert heavy.count() == (1 if cut else 0)
    got = {
        r["session_id"]: tuple(r[c] for c in schemas.HISTORY_FEATURES)
        for r in history.with_history(frame, heavy).collect()
    }
    wanted = brute_force(rows)
    assert got.keys() == wanted.keys()
    for sid, values in wanted.items():
        assert got[sid] == pytest.approx(values)


def test_heavy_user_is_cut_into_even_slices(sessions):
    frame, _ = sessions
    heavy = heavy_keys(frame, ["user_id"], min_rows=100)
    sliced = history._sliced(frame, heavy).filter("user_id = 7")
    largest = sliced.groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 10
    few = heavy.withColumn("splits", F.lit(8))
    sizes = [r["count"] for r in history._sliced(frame, few).filter("user_id = 7")
             .groupBy("_slice").count().collect()]
    assert 7 <= len(sizes) <= 9 and max(sizes) <= 40


@pytest.mark.parametrize("splits", [2, 8, 300])
def test_history_does_not_depend_on_the_number_of_slices(sessions, splits):
    frame, _ = sessions
    heavy = heavy_keys(frame, ["user_id"], min_rows=3).withColumn("splits", F.lit(splits))
    assert heavy.count() > 1
    assert rows_of(history.with_history(frame, heavy)) == rows_of(history.with_history(frame))


def test_admissible_and_clean(spark, lk):
    rows = features.ml_dataset(lk.ml_features(), heavy_users=lk.heavy_users())
    assert rows.count() == 163
    assert rows.columns == ["session_id", "user_id", "converted", *schemas.FEATURES_V3]
    assert len(schemas.FEATURES_V3) == 32 and len(schemas.FEATURES_V2) == 26
    assert len(schemas.PROPENSITY_FEATURES) == 14
    bad = spark.createDataFrame([(1, float("nan"), None)], "converted int, a double, b double")
    assert features.final_clean(bad, ["a", "b"]).first()[1:] == (0.0, 0.0)


def test_coerce_numeric(spark):
    frame = spark.createDataFrame(
        [("1.5", float("inf")), ("x", float("nan")), (None, -float("inf")), ("2", None)],
        "a string, b double")
    got = [tuple(r) for r in features.coerce_numeric(frame, ["a", "b"]).collect()]
    assert got == [(1.5, 0.0), (0.0, 0.0), (0.0, 0.0), (2.0, 0.0)]


def test_three_way_split_is_disjoint_complete_and_stable(spark):
    frame = spark.range(5000).select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.col("id").alias("user_id"))
    once = splits.split_3way(frame)
    again = splits.split_3way(frame.repartition(7))
    assert rows_of(once) == rows_of(again)
    counts = {r["split"]: r["count"] for r in once.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000
    assert abs(counts["train"] - 3500) < 150 and abs(counts["test"] - 750) < 120


def test_stratified_split_is_exact_per_class(spark):
    frame = spark.range(3003).select(
        F.col("id").cast("string").alias("session_id"), F.col("id").alias("user_id"),
        (F.col("id") % 3 == 0).cast("int").alias("converted"))
    got = splits.split_stratified(frame, "converted")
    counts = {(r["converted"], r["split"]): r["count"]
              for r in got.groupBy("converted", "split").count().collect()}
    assert counts == {(1, "test"): 200, (1, "train"): 801, (0, "test"): 400, (0, "train"): 1602}
    assert got.select("session_id").distinct().count() == 3003


def test_samples(spark):
    frame = spark.range(1000).select(
        F.when(F.col("id") > 3, F.format_string("k%04d", F.col("id"))).alias("session_id"),
        F.col("id").alias("user_id"))
    first = splits.ml_sample(frame, 50).collect()
    assert [r["user_id"] for r in first] == list(range(50))
    sample = splits.bounded_sample(frame, 100)
    assert sample.count() == 100
    assert rows_of(sample) == rows_of(splits.bounded_sample(frame.repartition(9), 100))
    assert splits.bounded_sample(frame, 5000).count() == 1000
