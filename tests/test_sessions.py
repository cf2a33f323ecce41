from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.operators import sessions as S
from basketlake.operators import silver as V
from basketlake.operators.skew import heavy_keys
from conftest import rows_of

T0 = datetime(2026, 9, 2, 10, 0)


def event(session, user, at, kind, price=1.0, product=1, brand="b", code="a.b"):
    return (at, kind, product, product % 10, code, brand, price, user, session)


def events(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENTS_SILVER)


def minutes(n):
    return T0 + timedelta(minutes=n)


@pytest.fixture
def two_sessions(spark):
    late = T0.replace(hour=23)
    rows = [event("s1", 101, minutes(m), "view", 100.0) for m in (0, 1, 2)]
    rows += [event("s1", 101, minutes(5), "cart", 100.0),
             event("s1", 101, minutes(10), "purchase", 100.0)]
    rows += [event("s2", 202, late + timedelta(minutes=m), "view", 50.0) for m in (0, 1)]
    rows += [event("s2", 202, late + timedelta(minutes=5), "cart", 50.0)]
    return events(spark, rows)


def test_two_literal_sessions(two_sessions):
    got = rows_of(S.session_features(two_sessions), "session_id", "num_cart_items",
                  "num_views_before_cart", "view_to_cart_ratio", "hour_of_day", "is_night",
                  "num_purchases", "is_abandoned", "converted", "session_duration_sec")
    assert got == [("s1", 1, 3, 3.0, 10, 0, 1, 0, 1, 600), ("s2", 1, 2, 2.0, 23, 1, 0, 1, 0, 300)]


def test_ml_features_stop_at_first_cart(spark):
    rows = [
        event("s", 1, minutes(0), "view", 10.0, product=1, brand="x"),
        event("s", 1, minutes(1), "view", 30.0, product=2, brand=None),
        event("s", 1, minutes(1), "view", 30.0, product=2, brand="x"),
        event("s", 1, minutes(3), "view", 99.0, product=9),      # at the cart instant: not before
        event("s", 1, minutes(3), "cart", 5.0), event("s", 1, minutes(3), "cart", 7.0),
        event("s", 1, minutes(4), "cart", 1000.0), event("s", 1, minutes(5), "purchase", 5.0),
        event("p", 2, minutes(0), "purchase", 5.0), event("p", 2, minutes(1), "cart", 5.0),
    ]
    got = {r["session_id"]: r for r in S.ml_features(events(spark, rows)).collect()}
    s = got["s"]
    assert (s["num_views_before_cart"], s["unique_products_viewed"],
            s["unique_brands_viewed"]) == (3, 2, 1)
    assert (s["min_viewed_price"], s["max_viewed_price"], s["viewed_price_range"]) == (10, 30, 20)
    assert (s["cart_value_at_first_cart"], s["num_cart_items_at_first_cart"]) == (12.0, 2)
    assert (s["avg_cart_item_price"], s["max_cart_item_price"]) == (6.0, 7.0)
    assert (s["time_to_first_cart_sec"], s["view_to_cart_ratio"]) == (180, 1.5)
    assert (s["converted"], s["is_abandoned"]) == (1, 0)
    assert got["p"]["converted"] == 1 and got["p"]["avg_viewed_price"] == 0.0


def test_missing_session_ids(spark):
    rows = [event(None, 1, minutes(0), "view"), event(None, 1, minutes(1), "cart"),
            event(None, 2, minutes(1), "view"), event("s", 1, minutes(1), "cart")]
    frame = events(spark, rows)
    sessions = {(r["session_id"], r["user_id"]): r for r in S.session_features(frame).collect()}
    assert set(sessions) == {(None, 1), ("s", 1)}
    lost = sessions[(None, 1)]
    assert lost["num_views_before_cart"] == 0 and lost["first_cart_time"] is None
    assert lost["hour_of_day"] is None and lost["is_night"] == 0
    assert [r["session_id"] for r in S.ml_features(frame).collect()] == ["s"]
    assert [r["user_session"] for r in S.cart_features(frame).collect()] == ["s"]
    assert S.with_first_cart(frame).filter("first_cart_time IS NOT NULL").count() == 1


def test_cart_features_variants(spark):
    rows = [
        event("s", 1, T0 + timedelta(microseconds=500_000), "view", code=None),
        event("s", 1, minutes(1), "cart", 10.0, code="z.y"),
        event("s", 1, minutes(2), "cart", 20.0, code="b.c.d", brand=None),
        event("s", 1, minutes(9), "view"),
        event("t", 1, minutes(1), "cart", 10.0, code=None), event("t", 1, minutes(2), "purchase"),
        event("u", 1, minutes(1), "view"),
    ]
    got = {r["user_session"]: r for r in S.cart_features(events(spark, rows)).collect()}
    assert set(got) == {"s", "t"}
    s = got["s"]
    assert s["main_category"] == "b"          # equal counts: the smaller category
    assert s["num_views_before_cart"] == 2    # every view of the session
    assert s["session_duration_sec"] == 119.5
    assert (s["num_distinct_brands"], s["num_distinct_categories"]) == (1, 2)
    assert (s["day_of_week"], s["is_weekend"], s["is_abandoned"]) == (2, 0, 1)
    assert (got["t"]["main_category"], got["t"]["is_abandoned"]) == ("other", 0)


def test_cutting_heavy_sessions_changes_nothing(lk):
    silver = lk.silver()
    heavy = heavy_keys(silver, schemas.SESSION_KEYS, min_rows=2)
    by_id = heavy_keys(silver, ["user_session"], min_rows=2)
    assert 0 < heavy.count() <= 4096
    assert heavy.agg(F.max("splits")).first()[0] > 1
    for build in (S.session_features, S.ml_features, S.with_first_cart):
        assert rows_of(build(silver, heavy)) == rows_of(build(silver))
    assert rows_of(S.cart_session_events(silver, by_id)) == rows_of(S.cart_session_events(silver))


def test_one_session_with_a_third_of_all_rows_is_spread(spark):
    from basketlake.operators.skew import spread_join

    rows = 30_000
    big = spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"))
    lookup = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, w int")
    heavy = heavy_keys(big, ["k"], min_rows=1000)
    assert heavy.count() == 1 and heavy.first()["splits"] > 1000
    joined = spread_join(big, lookup, ["k"], "left", ["v"], heavy)
    assert joined.count() == rows
    assert joined.filter("w = 1").count() == rows // 3
    sizes = (
        spread_join(big, lookup, ["k"], "inner", ["v"], heavy).repartition(64, "k", "v")
        .filter("k = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    )
    assert sizes < rows // 3 / 8


def test_fixture_counts(lk):
    silver = lk.silver()
    assert lk.clicks().count() == 1020 and silver.count() == 600
    assert {r["event_type"]: r["count"] for r in S.funnel(silver).collect()} == {
        "cart": 210, "purchase": 202, "view": 188}
    sessions = lk.session_features()
    assert sessions.count() == 165 and sessions.filter("session_id IS NULL").count() == 2
    assert sessions.agg(F.sum("is_abandoned")).first()[0] == 106
    assert sessions.agg(F.sum("num_views_before_cart")).first()[0] == 28
    assert lk.ml_features().count() == 163


def test_targets_by_join_equal_targets_in_one_pass(lk):
    bare = S.pre_cart_features(lk.silver())
    joined = S.with_targets(bare, lk.session_features())
    columns = sorted(joined.columns)
    assert columns == sorted(S.ml_features(lk.silver()).columns)
    assert rows_of(joined, *columns) == rows_of(S.ml_features(lk.silver()), *columns)


def test_silver_rules_on_text(spark):
    good = ["2019-11-01 00:00:00 UTC", " CART ", "1", "2", None, None, "3.5", "4", "s"]
    bad = []
    for column, value in ((0, "zz"), (1, "remove"), (2, "x"), (6, "-1"), (6, "free"), (6, None),
                          (7, "")):
        row = list(good)
        row[column] = value
        bad.append(tuple(row))
    frame = spark.createDataFrame([tuple(good), tuple(good), *bad], schemas.EVENTS_RAW)
    silver = V.to_silver(frame)
    got = silver.collect()
    assert len(got) == 1
    assert got[0]["event_type"] == "cart" and got[0]["price"] == 3.5
    assert got[0]["event_time"] == datetime(2019, 11, 1)
    audit = V.silver_audit(frame, silver).first()
    assert tuple(audit) == (9, 1, 8)


def test_curated_shape(spark, two_sessions):
    curated = V.conform_event_table(two_sessions)
    assert dict(curated.dtypes)["price"] == "decimal(12,2)"
    assert curated.filter("source = 'ecommerce' AND ingestion_time IS NOT NULL").count() == 8


def test_gold_plan_prunes_and_pushes(lk, capsys):
    S.first_cart(lk.silver()).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_type,cart)" in plan
    assert "ReadSchema: struct<event_time:timestamp,event_type:string,user_id:bigint," \
           "user_session:string>" in plan
