"""Every operator as a named query over the given tables, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake import schemas
from basketlake.functions import rules
from basketlake.models import abandonment, common, conversion, profiles
from basketlake.operators import (
    decisions, features, followups, history, kpis, metrics, sessions, silver, splits, trades,
)
from basketlake.plans import jobs
from basketlake.plans.layers import Lake, lake
from basketlake.plans.oracles import twin
from basketlake.session import scratch_path, ship_package
from basketlake.sinks import lake as sink
from basketlake.sources import lake as source
from basketlake.sources import streams
from basketlake.sources.clicks import as_clicks, as_landed
from basketlake.streaming import followups as live_followups
from basketlake.streaming.silver import (
    event_stream_to_silver, start_click_messages, start_click_stream, stored_errors, stored_silver,
)
from basketlake.streaming.trades import start_trade_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Output that compares alike in every engine.

    Instants become text, doubles have six digits, and the hour, which is missing
    where a session has no id, is a double as well.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif field.name == "hour_of_day":
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Lake` under ``name``."""
    def add(build: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plain(build(lake(spark, sf_dir)))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = twin(sql)
        return build
    return add


def _texts(rows, names: list[str]) -> str:
    """A rule table as a SQL VALUES list."""
    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS r({', '.join(names)})"


# --- Bronze and Silver -----------------------------------------------------------

_SILVER_SQL = "SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time) FROM silver"


@query("silver_events", _SILVER_SQL)
def _(lk: Lake):
    """From text rows, as landed."""
    return silver.to_silver(as_landed(lk.clicks()))


@query("normalise_events",
       "SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time) FROM clicks")
def _(lk: Lake):
    return silver.normalise_events(as_landed(lk.clicks()))


@query("silver_audit", """
SELECT b AS bronze_count, s AS silver_count, b - s AS removed_count
FROM (SELECT (SELECT count(*) FROM clicks) AS b, (SELECT count(*) FROM silver) AS s)""")
def _(lk: Lake):
    return silver.silver_audit(lk.clicks(), silver.to_silver(lk.clicks()))


@query("curated_events", """
SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
                  CAST(CAST(price AS DECIMAL(12,2)) AS DOUBLE) AS price),
       'ecommerce' AS source
FROM silver""")
def _(lk: Lake):
    curated = silver.conform_event_table(lk.silver())
    return curated.withColumn("price", F.col("price").cast("double")).drop("ingestion_time")


@query("bronze_to_silver_job", """
SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time),
       CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month
FROM silver""")
def _(lk: Lake):
    """Landed CSV, month partitions, audit: the whole job through storage."""
    base = scratch_path(lk.spark, "medallion")
    as_landed(lk.clicks()).write.option("header", True).csv(f"{base}/upload")
    sink.land_bronze(lk.spark, f"{base}/upload", f"{base}/bronze", 2024, 1)
    jobs.bronze_to_silver(lk.spark, f"{base}/bronze", f"{base}/silver")
    return source.read_layer(lk.spark, f"{base}/silver/events")


@query("replace_partition", """
SELECT CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month,
       count(*) AS n, round(sum(price), 6) AS total
FROM silver WHERE event_type <> 'view' GROUP BY ALL""")
def _(lk: Lake):
    """A second load of the same months replaces the first one."""
    path = scratch_path(lk.spark, "partitions")
    sink.replace_partition(lk.silver(), path)
    sink.replace_partition(lk.silver().filter(F.col("event_type") != "view"), path)
    return source.read_layer(lk.spark, path).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("gold_month_reload", """
SELECT 2023 AS year, 12 AS month, count(*) AS sessions, round(sum(total), 6) AS total, 0 AS aside
FROM (SELECT sum(CASE WHEN event_type = 'cart' THEN price ELSE 0 END) AS total
      FROM silver WHERE product_id < 50 GROUP BY user_session, user_id
      HAVING count(*) FILTER (WHERE event_type = 'cart') > 0)
UNION ALL
SELECT 2024, 1, count(*), round(sum(total_cart_value), 6),
       CAST((SELECT count(*) FROM silver WHERE product_id = 7) AS INTEGER)
FROM session_features""")
def _(lk: Lake):
    """Two months loaded, the second again, each time with stray rows of the first."""
    base = scratch_path(lk.spark, "months")
    back = F.col("event_time") - F.expr("INTERVAL 31 DAYS")
    earlier = lk.clicks().withColumn("event_time", back)
    months = {
        (2023, 12): earlier.filter("product_id < 50"),
        (2024, 1): lk.clicks().unionByName(earlier.filter("product_id = 7")),
    }
    for (year, month), rows in months.items():
        as_landed(rows).write.option("header", True).csv(f"{base}/upload-{year}-{month}")
        sink.land_bronze(lk.spark, f"{base}/upload-{year}-{month}", f"{base}/bronze", year, month)
        jobs.bronze_to_silver(lk.spark, f"{base}/bronze", f"{base}/silver", [(year, month)])
        jobs.silver_to_gold(lk.spark, f"{base}/silver", f"{base}/gold", [(year, month)])
    jobs.bronze_to_silver(lk.spark, f"{base}/bronze", f"{base}/silver", [(2024, 1)])
    jobs.silver_to_gold(lk.spark, f"{base}/silver", f"{base}/gold", [(2024, 1)])
    aside = sink.aside(lk.spark, f"{base}/silver/events", lk.silver()).count()
    gold = source.read_layer(lk.spark, f"{base}/gold/session_features")
    return gold.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("total_cart_value").alias("total"),
        F.max(F.when(F.col("year") == 2024, aside).otherwise(0)).alias("aside"))


@query("late_stray_reload", """
SELECT 2023 AS year, 12 AS month, count(*) AS n, round(sum(price), 6) AS total
FROM silver WHERE product_id < 50 OR product_id % 10 = 7
UNION ALL SELECT 2024, 1, count(*), round(sum(price), 6) FROM silver""")
def _(lk: Lake):
    """Strays of a month that is loaded already: the job loads that month once more."""
    base = scratch_path(lk.spark, "strays")
    earlier = lk.clicks().withColumn("event_time", F.col("event_time") - F.expr("INTERVAL 31 DAYS"))
    months = {
        (2023, 12): earlier.filter("product_id < 50"),
        (2024, 1): lk.clicks().unionByName(earlier.filter("product_id % 10 = 7")),
    }
    for (year, month), rows in months.items():
        as_landed(rows).write.option("header", True).csv(f"{base}/upload-{year}-{month}")
        sink.land_bronze(lk.spark, f"{base}/upload-{year}-{month}", f"{base}/bronze", year, month)
        jobs.bronze_to_silver(lk.spark, f"{base}/bronze", f"{base}/silver", [(year, month)])
    return source.read_layer(lk.spark, f"{base}/silver/events").groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("json_by_day", """
SELECT event_type, strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n,
       round(sum(price), 6) AS total
FROM silver GROUP BY ALL""")
def _(lk: Lake):
    """JSON day folders, read back with a schema at any depth."""
    path = scratch_path(lk.spark, "json")
    sink.write_json_by_day(lk.silver(), path, time="event_time")
    back = source.read_raw_json(lk.spark, path, schemas.EVENTS_SILVER)
    return back.groupBy(
        "event_type", F.date_format("event_time", "yyyy-MM-dd").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


# --- Gold ------------------------------------------------------------------------

@query("first_cart", """
SELECT user_session, user_id, strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time FROM first_cart""")
def _(lk: Lake):
    return sessions.first_cart(lk.silver())


@query("with_first_cart", """
SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
                  strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time) FROM timed""")
def _(lk: Lake):
    return sessions.with_first_cart(lk.silver(), lk.heavy_sessions())


_SESSION_SQL = """
SELECT * REPLACE (strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
                  strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time,
                  round(total_cart_value, 6) AS total_cart_value,
                  round(view_to_cart_ratio, 6) AS view_to_cart_ratio)
FROM session_features"""


@query("session_features", _SESSION_SQL)
def _(lk: Lake):
    return sessions.session_features(lk.silver(), lk.heavy_sessions())


@query("pre_cart_events", """
SELECT * EXCLUDE (viewed, at_cart)
         REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
                  strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time) FROM pre_cart""")
def _(lk: Lake):
    return sessions.pre_cart_events(sessions.with_first_cart(lk.silver(), lk.heavy_sessions()))


_ML_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}" for c in (
        "avg_viewed_price", "min_viewed_price", "max_viewed_price", "cart_value_at_first_cart",
        "avg_cart_item_price", "max_cart_item_price", "view_to_cart_ratio",
        "viewed_price_range"))
_ML_SQL = f"""
SELECT * REPLACE (strftime(first_event_time, '%Y-%m-%d %H:%M:%S.%f') AS first_event_time,
                  strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time, {_ML_ROUNDED})
FROM ml_features"""


@query("ml_features", _ML_SQL)
def _(lk: Lake):
    return sessions.ml_features(lk.silver(), lk.heavy_sessions())


@query("with_targets", _ML_SQL)
def _(lk: Lake):
    """Features without targets joined to the stored session table."""
    bare = sessions.pre_cart_features(lk.silver(), lk.heavy_sessions())
    return sessions.with_targets(bare, lk.session_features())


@query("cart_session_events", """
SELECT * REPLACE (strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time) FROM silver
WHERE user_session IN (SELECT user_session FROM silver
                       WHERE event_type = 'cart' AND user_session IS NOT NULL)""")
def _(lk: Lake):
    return sessions.cart_session_events(lk.silver(), lk.heavy_session_ids())


_CART_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}" for c in (
        "total_cart_value", "max_item_price", "min_item_price", "avg_item_price",
        "view_to_cart_ratio", "session_duration_sec"))


@query("cart_features", f"SELECT * REPLACE ({_CART_ROUNDED}) FROM cart_features")
def _(lk: Lake):
    return sessions.cart_features(lk.silver())


@query("funnel", "SELECT event_type, count(*) AS count FROM silver GROUP BY event_type")
def _(lk: Lake):
    return sessions.funnel(lk.silver())


@query("target_distribution",
       "SELECT converted, count(*) AS count FROM ml_features GROUP BY converted")
def _(lk: Lake):
    return metrics.target_distribution(lk.ml_features(), "converted")


@query("abandonment_rate",
       "SELECT round(avg(is_abandoned), 6) AS abandonment_rate FROM cart_features")
def _(lk: Lake):
    return metrics.abandonment_rate(lk.cart_features())


@query("overview_kpis", """
SELECT count(*) AS cart_sessions, CAST(sum(is_abandoned) AS BIGINT) AS abandoned_sessions,
       CAST(sum(converted) AS BIGINT) AS converted_sessions,
       round(sum(is_abandoned) * 100.0 / count(*), 6) AS abandonment_rate,
       round(sum(converted) * 100.0 / count(*), 6) AS conversion_rate
FROM session_features""")
def _(lk: Lake):
    return kpis.overview_kpis(lk.session_features())


@query("gold_sql", """
SELECT hour_of_day, count(*) AS sessions, CAST(sum(converted) AS BIGINT) AS conversions
FROM session_features GROUP BY hour_of_day""")
def _(lk: Lake):
    """Free SQL on a registered Gold layer."""
    lk.session_features()
    kpis.register_gold(lk.spark, {"gold_sessions": f"{lk.base}/session_features"})
    return kpis.run_sql(lk.spark, """
        SELECT hour_of_day, count(*) AS sessions, sum(converted) AS conversions
        FROM gold_sessions GROUP BY hour_of_day""")


@query("funnel_rates", """
SELECT v AS views, c AS carts, p AS purchases, v + c + p AS total_events,
       round(c * 100.0 / v, 6) AS view_to_cart, round(p * 100.0 / c, 6) AS cart_to_purchase,
       round(p * 100.0 / v, 6) AS view_to_purchase
FROM (SELECT count(*) FILTER (WHERE event_type = 'view') AS v,
             count(*) FILTER (WHERE event_type = 'cart') AS c,
             count(*) FILTER (WHERE event_type = 'purchase') AS p FROM silver)""")
def _(lk: Lake):
    return kpis.funnel_rates(sessions.funnel(lk.silver()))


# --- Training rows -----------------------------------------------------------------

@query("admissible_ml_rows", f"""
SELECT session_id, user_id, strftime(first_event_time, '%Y-%m-%d %H:%M:%S.%f') AS first_event_time,
       strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time, converted, is_abandoned,
       {', '.join(f'round({c}, 6) AS {c}' if c in (
           'avg_viewed_price', 'viewed_price_range', 'cart_value_at_first_cart',
           'view_to_cart_ratio') else c for c in schemas.BASE_FEATURES)}
FROM ml_features""")
def _(lk: Lake):
    return features.admissible_ml_rows(lk.ml_features())


@query("user_history", """
SELECT session_id, user_id, user_prior_sessions, user_prior_conversions,
       user_prior_abandonments, round(user_prior_conversion_rate, 6) AS user_prior_conversion_rate,
       round(user_prior_abandon_rate, 6) AS user_prior_abandon_rate,
       strftime(user_first_prior_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS user_first_prior_cart_time,
       round(user_lifetime_hours, 6) AS user_lifetime_hours
FROM history_features""")
def _(lk: Lake):
    rows = history.with_history(features.admissible_ml_rows(lk.ml_features()), lk.heavy_users())
    return rows.select(
        "session_id", "user_id", *schemas.HISTORY_FEATURES, "user_first_prior_cart_time")


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


@query("derived_features", f"""
SELECT session_id, user_id, {_rounded(schemas.FEATURES_V2)} FROM derived""")
def _(lk: Lake):
    rows = features.fill_features(features.admissible_ml_rows(lk.ml_features()))
    return features.derive_features(rows).select("session_id", "user_id", *schemas.FEATURES_V2)


@query("ml_dataset", f"""
SELECT session_id, user_id, converted, {_rounded(schemas.FEATURES_V3)} FROM dataset""")
def _(lk: Lake):
    return features.ml_dataset(lk.ml_features(), heavy_users=lk.heavy_users())


@query("coerce_numeric", """
SELECT p_partkey, coalesce(TRY_CAST(p_name AS DOUBLE), 0.0) AS p_name,
       coalesce(TRY_CAST(p_size AS DOUBLE), 0.0) AS p_size,
       coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 0.0) AS p_brand
FROM part""")
def _(lk: Lake):
    """Text that is no number, text that is one, and numbers."""
    rows = lk.table("part").select(
        "p_partkey", "p_name", "p_size", F.split_part("p_brand", F.lit("#"), F.lit(2))
        .alias("p_brand"))
    return features.coerce_numeric(rows, ["p_name", "p_size", "p_brand"])


_BUCKET = "CAST('0x' || substr(digest, 1, 8) AS BIGINT) % 100"


@query("split_3way", f"""
SELECT session_id, user_id,
       CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation'
            ELSE 'test' END AS split
FROM keyed""")
def _(lk: Lake):
    return splits.split_3way(lk.ml_features().select("session_id", "user_id"))


@query("split_2way", f"""
SELECT session_id, user_id, CASE WHEN {_BUCKET} < 80 THEN 'train' ELSE 'test' END AS split
FROM keyed""")
def _(lk: Lake):
    return splits.split_2way(lk.ml_features().select("session_id", "user_id"))


@query("split_stratified", """
SELECT session_id, user_id, converted,
       CASE WHEN row_number() OVER (PARTITION BY converted ORDER BY digest, session_id, user_id)
                 <= round(count(*) OVER (PARTITION BY converted) * 0.2)
            THEN 'test' ELSE 'train' END AS split
FROM keyed""")
def _(lk: Lake):
    rows = lk.ml_features().select("session_id", "user_id", "converted")
    return splits.split_stratified(rows, "converted")


@query("split_metadata", f"""
SELECT 'conversion_propensity_v3' AS version, 32 AS total_features, 12 AS base_features,
       14 AS derived_features, 6 AS history_features, split, converted, count(*) AS rows
FROM (SELECT converted, CASE WHEN {_BUCKET} < 70 THEN 'train'
             WHEN {_BUCKET} < 85 THEN 'validation' ELSE 'test' END AS split FROM keyed)
GROUP BY split, converted""")
def _(lk: Lake):
    return jobs.split_metadata(lk.dataset())


@query("training_files", f"""
SELECT CASE WHEN {_BUCKET} < 70 THEN 'train' WHEN {_BUCKET} < 85 THEN 'validation'
            ELSE 'test' END AS split,
       count(*) AS n, CAST(sum(converted) AS DOUBLE) AS converted,
       round(sum(cart_value_at_first_cart), 4) AS cart_value,
       CAST(sum(user_prior_sessions) AS DOUBLE) AS prior_sessions
FROM (SELECT d.*, k.digest FROM dataset d JOIN keyed k
        ON d.session_id = k.session_id AND d.user_id = k.user_id) GROUP BY ALL""")
def _(lk: Lake):
    """Positional CSV sets written and read back by position."""
    order = schemas.training_columns(schemas.FEATURES_V3)
    base = scratch_path(lk.spark, "sets")
    sets = None
    for name in ("train", "validation", "test"):
        sink.write_split_csv(lk.part(name).select(*order), f"{base}/{name}")
        back = source.read_positional_csv(lk.spark, f"{base}/{name}", order).select(
            F.lit(name).alias("split"), "converted", "cart_value_at_first_cart",
            "user_prior_sessions")
        sets = back if sets is None else sets.unionByName(back)
    return sets.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("converted").alias("converted"),
        F.round(F.sum("cart_value_at_first_cart"), 4).alias("cart_value"),
        F.sum("user_prior_sessions").alias("prior_sessions"))


_SAMPLE = 500


@query("ml_sample", f"""
{_SESSION_SQL} ORDER BY session_id NULLS FIRST, user_id LIMIT {_SAMPLE}""")
def _(lk: Lake):
    return splits.ml_sample(lk.session_features(), _SAMPLE)


@query("bounded_sample", f"""
SELECT session_id, user_id, converted FROM keyed
ORDER BY digest, session_id, user_id LIMIT {_SAMPLE}""")
def _(lk: Lake):
    return splits.bounded_sample(
        lk.ml_features().select("session_id", "user_id", "converted"), _SAMPLE)


@query("preview")
def _(lk: Lake):
    return splits.preview(lk.ml_features(), 10, ["session_id", "user_id", *schemas.BASE_FEATURES])


@query("labelled_sessions", """
SELECT session_id, CAST(user_id AS INTEGER) AS user_id,
       round(total_cart_value, 6) AS total_cart_value,
       CAST(num_cart_items AS INTEGER) AS num_cart_items,
       CAST(num_views_before_cart AS INTEGER) AS num_views_before_cart,
       CAST(session_duration_sec AS INTEGER) AS session_duration_sec, hour_of_day, is_night,
       user_profile, is_abandoned
FROM labelled""")
def _(lk: Lake):
    """The labelled table as header CSV, read back with its schema."""
    path = scratch_path(lk.spark, "labelled")
    sink.write_export_csv(lk.labelled(), path)
    return source.read_labelled_sessions(lk.spark, path)


# --- Metrics -----------------------------------------------------------------------

def _scored(lk: Lake) -> DataFrame:
    value = F.col("cart_value_at_first_cart")
    probability = value / (value + 100.0)
    return lk.ml_features().select(
        "session_id", "user_id", "converted", "is_abandoned", "num_views_before_cart", "is_night",
        value.alias("total_cart_value"), probability.alias("probability_1"),
        F.when(probability >= 0.5, 1).otherwise(0).alias("prediction"),
        (F.col("hour_of_day") % 3).alias("cluster"),
    )


_COUNTS = """
SELECT count(*) FILTER (WHERE converted = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE converted = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE converted = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE converted = 0 AND prediction = 0) AS tn
FROM scored"""

_RATES = """
SELECT *, round(CASE WHEN precision_ + recall_ > 0
                     THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0.0 END, 6) AS f1,
       round(precision_, 6) AS precision, round(recall_, 6) AS recall
FROM (SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision_,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall_
      FROM ({counts}))"""


def _rates(counts: str) -> str:
    return f"SELECT * EXCLUDE (precision_, recall_) FROM ({_RATES.format(counts=counts)})"


@query("confusion_counts", _COUNTS)
def _(lk: Lake):
    return metrics.confusion_counts(_scored(lk))


@query("classification_metrics", _rates(_COUNTS))
def _(lk: Lake):
    return metrics.classification_metrics(metrics.confusion_counts(_scored(lk)))


_SWEEP = _rates(f"""
SELECT threshold,
       count(*) FILTER (WHERE converted = 1 AND probability_1 >= threshold) AS tp,
       count(*) FILTER (WHERE converted = 0 AND probability_1 >= threshold) AS fp,
       count(*) FILTER (WHERE converted = 1 AND probability_1 < threshold) AS fn,
       count(*) FILTER (WHERE converted = 0 AND probability_1 < threshold) AS tn
FROM scored, (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in metrics.THRESHOLDS)}) t(threshold)
GROUP BY threshold""")


@query("threshold_sweep", _SWEEP)
def _(lk: Lake):
    return metrics.threshold_sweep(_scored(lk))


@query("best_threshold", f"SELECT * FROM ({_SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1")
def _(lk: Lake):
    return metrics.best_threshold(metrics.threshold_sweep(_scored(lk)))


@query("curve_areas", """
SELECT round(sum(neg * (tp + pos / 2.0)) / (max(p) * max(n)), 6) AS roc_auc,
       round(sum(pos * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE (tp + pos) / (tp + pos + fp + neg) END
                        + (tp + pos) / (tp + pos + fp + neg)) / 2) / max(p), 6) AS pr_auc
FROM (SELECT CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
             CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n,
             CAST(sum(pos) OVER (ORDER BY probability_1 DESC) AS DOUBLE) - pos AS tp,
             CAST(sum(neg) OVER (ORDER BY probability_1 DESC) AS DOUBLE) - neg AS fp
      FROM (SELECT probability_1, count(*) FILTER (WHERE converted = 1) AS pos,
                   count(*) FILTER (WHERE converted = 0) AS neg FROM scored GROUP BY probability_1))""")
def _(lk: Lake):
    """Exact areas under both curves, from counts per score."""
    areas = metrics.curve_areas(metrics.score_counts(_scored(lk)))
    return areas.select(*[F.round(c, 6).alias(c) for c in areas.columns])


@query("class_report", """
SELECT class, round(precision_, 6) AS precision, round(recall_, 6) AS recall,
       round(CASE WHEN precision_ + recall_ > 0
                  THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0.0 END, 6) AS f1,
       support
FROM (SELECT CAST(c AS VARCHAR) AS class,
             count(*) FILTER (WHERE converted = c AND prediction = c)
               / greatest(count(*) FILTER (WHERE prediction = c), 1) AS precision_,
             count(*) FILTER (WHERE converted = c AND prediction = c)
               / greatest(count(*) FILTER (WHERE converted = c), 1) AS recall_,
             count(*) FILTER (WHERE converted = c) AS support
      FROM scored, (VALUES (0), (1)) t(c) GROUP BY c)""")
def _(lk: Lake):
    return metrics.class_report(_scored(lk))


_BIN = """CASE WHEN probability_1 <= 0.25 THEN 'Baixa Propensao'
     WHEN probability_1 <= 0.75 THEN '{middle}' ELSE 'Alta Propensao' END"""
_BAND = _BIN.format(middle="Moderada Propensao")


@query("score_band_distribution", f"""
SELECT score_band, count(*) AS count
FROM (SELECT {_BIN.format(middle='Media Propensao')} AS score_band FROM scored)
GROUP BY score_band""")
def _(lk: Lake):
    banded = _scored(lk).withColumn(
        "score_band", decisions.propensity_bin(F.col("probability_1")))
    return metrics.score_band_distribution(banded)


@query("cluster_sizes", "SELECT cluster, count(*) AS count FROM scored GROUP BY cluster")
def _(lk: Lake):
    return metrics.cluster_sizes(_scored(lk))


@query("cluster_conversion", """
SELECT cluster, count(*) AS sessions, round(avg(converted) * 100, 2) AS conversion_rate,
       round(avg(is_abandoned) * 100, 2) AS abandonment_rate
FROM scored GROUP BY cluster""")
def _(lk: Lake):
    return metrics.cluster_conversion(_scored(lk))


@query("cluster_summary", f"""
SELECT CAST(hour_of_day % 3 AS INTEGER) AS cluster,
       {', '.join(f'round(avg({c}), 2) AS {c}' for c in schemas.PROFILE_FEATURES)}
FROM ml_features GROUP BY ALL""")
def _(lk: Lake):
    rows = lk.ml_features().withColumn("cluster", F.col("hour_of_day") % 3)
    return metrics.cluster_summary(rows, schemas.PROFILE_FEATURES)


# --- Decisions ---------------------------------------------------------------------

@query("score_band", f"""
SELECT session_id, user_id, {_BAND} AS score_band,
       {_BIN.format(middle='Media Propensao')} AS report_bin FROM scored""")
def _(lk: Lake):
    score = F.col("probability_1")
    return _scored(lk).select(
        "session_id", "user_id", decisions.score_band(score).alias("score_band"),
        decisions.propensity_bin(score).alias("report_bin"))


@query("decide_from_cluster", f"""
SELECT s.session_id, s.user_id, s.cluster, p.profile, s.score_band, s.conversion_score,
       a.action, a.benefit, a.message, CAST(NULL AS VARCHAR) AS invalid_reason
FROM (SELECT *, round_even(probability_1, 4) AS conversion_score, {_BAND} AS score_band
      FROM scored) s
JOIN (SELECT * FROM {_texts(rules.CLUSTER_PROFILES, ['cluster', 'profile'])}) p
  ON p.cluster = s.cluster
JOIN (SELECT * FROM {_texts(rules.ACTIONS,
                            ['profile', 'score_band', 'action', 'benefit', 'message'])}) a
  ON a.profile = p.profile AND a.score_band = s.score_band""")
def _(lk: Lake):
    rows = _scored(lk).select(
        "session_id", "user_id", "cluster", F.col("probability_1").alias("conversion_score"))
    return decisions.decide_from_cluster(rows)


@query("decide", f"""
SELECT s.session_id, s.user_id, s.profile, s.score_band, s.conversion_score,
       a.action, a.benefit, a.message, s.invalid_reason
FROM (SELECT session_id, user_id, round_even(score, 4) AS conversion_score,
             CASE WHEN score > 1 THEN NULL WHEN score <= 0.25 THEN 'Baixa Propensao'
                  WHEN score <= 0.75 THEN 'Moderada Propensao' ELSE 'Alta Propensao' END
               AS score_band,
             CASE WHEN is_night = 1 THEN 'Cacador de Descontos'
                  WHEN num_views_before_cart > 0 THEN 'Navegador Indeciso'
                  ELSE 'Comprador de Alta Intencao' END AS profile,
             CASE WHEN score > 1 THEN 'score outside [0, 1]' END AS invalid_reason
      FROM (SELECT *, total_cart_value / 100.0 AS score FROM scored)) s
LEFT JOIN (SELECT * FROM {_texts(rules.ACTIONS,
                                 ['profile', 'score_band', 'action', 'benefit', 'message'])}) a
  ON a.profile = s.profile AND a.score_band = s.score_band""")
def _(lk: Lake):
    """Profiles by rule, and scores of which some lie outside [0, 1]."""
    profile = F.when(F.col("is_night") == 1, rules.DISCOUNT_HUNTER).when(
        F.col("num_views_before_cart") > 0, rules.UNDECIDED).otherwise(rules.HIGH_INTENT)
    rows = _scored(lk).select(
        "session_id", "user_id", profile.alias("profile"),
        (F.col("total_cart_value") / 100.0).alias("conversion_score"))
    return decisions.decide(rows)


@query("recommend_coupon", f"""
SELECT session_id, user_id, round(total_cart_value, 6) AS total_cart_value,
       round(p_abandonment, 6) AS p_abandonment, s.coupon_code, coupon_label,
       discount_pct, free_shipping, urgency_level, rationale,
       round(CASE WHEN s.coupon_code <> 'NENHUM'
                  THEN total_cart_value * 0.35 * (1.0 - discount_pct) ELSE 0.0 END, 6)
         AS estimated_recovered_gmv
FROM (SELECT *, CASE WHEN p_abandonment < 0.40 THEN 'NENHUM'
        WHEN p_abandonment < 0.65 THEN CASE WHEN total_cart_value >= 300 THEN 'FRETE_GRATIS'
                                            ELSE 'DESC5' END
        WHEN p_abandonment < 0.85 THEN CASE WHEN total_cart_value >= 500 THEN 'DESC10'
                                            ELSE 'DESC5_FRETE' END
        ELSE CASE WHEN total_cart_value >= 800 THEN 'RECUPE15' ELSE 'DESC10_FRETE' END END
        AS coupon_code
      FROM (SELECT session_id, user_id, total_cart_value * 10 AS total_cart_value,
                   1 - probability_1 AS p_abandonment FROM scored)) s
JOIN (SELECT coupon_code, coupon_label, CAST(discount_pct AS DOUBLE) AS discount_pct,
             free_shipping, urgency_level, rationale
      FROM {_texts(rules.COUPONS, ['coupon_code', 'coupon_label', 'discount_pct',
                                   'free_shipping', 'urgency_level', 'rationale'])}) c
  ON c.coupon_code = s.coupon_code""")
def _(lk: Lake):
    carts = _scored(lk).select(
        "session_id", "user_id", (F.col("total_cart_value") * 10).alias("total_cart_value"),
        (1 - F.col("probability_1")).alias("p_abandonment"))
    return decisions.recommend_coupon(carts)


_FALLBACK = """CASE WHEN num_views_before_cart <= 3 THEN 'high_intent'
     WHEN num_views_before_cart >= 6 OR is_night = 1 THEN 'bargain_hunter' ELSE 'browser' END"""
_REACHES = """CASE WHEN {p} = 'high_intent' THEN total_cart_value >= 300
     WHEN {p} = 'bargain_hunter' THEN total_cart_value >= 400 ELSE FALSE END"""
_PRESCRIBED = f"""
JOIN (SELECT * FROM {_texts(rules.PROFILE_COUPONS, ['p', 'reaches', 'assigned_coupon',
                                                    'coupon_label'])}) c
  ON c.p = s.predicted_profile AND c.reaches = s.reaches
JOIN (SELECT * FROM {_texts(rules.PROFILE_TEXTS, ['p', 'profile_name_pt',
                                                  'action_rationale'])}) t
  ON t.p = s.predicted_profile"""


@query("prescribe_by_profile", f"""
SELECT s.session_id, CAST(s.user_id AS INTEGER) AS user_id, s.predicted_profile,
       s.total_cart_value, c.assigned_coupon,
       c.coupon_label, t.profile_name_pt, t.action_rationale
FROM (SELECT *, {_REACHES.format(p='predicted_profile')} AS reaches
      FROM (SELECT session_id, user_id, round(total_cart_value * 5, 6) AS total_cart_value,
                   CASE WHEN session_duration_sec < 60 THEN 'high_intent'
                        WHEN session_duration_sec < 20000 THEN 'bargain_hunter'
                        ELSE 'browser' END AS predicted_profile
            FROM labelled)) s {_PRESCRIBED}""")
def _(lk: Lake):
    duration = F.col("session_duration_sec")
    profile = F.when(duration < 60, "high_intent").when(
        duration < 20000, "bargain_hunter").otherwise("browser")
    carts = lk.labelled().select(
        "session_id", "user_id", F.round(F.col("total_cart_value") * 5, 6)
        .alias("total_cart_value"), profile.alias("predicted_profile"))
    return decisions.prescribe_by_profile(carts)


@query("profile_rules", f"""
SELECT session_id, user_id, {_FALLBACK} AS fallback_profile, user_profile AS label_profile
FROM labelled""")
def _(lk: Lake):
    views, night = F.col("num_views_before_cart"), F.col("is_night")
    return lk.session_features().select(
        "session_id", "user_id",
        decisions.profile_fallback(views, night).alias("fallback_profile"),
        decisions.profile_label_rule(
            views, F.col("session_duration_sec"), night, F.col("total_cart_value"))
        .alias("label_profile"))


# --- Follow-ups ----------------------------------------------------------------------

def _clock(lk: Lake):
    """What a stream's watermark reads after the last event."""
    latest = lk.silver().agg(
        F.date_trunc("millisecond", F.max("event_time")).alias("t")).first()["t"]
    return F.lit(latest - timedelta(minutes=10))


def _unconverted_sql(delay: str) -> str:
    return f"""
SELECT user_session, user_id, strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time,
       strftime(first_cart_time + {delay}, '%Y-%m-%d %H:%M:%S.%f') AS deadline
FROM bought_since WHERE bought IS NULL OR bought > first_cart_time + {delay}"""


@query("unconverted_carts_5min", _unconverted_sql("INTERVAL 5 MINUTE"))
def _(lk: Lake):
    return followups.unconverted_carts(
        lk.silver(), followups.REMINDER_DELAY, heavy=lk.heavy_sessions())


@query("unconverted_carts_1h", _unconverted_sql("INTERVAL 1 HOUR"))
def _(lk: Lake):
    return followups.unconverted_carts(
        lk.silver(), followups.OFFER_DELAY, heavy=lk.heavy_sessions())


_REMINDER_SQL = f"""
SELECT u.*, {', '.join(f"'{text}' AS {name}" for name, text in rules.REMINDER.items())}
FROM clock, ({_unconverted_sql("INTERVAL 5 MINUTE")}) u
WHERE deadline <= strftime(as_of, '%Y-%m-%d %H:%M:%S.%f')"""

_OFFER_SQL = f"""
SELECT user_session, user_id, strftime(first_cart_time, '%Y-%m-%d %H:%M:%S.%f') AS first_cart_time,
       strftime(deadline, '%Y-%m-%d %H:%M:%S.%f') AS deadline, round(total_cart_value, 6) AS total_cart_value,
       num_cart_items, num_views_before_cart, session_duration_sec, hour_of_day,
       round_even(num_views_before_cart / num_cart_items, 2) AS view_to_cart_ratio, is_night,
       predicted_profile AS ml_predicted_profile,
       CAST(68.0 AS DOUBLE) AS ml_abandonment_risk_pct,
       profile_name_pt, assigned_coupon, coupon_label, action_rationale,
       {', '.join(f"'{text}' AS {name}" for name, text in rules.OFFER.items())}
FROM (SELECT *, {_REACHES.format(p='predicted_profile')} AS reaches
      FROM (SELECT *, {_FALLBACK} AS predicted_profile
            FROM (SELECT *, CASE WHEN hour_of_day >= 22 OR hour_of_day < 6 THEN 1 ELSE 0 END
                           AS is_night FROM offer_sessions))) s {_PRESCRIBED}"""


@query("cart_reminders", _REMINDER_SQL)
def _(lk: Lake):
    return followups.cart_reminders(lk.silver(), _clock(lk), lk.heavy_sessions())


@query("cart_offers", _OFFER_SQL)
def _(lk: Lake):
    due = followups.offer_sessions(lk.silver(), _clock(lk), lk.heavy_sessions())
    return live_followups.scored_offers(due)


@query("cart_offers_scored")
def _(lk: Lake):
    """Offers with risk and profile from the fitted models."""
    due = followups.offer_sessions(lk.silver(), heavy=lk.heavy_sessions())
    return live_followups.scored_offers(due, lk.abandonment_7f()[0], lk.profile_classifier()[0])


def _click_stream(lk: Lake) -> DataFrame:
    raw = (
        lk.spark.readStream.schema(lk.table("events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(lk.sf_dir)
    )
    return event_stream_to_silver(as_clicks(raw))


def _files_a_batch(lk: Lake, batches: int) -> int:
    """So many landed files that all batches together keep every core busy."""
    return -(-lk.spark.sparkContext.defaultParallelism // batches)


@query("stream_silver", _SILVER_SQL)
def _(lk: Lake):
    """The click-stream job over six batches of landed files with mixed times, so most rows come late."""
    base = scratch_path(lk.spark, "clicks")
    files = _files_a_batch(lk, 6)
    as_landed(lk.clicks()).repartition(6 * files, "event_time", "user_id").write.parquet(f"{base}/landed")
    events = streams.read_event_stream(lk.spark, "parquet", f"{base}/landed", maxFilesPerTrigger=str(files))
    for running in start_click_stream(events, f"{base}/out", f"{base}/progress", trigger={"availableNow": True}):
        running.awaitTermination()
    return stored_silver(lk.spark, f"{base}/out/silver")


@query("stream_click_errors", """
SELECT true AS accepted, count(*) AS n FROM silver WHERE event_type <> 'cart'
UNION ALL SELECT false, count(*) FROM clicks WHERE event_type = 'cart'""")
def _(lk: Lake):
    """The click-stream job over JSON messages, those of carts cut short: Silver rows and error rows."""
    base = scratch_path(lk.spark, "click_messages")
    text = F.to_json(F.struct(*schemas.EVENTS_RAW.names))
    spoilt = F.when(F.lower(F.trim("event_type")) == "cart", F.substring(text, 1, 25)).otherwise(text)
    files = _files_a_batch(lk, 3)
    as_landed(lk.clicks()).select(spoilt.alias("value")).repartition(3 * files).write.text(f"{base}/landed")
    messages = streams.read_message_stream(lk.spark, "text", f"{base}/landed", maxFilesPerTrigger=str(files))
    for running in start_click_messages(messages, f"{base}/out", f"{base}/progress", trigger={"availableNow": True}):
        running.awaitTermination()
    tables = ((True, stored_silver(lk.spark, f"{base}/out/silver")), (False, stored_errors(lk.spark, f"{base}/out/errors")))
    counts = [rows.agg(F.lit(good).alias("accepted"), F.count(F.lit(1)).alias("n")) for good, rows in tables]
    return counts[0].unionByName(counts[1])


def _followed_up(lk: Lake, kind: str) -> DataFrame:
    """Messages of the follow-up query with its ledger, run to the end of the table."""
    base = scratch_path(lk.spark, kind)
    live_followups.start_followups(
        _click_stream(lk), f"{base}/out", f"{base}/progress", {"availableNow": True}, kinds=[kind]).awaitTermination()
    return live_followups.read_messages(lk.spark, f"{base}/out", kind)


@query("stream_cart_reminders", _REMINDER_SQL)
def _(lk: Lake):
    return _followed_up(lk, "reminder")


@query("stream_cart_offers", _OFFER_SQL)
def _(lk: Lake):
    return _followed_up(lk, "offer")


# --- Trades --------------------------------------------------------------------------

def _as_prices(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_returnflag").alias("ticker"),
        (F.col("l_extendedprice") / 1000.0 - 5.0).alias("price"),
        F.col("l_quantity").cast("int").alias("volume"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        .alias("event_time"))


def _raw_orders(lk: Lake) -> DataFrame:
    joined = lk.table("orders").join(
        lk.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("order_id"),
        F.col("o_custkey").cast("string").alias("client_id"),
        F.col("l_returnflag").alias("ticker"), F.col("o_orderstatus").alias("order_type"),
        (F.col("l_quantity").cast("int") - 5).alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.col("o_totalprice").alias("total_value"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        .alias("event_time"))


_PRICES_SQL = """
SELECT ticker, round(price, 6) AS price, volume, event_time,
       CASE WHEN price < 30 THEN 'LOW' ELSE 'HIGH' END AS price_band
FROM raw_prices WHERE price > 0"""


@query("clean_prices", _PRICES_SQL)
def _(lk: Lake):
    return trades.clean_prices(_as_prices(lk.table("lineitem")))


_CLEAN_ORDERS = """
SELECT order_id, sha256(client_id) AS client_id_masked, ticker, order_type, quantity,
       round(price, 6) AS price, round(quantity * price, 6) AS total_value, event_time
FROM raw_orders WHERE quantity > 0"""


@query("clean_orders", _CLEAN_ORDERS)
def _(lk: Lake):
    return trades.clean_orders(_raw_orders(lk))


@query("stream_orders", _CLEAN_ORDERS)
def _(lk: Lake):
    """Curated orders after a run of the orders topic."""
    base = scratch_path(lk.spark, "orders")
    _raw_orders(lk).select(F.to_json(F.struct("*"))).write.options(**sink.COMPRESSED).text(f"{base}/in")
    messages = streams.read_message_stream(lk.spark, "text", f"{base}/in")
    for running in start_trade_stream(messages, "orders", base, f"{base}/progress", available_now=True):
        running.awaitTermination()
    return source.read_layer(lk.spark, f"{base}/curated/orders").drop("batch_id")


@query("type_raw_prices",
       "SELECT ticker, round(price, 6) AS price, volume, event_time FROM raw_prices")
def _(lk: Lake):
    texts = _as_prices(lk.table("lineitem")).select(
        *[F.col(c).cast("string").alias(c) for c in ("ticker", "price", "volume", "event_time")])
    return trades.type_raw_prices(texts).drop("processed_at")


@query("type_raw_orders", """
SELECT order_id, ticker, quantity, round(price, 6) AS price, round(total_value, 6) AS total_value,
       event_time FROM raw_orders""")
def _(lk: Lake):
    return trades.type_raw_orders(_raw_orders(lk)).drop("processed_at")


@query("ticker_summary", """
SELECT ticker, round(avg(price), 4) AS avg_price, CAST(sum(volume) AS BIGINT) AS total_volume
FROM raw_prices GROUP BY ticker""")
def _(lk: Lake):
    ticks = trades.type_ticks(_as_prices(lk.table("lineitem")))
    return trades.ticker_summary(ticks).withColumn("avg_price", F.round("avg_price", 4))


def _price_messages(lk: Lake, spoil: bool) -> DataFrame:
    """Prices as JSON text; every message of return flag R is cut short if ``spoil``."""
    raw = (
        lk.spark.readStream.schema(lk.table("lineitem").schema)
        .option("pathGlobFilter", "lineitem.parquet").parquet(lk.sf_dir)
    )
    text = F.to_json(F.struct("ticker", "price", "volume", "event_time"))
    if spoil:
        text = F.when(F.col("ticker") == "R", F.substring(text, 1, 20)).otherwise(text)
    return _as_prices(raw).select(text.alias("value"))


def _run_trades(lk: Lake, spoil: bool) -> str:
    base = scratch_path(lk.spark, "trades")
    for running in start_trade_stream(
        _price_messages(lk, spoil), "prices", base, f"{base}/progress", available_now=True
    ):
        running.awaitTermination()
    return base


@query("stream_trades", _PRICES_SQL)
def _(lk: Lake):
    """Curated prices after a run of the message stream."""
    stored = source.read_layer(lk.spark, f"{_run_trades(lk, False)}/curated/prices")
    return stored.drop("batch_id")


@query("stream_quarantine", """
SELECT ticker <> 'R' AS accepted, count(*) AS n FROM raw_prices
WHERE ticker = 'R' OR price > 0 GROUP BY ALL""")
def _(lk: Lake):
    """Messages accepted into the JSON lake and messages set aside."""
    base = _run_trades(lk, True)
    good = source.read_raw_json(lk.spark, f"{base}/raw/prices", schemas.RAW_PRICES)
    bad = source.read_raw_json(
        lk.spark, f"{base}/quarantine/prices", T.StructType([T.StructField("value", T.StringType())]), recursive=True)
    both = good.select(F.lit(True).alias("accepted")).unionByName(
        bad.select(F.lit(False).alias("accepted")))
    return both.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


# --- Models ----------------------------------------------------------------------------

def _scores(model, rows: DataFrame) -> DataFrame:
    return common.score(model, rows).select(
        "session_id", "user_id", "converted", "probability_1", "prediction")


@query("train_rf_v3")
def _(lk: Lake):
    return _scores(lk.rf_v3(), lk.part("validation"))


@query("train_gbt_v3")
def _(lk: Lake):
    return _scores(lk.gbt_v3(), lk.part("validation"))


@query("training_report")
def _(lk: Lake):
    winner, model, areas = lk.winner()
    return conversion.training_report(winner, model, areas, lk.part("test"))


@query("tuned_thresholds")
def _(lk: Lake):
    return conversion.tune_threshold(lk.winner()[1], lk.part("validation"))


@query("final_threshold_eval")
def _(lk: Lake):
    """With the winner stored and loaded again."""
    path = f"{scratch_path(lk.spark, 'model')}/best_model"
    common.save_model(lk.winner()[1], path)
    model = common.load_model(path)
    sweep = conversion.tune_threshold(model, lk.part("validation"))
    return conversion.final_threshold_eval(model, sweep, lk.part("test"))


@query("score_conversion_v1")
def _(lk: Lake):
    scored = conversion.score_conversion(
        lk.propensity(), splits.part(lk.propensity_rows(), "test"))
    return scored.select("session_id", "user_id", "converted", "conversion_score", "score_band")


@query("propensity_metrics_v1")
def _(lk: Lake):
    return conversion.propensity_metrics(lk.propensity(), splits.part(lk.propensity_rows(), "test"))


@query("feature_importance_v1")
def _(lk: Lake):
    return common.feature_importance(lk.propensity(), schemas.PROPENSITY_FEATURES)


@query("compare_abandonment_models")
def _(lk: Lake):
    return lk.abandonment()[1]


@query("recommend_batch")
def _(lk: Lake):
    return abandonment.recommend_batch(lk.cart_features(), lk.abandonment()[0])


@query("abandonment_7f")
def _(lk: Lake):
    return lk.abandonment_7f()[1]


@query("profile_classifier")
def _(lk: Lake):
    return lk.profile_classifier()[1]


@query("customer_clusters")
def _(lk: Lake):
    return lk.clustered()


@query("cluster_profiles")
def _(lk: Lake):
    """Conversion per named profile of the fit."""
    centroids = profiles.centroids_original_scale(lk.segments(), lk.profile_rows())
    return decisions.with_profile(
        metrics.cluster_conversion(lk.clustered()), profiles.profile_mapping(centroids))


@query("centroids")
def _(lk: Lake):
    return profiles.centroids_original_scale(lk.segments(), lk.profile_rows())


@query("silhouette")
def _(lk: Lake):
    return profiles.silhouette(lk.segments(), lk.profile_rows())
