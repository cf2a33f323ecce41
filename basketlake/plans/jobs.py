"""The pipeline as jobs between lake paths; each job scans stored layers and writes once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.models import common, conversion, profiles
from basketlake.operators import features, kpis, sessions, silver, splits
from basketlake.operators.metrics import (
    cluster_conversion, cluster_sizes, cluster_summary, score_band_distribution,
)
from basketlake.operators.skew import heavy_keys
from basketlake.operators.trades import ticker_summary, type_ticks
from basketlake.session import scratch_path
from basketlake.sinks import lake as sink
from basketlake.sources import lake as source


def _audited(spark: SparkSession, landed: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    sink.write_report_csv(silver.silver_audit(landed, stored), path)
    return spark.read.schema(
        "bronze_count bigint, silver_count bigint, removed_count bigint"
    ).option("header", True).csv(path)


def _typed(spark: SparkSession, landed: DataFrame) -> DataFrame:
    """The landed rows typed and stored once: the text is parsed a single time, and the
    audit counts from file footers."""
    path = scratch_path(spark, "typed")
    typed = silver.normalise_events(landed)
    sink.write_layer(typed, path)
    return spark.read.schema(typed.schema).parquet(path)


def _load_silver_month(
    spark: SparkSession, bronze: str, events: str, year: int, month: int
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rebuild one month from its landed file and the strays of other loads; its typed rows and strays' months."""
    typed = _typed(spark, source.read_bronze_csv(spark, sink.month_folder(bronze, year, month)))
    valid = silver.valid_events(typed)
    joined = valid.unionByName(sink.set_aside(spark, events, valid, year, month))
    return typed, sink.load_month(silver.dedup_events(joined), events, year, month)


def bronze_to_silver(
    spark: SparkSession, bronze: str, target: str, months: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Clean landed CSV into the month-partitioned Silver layer; gives the audit row.

    Without ``months`` all of Bronze is read and every month it holds is rebuilt. With
    them those landed months are read and their partitions replaced; rows of other months
    are set aside until their own month is loaded, and where that month is in Silver
    already it is loaded again (``rerun_months`` lists those, so that Gold follows). The heaviest sessions
    are stored beside the layer for the Gold jobs.
    """
    events = f"{target}/events"
    if months is None:
        landed = _typed(spark, source.read_bronze_csv(spark, bronze))
        sink.replace_partition(silver.dedup_events(silver.valid_events(landed)), events)
        loaded = source.read_layer(spark, events)
    else:
        landed, again, done = None, set(), []
        for year, month in months:
            typed, strays = _load_silver_month(spark, bronze, events, year, month)
            landed = typed if landed is None else landed.unionByName(typed)
            done.append((year, month))
            # strays of a month that is loaded later in this call join it then
            again |= {m for m in strays if m not in months[len(done):]}
        live = sink.loaded_months(spark, events)
        rerun = sorted(m for m in again if sink.month_part(*m) in live)
        for year, month in rerun:
            _load_silver_month(spark, bronze, events, year, month)
        sink.write_layer(spark.createDataFrame(rerun, "year int, month int"), f"{target}/rerun_months")
        layer = source.read_layer(spark, events)
        loaded = layer.filter(F.struct("year", "month").isin([F.struct(F.lit(y), F.lit(m)) for y, m in months]))
    stored = source.read_layer(spark, f"{target}/events")
    sink.write_layer(sessions.session_heavy_keys(stored), f"{target}/heavy_sessions")
    return _audited(spark, landed, loaded, f"{target}/audit")


def silver_to_gold(
    spark: SparkSession, silver_path: str, target: str, months: list[tuple[int, int]] | None = None
) -> None:
    """Write session features, pre-cart features and the funnel.

    With ``months`` each month is worked out from its own Silver partition and replaces
    its own Gold partitions; a layer is kept one way or the other.
    """
    heavy = source.read_layer(spark, f"{silver_path}/heavy_sessions")

    def write(events: DataFrame, place) -> None:
        place(sessions.session_features(events, heavy), f"{target}/session_features")
        place(sessions.ml_features(events, heavy), f"{target}/ml_features")
        place(sessions.funnel(events), f"{target}/funnel")

    if months is None:
        write(source.read_layer(spark, f"{silver_path}/events"), sink.write_layer)
    else:
        for year, month in months:
            events = source.read_layer(spark, f"{silver_path}/events").filter(
                (F.col("year") == year) & (F.col("month") == month)).drop("year", "month")
            write(events, lambda df, path, y=year, m=month: sink.load_month(df, path, y, m, time=None))
    gold = source.read_layer(spark, f"{target}/ml_features")
    sink.write_layer(heavy_keys(gold, ["user_id"]), f"{target}/heavy_users")


def export_ml_sample(spark: SparkSession, gold: str, target: str, n: int = 100_000) -> None:
    sample = splits.ml_sample(source.read_layer(spark, f"{gold}/session_features"), n)
    sink.write_layer(sample, target)


def prepare_training(
    spark: SparkSession, gold: str, target: str, version: str = "conversion_propensity_v3",
    columns: list[str] = schemas.FEATURES_V3, files: dict[str, int] | None = None,
) -> DataFrame:
    """Write the positional train, validation and test sets and the metadata report."""
    rows = splits.split_3way(features.ml_dataset(
        source.read_layer(spark, f"{gold}/ml_features"), columns,
        source.read_layer(spark, f"{gold}/heavy_users"),
    ))
    sink.write_layer(rows, f"{target}/dataset")
    stored = source.read_layer(spark, f"{target}/dataset")
    order = schemas.training_columns(columns)
    for name in ("train", "validation", "test"):
        sink.write_split_csv(
            splits.part(stored, name).select(*order), f"{target}/{name}", (files or {}).get(name)
        )
    metadata = split_metadata(stored, version, columns)
    sink.write_report_csv(metadata, f"{target}/metadata")
    return metadata


def split_metadata(
    split_rows: DataFrame, version: str = "conversion_propensity_v3",
    columns: list[str] = schemas.FEATURES_V3,
) -> DataFrame:
    """Version, feature counts, and rows per split and class."""
    def share(group: list[str]):
        return F.lit(len(set(columns) & set(group)))

    return (
        split_rows.groupBy("split", schemas.CONVERTED).agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(version).alias("version"), F.lit(len(columns)).alias("total_features"),
            share(schemas.BASE_FEATURES).alias("base_features"),
            share(schemas.DERIVED_FEATURES).alias("derived_features"),
            share(schemas.HISTORY_FEATURES).alias("history_features"),
            "split", schemas.CONVERTED, "rows",
        )
        .orderBy("split", schemas.CONVERTED)
    )


def train_conversion(
    spark: SparkSession, data: str, target: str, columns: list[str] = schemas.FEATURES_V3
) -> DataFrame:
    """Fit both candidates, keep the validation winner, report it on the test set."""
    order = schemas.training_columns(columns)
    train, validation, test = (
        source.read_positional_csv(spark, f"{data}/{name}", order)
        for name in ("train", "validation", "test")
    )
    train, validation = common.settled(train, "train"), common.settled(validation, "validation")
    winner, model, areas = conversion.choose_model(
        conversion.train_rf_v3(train, columns), conversion.train_gbt_v3(train, columns),
        validation,
    )
    common.save_model(model, f"{target}/best_model")
    report = conversion.training_report(winner, model, areas, test)
    sink.write_report_csv(report, f"{target}/metrics")
    return report


def tune_conversion(spark: SparkSession, data: str, models: str, target: str) -> DataFrame:
    """Sweep thresholds on validation, judge the best one on the test set."""
    model = common.load_model(f"{models}/best_model")
    order = schemas.training_columns(common.model_features(model))
    validation, test = (
        source.read_positional_csv(spark, f"{data}/{name}", order)
        for name in ("validation", "test")
    )
    sweep = conversion.tune_threshold(model, validation)
    sink.write_report_csv(sweep, f"{target}/validation_thresholds")
    final = conversion.final_threshold_eval(model, sweep, test)
    sink.write_report_csv(final, f"{target}/final_test")
    return final


def train_propensity(spark: SparkSession, gold: str, target: str) -> None:
    """First-generation forest: model, test metrics, scored test rows, importances, band counts."""
    rows = splits.split_stratified(
        features.coerce_numeric(
            source.read_layer(spark, f"{gold}/ml_features"), schemas.PROPENSITY_FEATURES,
            integers=(schemas.CONVERTED,),
        ),
        schemas.CONVERTED,
    )
    model = conversion.train_propensity_v1(splits.part(rows, "train"))
    common.save_model(model, f"{target}/model")
    test = splits.part(rows, "test")
    sink.write_report_csv(conversion.propensity_metrics(model, test), f"{target}/metrics")
    scored = conversion.score_conversion(model, test)
    sink.write_export_csv(
        scored.select("session_id", "user_id", *schemas.PROPENSITY_FEATURES,
                      schemas.CONVERTED, "conversion_score", "score_band"),
        f"{target}/scores",
    )
    sink.write_report_csv(score_band_distribution(scored), f"{target}/score_bands")
    sink.write_report_csv(
        common.feature_importance(model, schemas.PROPENSITY_FEATURES), f"{target}/importance"
    )


def segment_customers(spark: SparkSession, gold: str, target: str) -> None:
    """Fit the segments on all sessions and write every table that interprets them."""
    rows = features.coerce_numeric(
        source.read_layer(spark, f"{gold}/ml_features"), schemas.PROFILE_FEATURES
    ).select("session_id", "user_id", *schemas.PROFILE_FEATURES, "is_abandoned", "converted")
    model = profiles.fit_profiles(rows)
    common.save_model(model, f"{target}/model")
    sink.write_layer(profiles.assign_clusters(model, rows), f"{target}/clusters")
    clustered = source.read_layer(spark, f"{target}/clusters")
    centroids = profiles.centroids_original_scale(model, rows)
    reports = {
        "sizes": cluster_sizes(clustered),
        "summary": cluster_summary(clustered, schemas.PROFILE_FEATURES),
        "conversion": cluster_conversion(clustered),
        "centroids": centroids,
        "mapping": profiles.profile_mapping(centroids),
        "metrics": profiles.silhouette(model, rows),
    }
    for name, report in reports.items():
        sink.write_report_csv(report, f"{target}/{name}")


def publish_kpis(spark: SparkSession, gold: str, target: str) -> None:
    """Overview and funnel figures."""
    sink.write_report_csv(
        kpis.overview_kpis(source.read_layer(spark, f"{gold}/session_features")),
        f"{target}/overview",
    )
    sink.write_report_csv(
        kpis.funnel_rates(source.read_layer(spark, f"{gold}/funnel")), f"{target}/funnel_rates"
    )


def summarise_ticks(spark: SparkSession, raw: str, target: str) -> None:
    """Typed ticks and their summary per ticker, from raw JSON."""
    ticks = type_ticks(source.read_raw_json(spark, raw, schemas.RAW_PRICES))
    sink.write_layer(ticker_summary(ticks), f"{target}/summary")
    sink.write_layer(ticks, f"{target}/prices")
