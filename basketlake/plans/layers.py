"""Layers that several queries share, each derived once per application and table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake import schemas
from basketlake.models import abandonment, conversion, profiles
from basketlake.operators import features, sessions, silver, splits
from basketlake.operators.decisions import profile_label_rule
from basketlake.operators.skew import heavy_keys
from basketlake.session import configure, scratch_path
from basketlake.sinks.lake import write_layer
from basketlake.sources.clicks import as_clicks

_LAKES: dict[tuple[str, str], "Lake"] = {}


class Lake:
    """Silver and Gold of one table folder, as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.base = scratch_path(spark, "lake")
        self._schemas: dict[str, T.StructType] = {}
        self._models: dict[str, object] = {}

    def layer(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.base}/{name}"
        if name not in self._schemas:
            rows = build()
            write_layer(rows, path)
            self._schemas[name] = rows.schema
        return self._read(name, path)

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is looked up once."""
        path = f"{self.sf_dir}/{name}.parquet"
        key = f"table {name}"
        if key not in self._schemas:
            self._schemas[key] = self.spark.read.parquet(path).schema
        return self._read(key, path)

    def _read(self, key: str, path: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[key]).parquet(path)

    def model(self, name: str, fit: Callable[[], object]):
        if name not in self._models:
            self._models[name] = fit()
        return self._models[name]

    # Layers ------------------------------------------------------------------

    def clicks(self) -> DataFrame:
        return as_clicks(self.table("events"))

    def silver(self) -> DataFrame:
        return self.layer("silver", lambda: silver.to_silver(self.clicks()))

    def heavy_sessions(self) -> DataFrame:
        return self.layer(
            "heavy_sessions", lambda: sessions.session_heavy_keys(self.silver())
        )

    def heavy_session_ids(self) -> DataFrame:
        return self.layer(
            "heavy_session_ids", lambda: heavy_keys(self.silver(), ["user_session"])
        )

    def session_features(self) -> DataFrame:
        return self.layer("session_features", lambda: sessions.session_features(
            self.silver(), self.heavy_sessions()))

    def ml_features(self) -> DataFrame:
        return self.layer("ml_features", lambda: sessions.ml_features(
            self.silver(), self.heavy_sessions()))

    def heavy_users(self) -> DataFrame:
        return self.layer("heavy_users", lambda: heavy_keys(self.ml_features(), ["user_id"]))

    def cart_features(self) -> DataFrame:
        return self.layer("cart_features", lambda: sessions.cart_features(self.silver()))

    def dataset(self) -> DataFrame:
        return self.layer("dataset", lambda: splits.split_3way(
            features.ml_dataset(self.ml_features(), heavy_users=self.heavy_users())))

    def labelled(self) -> DataFrame:
        """Gold sessions in the shape of the labelled table."""
        label = profile_label_rule(
            F.col("num_views_before_cart"), F.col("session_duration_sec"),
            F.col("is_night"), F.col("total_cart_value"),
        )
        rows = self.session_features().withColumn("user_profile", label)
        return rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LABELLED_SESSIONS]
        )

    def profile_rows(self) -> DataFrame:
        return features.coerce_numeric(self.ml_features(), schemas.PROFILE_FEATURES).select(
            "session_id", "user_id", *schemas.PROFILE_FEATURES, "is_abandoned", "converted"
        )

    # Models --------------------------------------------------------------------

    def part(self, name: str) -> DataFrame:
        return splits.part(self.dataset(), name)

    def rf_v3(self) -> PipelineModel:
        return self.model("rf_v3", lambda: conversion.train_rf_v3(self.part("train")))

    def gbt_v3(self) -> PipelineModel:
        return self.model("gbt_v3", lambda: conversion.train_gbt_v3(self.part("train")))

    def winner(self):
        return self.model("winner", lambda: conversion.choose_model(
            self.rf_v3(), self.gbt_v3(), self.part("validation")))

    def propensity_rows(self) -> DataFrame:
        return self.layer("propensity_rows", lambda: splits.split_stratified(
            features.coerce_numeric(self.ml_features(), schemas.PROPENSITY_FEATURES,
                                    integers=(schemas.CONVERTED,)),
            schemas.CONVERTED))

    def propensity(self) -> PipelineModel:
        return self.model("propensity", lambda: conversion.train_propensity_v1(
            splits.part(self.propensity_rows(), "train")))

    def abandonment(self):
        return self.model("abandonment", lambda: abandonment.compare_abandonment_models(
            self.cart_features()))

    def abandonment_7f(self):
        return self.model("abandonment_7f", lambda: abandonment.train_abandonment_7f(
            self.labelled()))

    def profile_classifier(self):
        return self.model("profile_classifier", lambda: abandonment.train_profile_classifier(
            self.labelled()))

    def segments(self) -> PipelineModel:
        return self.model("segments", lambda: profiles.fit_profiles(self.profile_rows()))

    def clustered(self) -> DataFrame:
        return self.layer("clustered", lambda: profiles.assign_clusters(
            self.segments(), self.profile_rows()))


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        _LAKES[key] = Lake(configure(spark), sf_dir)
    configure(spark)
    return _LAKES[key]
