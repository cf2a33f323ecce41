"""Behavioural segments: scaling, k-means with restarts, interpretation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.functions import rules
from basketlake.models.common import SEED, spread

CLUSTERS = 3


def fit_profiles(
    df: DataFrame, features: list[str] = schemas.PROFILE_FEATURES, restarts: int = 20,
    seed: int = SEED, parallel: int = 4,
) -> PipelineModel:
    """Standardise, run k-means from ``restarts`` seeds, keep the lowest training cost.

    The restarts share one stored scaled input and run a few at a time.
    """
    vectors = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    raw = vectors.transform(df)
    scaling = scaler.fit(raw.select("raw"))
    scaled = spread(scaling.transform(raw).select("features"))

    def attempt(number: int):
        fitted = KMeans(k=CLUSTERS, maxIter=300, seed=seed + number).fit(scaled)
        return fitted.summary.trainingCost, number, fitted

    run = inheritable_thread_target(df.sparkSession)(attempt)
    with ThreadPool(min(parallel, restarts)) as pool:
        tries = pool.map(run, range(restarts))
    best = min(tries, key=lambda t: t[:2])[2]
    return PipelineModel(stages=[vectors, scaling, best])


def assign_clusters(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row with its ``cluster``."""
    return model.transform(df).withColumn("cluster", F.col("prediction")).drop(
        "raw", "features", "prediction"
    )


def silhouette(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Mean silhouette (squared Euclidean) over all rows."""
    value = ClusteringEvaluator().evaluate(model.transform(df))
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette_score double")


def centroids_original_scale(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row per cluster with the centre in the units of the features."""
    vectors, scaling, clusters = model.stages
    mean, deviation = scaling.mean.toArray(), scaling.std.toArray()
    rows = [
        (number, *(float(v) for v in centre * deviation + mean))
        for number, centre in enumerate(clusters.clusterCenters())
    ]
    names = vectors.getInputCols()
    schema = ", ".join(["cluster int", *(f"{name} double" for name in names)])
    return df.sparkSession.createDataFrame(rows, schema)


def profile_mapping(centroids: DataFrame) -> DataFrame:
    """Names for the clusters of a fit (cluster, profile).

    Most views before the cart: undecided; fewest: high intent; the rest:
    discount hunter.  Cluster numbers differ between fits, so names follow the
    centres.
    """
    views = F.round("num_views_before_cart", 6)  # centres carry rounding noise
    edges = centroids.agg(
        F.max_by("cluster", F.struct(views, "cluster")).alias("_most"),
        F.min_by("cluster", F.struct(views, "cluster")).alias("_least"),
    )
    return (
        centroids.select("cluster")
        .join(edges.select(F.col("_most").alias("cluster"),
                           F.lit(rules.UNDECIDED).alias("_u")), "cluster", "left")
        .join(edges.select(F.col("_least").alias("cluster"),
                           F.lit(rules.HIGH_INTENT).alias("_h")), "cluster", "left")
        .select("cluster", F.coalesce("_u", "_h", F.lit(rules.DISCOUNT_HUNTER)).alias("profile"))
    )
