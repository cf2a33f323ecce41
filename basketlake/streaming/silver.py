"""Click events to Silver, continuously."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlake import schemas
from basketlake.operators.silver import dedup_events, normalise_events, valid_events
from basketlake.session import ship_package
from basketlake.sinks import batches, versions
from basketlake.sources.streams import accepted, decode, quarantined
from basketlake.streaming import followups

LATENESS = "10 minutes"
FILE_ROWS = 500_000
ERRORS = T.StructType([T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())])


def event_stream_to_silver(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Type, check and deduplicate a stream of click events, for timers and follow-ups.

    Copies of an event that arrive within ``lateness`` of each other are dropped, and
    so are rows that come later than the watermark: what is stored as Silver goes
    through :func:`start_click_stream`, which keeps them.
    """
    checked = valid_events(normalise_events(events))
    return checked.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark()


def store_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """``foreachBatch`` writer: every valid row, however late, that Silver does not hold yet.

    Copies of an event have the same time, so a batch is held against the stored days it
    touches, within its own span of time, and nothing else. A batch that runs again
    replaces its own rows and is compared with the batches before it. Rows are gathered by
    day before they are written, so a batch adds few files whatever its shuffles; a day is
    cut for the cores there are and into files of about ``FILE_ROWS``.
    """
    spark = batch.sparkSession
    rows = dedup_events(valid_events(normalise_events(batch))).withColumn("day", F.date_format("event_time", "yyyy-MM-dd")).persist()
    days = {r["day"]: (r["low"], r["high"], r["n"]) for r in rows.groupBy("day").agg(
        F.min("event_time").alias("low"), F.max("event_time").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    stored = batches.batch_folders(spark, path, batch_id, lambda prefix: prefix.removeprefix("day=").rstrip("/") in days)
    fresh = rows
    if stored:
        low, high = min(v[0] for v in days.values()), max(v[1] for v in days.values())
        held = versions.read_parts(spark, path, stored).select(*schemas.EVENT_COLUMNS).filter(F.col("event_time").between(low, high))
        held = held.withColumnsRenamed({c: f"_{c}" for c in schemas.EVENT_COLUMNS})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in schemas.EVENT_COLUMNS]
        fresh = rows.join(held, reduce(Column.__and__, same), "left_anti")
    if days:
        cuts = max(-(-spark.sparkContext.defaultParallelism // len(days)), -(-max(v[2] for v in days.values()) // FILE_ROWS))
        cut = F.pmod(F.xxhash64("event_time", "user_id", "product_id"), F.lit(cuts))
        fresh = fresh.repartition(len(days) * cuts, "day", cut)
    batches.append_batch(fresh, batch_id, path, ("day",))
    rows.unpersist()


def store_messages(batch: DataFrame, batch_id: int, target: str) -> None:
    """``foreachBatch`` writer of raw messages: one decode, good rows to Silver, the rest to ``target/errors``.

    Both tables log the batch by its id, so a batch that runs again counts once in each.
    """
    decoded = decode(batch, schemas.EVENTS_RAW).persist()
    store_batch(accepted(decoded), batch_id, f"{target}/silver")
    batches.append_batch(quarantined(decoded), batch_id, f"{target}/errors")
    decoded.unpersist()


def stored_errors(spark: SparkSession, path: str) -> DataFrame:
    """(value, reason) of the click messages that could not be read."""
    return versions.read_parts(spark, path, batches.batch_folders(spark, path), ERRORS)


def stored_silver(spark: SparkSession, path: str) -> DataFrame:
    """Silver from the stored batches: each row is there once, so reading is a plain scan."""
    return versions.read_parts(
        spark, path, batches.batch_folders(spark, path), schemas.EVENTS_SILVER).select(*schemas.EVENTS_SILVER.names)


def start_click_stream(
    events: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS,
    risk_model=None, profile_model=None, trigger: dict | None = None,
) -> list:
    """Start the click-stream job: all valid rows to Silver, due follow-ups to two tables.

    ``target/silver`` takes every valid row; one stateful query feeds
    ``target/reminders``, ``target/offers`` and the ``target/ledger`` of handled carts,
    each with a log of batches, so that a batch that runs again counts once.
    ``trigger`` goes to ``DataStreamWriter.trigger``.
    """
    def to_silver(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, f"{target}/silver")

    return _start(events, to_silver, events, target, checkpoint, lateness, risk_model, profile_model, trigger)


def start_click_messages(
    messages: DataFrame, target: str, checkpoint: str, lateness: str = LATENESS,
    risk_model=None, profile_model=None, trigger: dict | None = None,
) -> list:
    """:func:`start_click_stream` for raw messages (``value``); those that are no click event go to ``target/errors``.

    Silver and the error table come from one query and stand at the same offset.
    """
    def to_silver(batch: DataFrame, batch_id: int) -> None:
        store_messages(batch, batch_id, target)

    events = accepted(decode(messages, schemas.EVENTS_RAW))
    return _start(messages, to_silver, events, target, checkpoint, lateness, risk_model, profile_model, trigger)


def _start(
    stored: DataFrame, to_silver: Callable[[DataFrame, int], None], events: DataFrame, target: str, checkpoint: str,
    lateness: str, risk_model, profile_model, trigger: dict | None,
) -> list:
    ship_package(events.sparkSession)
    trigger = trigger or {"processingTime": "1 minute"}
    return [
        stored.writeStream.foreachBatch(to_silver).trigger(**trigger)
        .option("checkpointLocation", f"{checkpoint}/silver").start(),
        followups.start_followups(
            event_stream_to_silver(events, lateness), target, f"{checkpoint}/followups", trigger, risk_model, profile_model),
    ]
