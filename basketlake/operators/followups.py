"""Batch form of the two follow-ups: carts without a purchase after a delay.

Deadline = first cart + delay.  A purchase from the first cart up to and
including the deadline suppresses the follow-up; one before the first cart does
not.  A follow-up is due once the clock ``as_of`` has reached the deadline.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.functions import rules
from basketlake.functions.columns import count_if, sum_if, whole_seconds
from basketlake.operators.sessions import (
    before_cart, cart_timeline, is_cart, is_purchase, is_view,
)
from basketlake.schemas import SESSION_KEYS

REMINDER_DELAY = timedelta(minutes=5)
OFFER_DELAY = timedelta(hours=1)


def _due(as_of: Column | None) -> Column:
    return F.lit(True) if as_of is None else F.col("deadline") <= as_of


def unconverted_carts(
    events: DataFrame,
    delay: timedelta,
    as_of: Column | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Sessions whose first cart saw no purchase within ``delay``.

    The earliest purchase since the first cart decides, so carts and purchases of
    a session are never paired with each other.
    """
    timeline = cart_timeline(events.filter(is_cart() | is_purchase()), heavy)
    bought = is_purchase() & (F.col("event_time") >= F.col("first_cart_time"))
    return (
        timeline.groupBy(*SESSION_KEYS)
        .agg(
            F.min("first_cart_time").alias("first_cart_time"),
            F.min(F.when(bought, F.col("event_time"))).alias("_bought"),
        )
        .withColumn("deadline", F.col("first_cart_time") + F.lit(delay))
        .filter((F.col("_bought").isNull() | (F.col("_bought") > F.col("deadline"))) & _due(as_of))
        .drop("_bought")
    )


def cart_reminders(
    events: DataFrame, as_of: Column | None = None, heavy: DataFrame | None = None
) -> DataFrame:
    """Reminder rows for carts without a purchase after five minutes."""
    return with_reminder_text(unconverted_carts(events, REMINDER_DELAY, as_of, heavy))


def with_reminder_text(due: DataFrame) -> DataFrame:
    return due.withColumns({name: F.lit(text) for name, text in rules.REMINDER.items()})


def offer_sessions(
    events: DataFrame, as_of: Column | None = None, heavy: DataFrame | None = None
) -> DataFrame:
    """Session figures, as known at the deadline, of carts unpaid after one hour."""
    deadline = F.col("first_cart_time") + F.lit(OFFER_DELAY)
    known = cart_timeline(events, heavy).filter(F.col("event_time") <= deadline)
    bought = is_purchase() & (F.col("event_time") >= F.col("first_cart_time"))
    return (
        known.groupBy(*SESSION_KEYS)
        .agg(
            F.min("first_cart_time").alias("first_cart_time"),
            count_if(bought).alias("_bought"),
            sum_if(is_cart(), F.col("price")).alias("total_cart_value"),
            count_if(is_cart()).alias("num_cart_items"),
            count_if(is_view() & before_cart()).alias("num_views_before_cart"),
            F.min("event_time").alias("_first"),
            F.max("event_time").alias("_last"),
        )
        .withColumn("deadline", deadline)
        .filter((F.col("_bought") == 0) & _due(as_of))
        .withColumns({
            "session_duration_sec": whole_seconds(F.col("_last"), F.col("_first")),
            "hour_of_day": F.hour("first_cart_time"),
        })
        .drop("_bought", "_first", "_last")
    )
