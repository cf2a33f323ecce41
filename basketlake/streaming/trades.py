"""Price and order messages: decode, accept, store; bad messages go to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from basketlake import schemas
from basketlake.operators.trades import clean_orders, clean_prices
from basketlake.sinks import batches, versions
from basketlake.sinks.lake import append_curated, with_day, write_json_batch
from basketlake.sources.streams import accepted, decode_once, quarantined

TOPICS = {
    "prices": (schemas.RAW_PRICES, clean_prices),
    "orders": (schemas.RAW_ORDERS, clean_orders),
}


def store_batch(batch: DataFrame, batch_id: int, topic: str, target: str) -> None:
    """Write the three tables of one micro-batch, each keyed by the batch.

    No row is kept in memory: messages are decoded as they are read, once for the curated
    rows and once for the quarantine, and the JSON lake takes the curated rows as they are
    stored. A batch that runs again replaces its own folders (in the JSON lake: those of
    the same day of writing).
    """
    schema, rule = TOPICS[topic]
    decoded = decode_once(batch, schema)
    clean = rule(accepted(decoded))
    curated = f"{target}/curated/{topic}"
    append_curated(clean, batch_id, curated)
    stored = versions.read_parts(
        batch.sparkSession, curated, batches.own_folders(batch.sparkSession, curated, batch_id)).select(*clean.columns)
    write_json_batch(with_day(stored), batch_id, f"{target}/raw/{topic}", ["year", "month", "day"])
    write_json_batch(quarantined(decoded), batch_id, f"{target}/quarantine/{topic}")


def start_trade_stream(
    messages: DataFrame, topic: str, target: str, checkpoint: str, available_now: bool = False
) -> list[StreamingQuery]:
    """Start the one query of a topic: curated table, JSON lake and quarantine.

    All three stand at the same offset.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, topic, target)

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/{topic}")
    return [(writer.trigger(availableNow=True) if available_now else writer).start()]
