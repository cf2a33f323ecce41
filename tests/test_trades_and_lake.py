import hashlib
import os
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.operators import kpis, trades
from basketlake.operators import silver as silver_ops
from basketlake.plans import jobs
from basketlake.sinks import lake as sink
from basketlake.sinks import batches, versions
from basketlake.sources import lake as source
from basketlake.sources import streams
from basketlake.sources.clicks import as_landed
from basketlake.streaming.run import drain
from basketlake.streaming.silver import (
    event_stream_to_silver, store_batch, store_messages, stored_errors, stored_silver,
)
from basketlake.streaming.trades import start_trade_stream
from conftest import rows_of


def test_prices(spark):
    frame = spark.createDataFrame(
        [("A", 0.0, 1, "t"), ("A", -1.0, 1, "t"), ("A", 29.99, 1, "t"), ("B", 30.0, 2, "t")],
        schemas.RAW_PRICES)
    assert rows_of(trades.clean_prices(frame), "price", "price_band") == [
        (29.99, "LOW"), (30.0, "HIGH")]


def test_orders(spark):
    frame = spark.createDataFrame(
        [("o1", "client", "A", "BUY", 3, 10.5, 1.0, "t"), ("o2", "client", "A", "BUY", 0, 1.0, 0.0, "t")],
        schemas.RAW_ORDERS)
    got = trades.clean_orders(frame).collect()
    assert len(got) == 1 and got[0]["total_value"] == 31.5
    assert got[0]["client_id_masked"] == hashlib.sha256(b"client").hexdigest()
    assert "client_id" not in got[0].asDict()


def test_ticks(spark):
    frame = spark.createDataFrame(
        [("A", "1.0", "2", "2024-01-01 00:00:00"), ("A", "3.0", "5", "bad")],
        "ticker string, price string, volume string, event_time string")
    typed = trades.type_ticks(frame)
    assert typed.filter("event_time IS NULL").count() == 1
    assert tuple(trades.ticker_summary(typed).first()) == ("A", 2.0, 7)


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "layer")

    def load(rows):
        return spark.createDataFrame(rows, "event_time timestamp, v int")

    january, march = datetime(2024, 1, 5), datetime(2024, 3, 5)
    sink.replace_partition(load([(january, 1), (march, 2)]), path)
    sink.replace_partition(load([(march, 3), (march, 4)]), path, rebalance=True)
    assert rows_of(source.read_layer(spark, path), "month", "v") == [(1, 1), (3, 3), (3, 4)]


def test_a_load_that_dies_leaves_the_old_month(spark, tmp_path, monkeypatch):
    """Killed while data is written, or while the manifest is: readers see the old rows, a rerun the new ones."""
    path = str(tmp_path / "layer")
    day = datetime(2024, 3, 5)

    def load(*values):
        return spark.createDataFrame([(day, v) for v in values], "event_time timestamp, v int")

    def seen():
        return [r[0] for r in rows_of(source.read_layer(spark, path), "v")]
    sink.load_month(load(1, 2), path, 2024, 3)
    failing = load(3, 4).withColumn("v", F.when(F.col("v") == 4, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sink.load_month(failing, path, 2024, 3)
    assert seen() == [1, 2]
    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sink.load_month(load(5), path, 2024, 3)
    assert seen() == [1, 2]
    os.makedirs(f"{path}/_manifest/{2:012d}")  # a manifest without its marker
    assert seen() == [1, 2]
    sink.load_month(load(6), path, 2024, 3)
    assert seen() == [6]
    gone = versions.vacuum(spark, path)
    assert sum("/version=" in g for g in gone) == 3 and sum("/_manifest/" in g for g in gone) == 2 and seen() == [6]


def test_strays_name_their_months(spark, tmp_path):
    path = str(tmp_path / "layer")
    rows = [(datetime(2024, 3, 5), 1), (datetime(2024, 2, 5), 2), (datetime(2023, 12, 5), 3), (None, 4)]
    frame = spark.createDataFrame(rows, "event_time timestamp, v int")
    assert sink.load_month(frame, path, 2024, 3) == [(2023, 12), (2024, 2)]
    assert rows_of(source.read_layer(spark, path), "year", "month", "v") == [(2024, 3, 1)]
    assert rows_of(sink.set_aside(spark, path, frame, 2024, 2), "v") == [(2,)]
    assert sink.set_aside(spark, path, frame, 2024, 3).count() == 0
    assert sink.load_month(frame.limit(0), path, 2024, 3) == [] and sink.aside(spark, path, frame).count() == 0
    sink.load_month(frame.filter("v = 2"), path, 2024, 2)
    assert rows_of(source.read_layer(spark, path), "year", "month", "v") == [(2024, 2, 2)]
    assert "PartitionFilters: [isnotnull(month" in source.read_layer(spark, path).filter("month = 2")._jdf.queryExecution().toString()


def test_report_and_positional_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.5), (0, 0.25)], "converted int, a double")
    sink.write_report_csv(frame, str(tmp_path / "report"))
    assert len([f for f in os.listdir(tmp_path / "report") if f.endswith(".csv")]) == 1
    sink.write_split_csv(frame, str(tmp_path / "set"), files=2)
    back = source.read_positional_csv(spark, str(tmp_path / "set"), ["converted", "a"])
    assert dict(back.dtypes) == {"converted": "double", "a": "double"}
    assert rows_of(back) == [(0.0, 0.25), (1.0, 0.5)]


def test_missing_input_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        sink.land_bronze(spark, str(tmp_path / "none.csv"), str(tmp_path / "b"), 2019, 11)


def test_medallion_jobs(spark, lk, tmp_path):
    base = str(tmp_path)
    as_landed(lk.clicks()).write.option("header", True).csv(f"{base}/upload")
    sink.land_bronze(spark, f"{base}/upload", f"{base}/bronze", 2024, 1)
    audit = jobs.bronze_to_silver(spark, f"{base}/bronze", f"{base}/silver")
    assert rows_of(audit) == [(1020, 600, 420)]
    jobs.silver_to_gold(spark, f"{base}/silver", f"{base}/gold")
    assert rows_of(source.read_layer(spark, f"{base}/gold/ml_features"), *lk.ml_features().columns) \
        == rows_of(lk.ml_features())
    metadata = jobs.prepare_training(
        spark, f"{base}/gold", f"{base}/ml", files={"train": 2, "validation": 1, "test": 1})
    assert metadata.agg(F.sum("rows")).first()[0] == 163
    columns = schemas.training_columns(schemas.FEATURES_V3)
    sets = [source.read_positional_csv(spark, f"{base}/ml/{name}", columns).count()
            for name in ("train", "validation", "test")]
    assert sum(sets) == 163 and min(sets) > 0
    jobs.export_ml_sample(spark, f"{base}/gold", f"{base}/sample", 20)
    assert source.read_layer(spark, f"{base}/sample").count() == 20
    jobs.publish_kpis(spark, f"{base}/gold", f"{base}/kpis")
    kpis.register_gold(spark, {"gold_sessions": f"{base}/gold/session_features"})
    assert kpis.run_sql(spark, "SELECT count(*) FROM gold_sessions").first()[0] == 165
    kpis.register_gold(spark, {"gold_funnel": f"{base}/gold/funnel"}, tables=True)
    assert kpis.run_sql(spark, "SELECT sum(count) FROM gold_funnel").first()[0] == 600
    spark.sql("DROP TABLE gold_funnel")
    stream = event_stream_to_silver(
        streams.read_event_stream(spark, "csv", f"{base}/upload", header="true"))
    assert drain(stream, "from-csv").count() == 600


def test_event_messages(spark, lk, tmp_path):
    base = str(tmp_path)
    landed = as_landed(lk.clicks())
    landed.select(F.to_json(F.struct(*landed.columns))).write.text(f"{base}/in")
    stream = event_stream_to_silver(streams.read_event_stream(spark, "text", f"{base}/in"))
    got = drain(stream, "from-messages")
    assert rows_of(got, *schemas.EVENT_COLUMNS) == rows_of(lk.silver(), *schemas.EVENT_COLUMNS)


def test_trade_stream_and_quarantine(spark, tmp_path):
    base = str(tmp_path)
    os.makedirs(f"{base}/in")
    with open(f"{base}/in/m.txt", "w") as out:
        out.write('{"ticker":"A","price":10.0,"volume":1,"event_time":"t"}\n')
        out.write('{"ticker":"B","price":0,"volume":1,"event_time":"t"}\n')
        out.write('not json\n{"ticker":"C","price":"abc"\n')
    def run():
        messages = streams.read_message_stream(spark, "text", f"{base}/in")
        for query in start_trade_stream(
            messages, "prices", f"{base}/out", f"{base}/progress", available_now=True
        ):
            query.awaitTermination()
    run()
    run()  # nothing new: nothing is written twice
    assert rows_of(source.read_layer(spark, f"{base}/out/curated/prices"), "ticker", "price_band") == [
        ("A", "LOW")]
    assert source.read_raw_json(spark, f"{base}/out/raw/prices", schemas.RAW_PRICES).count() == 1
    assert spark.read.json(f"{base}/out/quarantine/prices").count() == 2


def test_json_lake_and_batches_are_stored_compressed(spark, tmp_path):
    def stored(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))

    rows = spark.range(20_000, numPartitions=1).select(F.concat(F.lit("some order text "), F.col("id")).alias("value"))
    sink.write_json_batch(rows, 0, str(tmp_path / "lake"))
    plain = 20_000 * len('{"value":"some order text 12345"}')
    assert stored(tmp_path / "lake") < plain / 3
    back = source.read_raw_json(spark, str(tmp_path / "lake"), rows.schema, recursive=True)
    assert rows_of(back) == rows_of(rows)


def test_curated_batch_runs_again_without_doubles(spark, tmp_path):
    path = str(tmp_path / "curated")
    frame = spark.createDataFrame([(1,), (2,)], "v int")
    sink.append_curated(frame, 0, path)
    sink.append_curated(frame, 1, path)
    sink.append_curated(frame, 1, path)
    assert source.read_layer(spark, path).count() == 4


def test_files_of_many_batches_stay_few(spark, tmp_path):
    """27 batches, each run twice, merged three by three: every row once, few live parts and files."""
    path = str(tmp_path / "curated")
    for batch_id in range(27):
        for value in (-1, batch_id):  # the first run is lost and replaced
            batches.append_batch(spark.createDataFrame([(value,)], "v int").coalesce(1), batch_id, path, fanout=3)
    assert [r[0] for r in rows_of(source.read_layer(spark, path))] == sorted(range(27), key=lambda v: repr((v,)))
    parts = versions.live_parts(spark, path)
    assert len(parts) <= 3 * 3 and {p.split("/")[0] for p in parts} >= {"level=0", "level=2"}
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 25
    assert sorted(batches.batch_folders(spark, path, 0)) == []


def test_stored_silver_of_a_stream_is_merged_as_it_comes(spark, lk, tmp_path, capsys):
    """Late copies, copies across days and repeated batches; reading plans no exchange."""
    path = str(tmp_path / "silver")
    landed = as_landed(lk.clicks()).withColumn("part", F.pmod(F.xxhash64("event_time"), F.lit(4))).persist()
    shifted = landed.withColumn("event_time", F.concat(F.lit("2031"), F.substring("event_time", 5, 100)))
    both = landed.unionByName(shifted)
    for batch_id in range(4):
        rows = both.filter((F.col("part") == batch_id) | (F.col("part") == (batch_id + 2) % 4)).drop("part")
        store_batch(rows, batch_id, path)
    store_batch(both.filter("part in (1, 3)").drop("part"), 3, path)
    got = stored_silver(spark, path)
    got.explain()
    assert "Exchange" not in capsys.readouterr().out
    want = silver_ops.dedup_events(silver_ops.valid_events(silver_ops.normalise_events(both.drop("part"))))
    assert rows_of(got, *schemas.EVENT_COLUMNS) == rows_of(want, *schemas.EVENT_COLUMNS)


def test_click_messages_that_cannot_be_read_are_kept_once(spark, lk, tmp_path):
    """Text that is no JSON, cut short or empty goes to the error table; a batch that runs again counts once."""
    good = as_landed(lk.clicks()).limit(50)
    messages = good.select(F.to_json(F.struct(*schemas.EVENTS_RAW.names)).alias("value")).persist()
    spoilt = spark.createDataFrame([("{\"event_time\": \"20",), ("plain text",), ("[1, 2",)], "value string")
    target = str(tmp_path / "out")
    for batch_id, batch in ((0, messages.unionByName(spoilt)), (1, spoilt.limit(1)), (1, spoilt.limit(1))):
        store_messages(batch, batch_id, target)
    errors = stored_errors(spark, f"{target}/errors").groupBy("value").count().collect()
    assert sorted(r["count"] for r in errors) == [1, 1, 2]
    want = silver_ops.dedup_events(silver_ops.valid_events(silver_ops.normalise_events(good)))
    got = stored_silver(spark, f"{target}/silver")
    assert rows_of(got, *schemas.EVENT_COLUMNS) == rows_of(want, *schemas.EVENT_COLUMNS)


def test_a_trade_batch_is_stored_without_a_cache(spark, tmp_path, monkeypatch):
    """No row stays in executor memory; a batch that runs again leaves its rows once; one parse a pass."""
    from basketlake.streaming import trades as live

    def order(number, quantity):
        return (f'{{"order_id":"o{number}","client_id":"c","ticker":"A","order_type":"BUY","quantity":{quantity},'
                f'"price":2.5,"total_value":1.0,"event_time":"t"}}',)

    lines = [order(n, n % 3) for n in range(30)] + [order(99, '"many"'), ("no message",), (None,)]
    messages = spark.createDataFrame(lines, "value string")
    decoded = streams.decode_once(messages, schemas.RAW_ORDERS)
    for rows in (trades.clean_orders(streams.accepted(decoded)), streams.quarantined(decoded)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1

    def kept(*args):
        raise AssertionError("a batch is not kept in memory")
    monkeypatch.setattr(type(messages), "persist", kept)
    target = str(tmp_path)
    for batch_id, batch in ((0, messages), (1, messages.limit(3)), (1, messages)):
        live.store_batch(batch, batch_id, "orders", target)
    curated = source.read_layer(spark, f"{target}/curated/orders").drop("batch_id")
    want = trades.clean_orders(streams.accepted(streams.decode(messages, schemas.RAW_ORDERS)))
    assert rows_of(curated, *want.columns) == sorted(rows_of(want) * 2, key=repr)
    lake = source.read_raw_json(spark, f"{target}/raw/orders", want.schema)
    assert rows_of(lake, *want.columns) == rows_of(curated, *want.columns)
    bad = spark.read.json(f"{target}/quarantine/orders")
    assert bad.count() == 6 and bad.filter("value is null").count() == 2
