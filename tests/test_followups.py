from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlake import schemas
from basketlake.operators import followups as batch
from basketlake.streaming import followups as live
from basketlake.streaming.silver import event_stream_to_silver
from conftest import rows_of
from test_sessions import event

T0 = datetime(2024, 1, 1, 10, 0)


def at(n):
    return T0 + timedelta(minutes=n)


TRIAL = [
    event("s1", 1, at(0), "view"), event("s1", 1, at(1), "cart"), event("s1", 1, at(3), "purchase"),
    event("s2", 2, at(0), "cart"),
    event("s3", 3, at(0), "cart"), event("s3", 3, at(30), "purchase"),
    event("s4", 4, at(0), "purchase"), event("s4", 4, at(1), "cart"),       # bought before the cart
    event("s5", 5, at(0), "cart"), event("s5", 5, at(5), "purchase"),       # exactly on the deadline
    event("s6", 6, at(0), "view"), event("s6", 6, at(1), "cart", 20.0),
    event("s6", 6, at(2), "view"), event("s6", 6, at(20), "cart", 30.0),
    event("s6", 6, at(61), "cart", 7.0), event("s6", 6, at(62), "cart", 500.0),
    event(None, 7, at(0), "cart"),
    event("zz", 9, at(240), "view"),                                         # moves the watermark
]
REMIND = [("s2",), ("s3",), ("s4",), ("s6",)]
OFFER = [("s2",), ("s4",), ("s6",)]


def test_batch(spark):
    frame = spark.createDataFrame(TRIAL, schemas.EVENTS_SILVER)
    assert rows_of(batch.cart_reminders(frame), "user_session") == REMIND
    due = batch.offer_sessions(frame)
    assert rows_of(due, "user_session") == OFFER
    s6 = due.filter("user_session = 's6'").first()
    assert (s6["total_cart_value"], s6["num_cart_items"], s6["num_views_before_cart"]) == (57.0, 3, 1)
    assert (s6["session_duration_sec"], s6["hour_of_day"]) == (3660, 10)
    early = batch.cart_reminders(frame, F.lit(at(5)))
    assert rows_of(early, "user_session") == [("s2",), ("s3",)]


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """The same rows in three files, so that state crosses micro-batches."""
    base = str(tmp_path_factory.mktemp("stream"))
    order = [TRIAL[i] for i in (1, 2, 3, 7, 8, 13, 9, 14, 0, 4, 11, 12)]
    later = [e for e in TRIAL if e not in order and e[8] != "zz"]
    for number, rows in enumerate((order, later, [TRIAL[-1]])):
        path = f"{base}/{number}"
        spark.createDataFrame(rows + rows[:2], schemas.EVENTS_SILVER).coalesce(1).write.parquet(path)
    target = f"{base}/out"
    stream = (
        spark.readStream.schema(schemas.EVENTS_SILVER).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(base + "/[0-9]")
    )
    due = live.due_followups(event_stream_to_silver(stream, "3 hours"))
    query = (
        due.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(live.OUTPUT).parquet(target)


def test_stream_fires_like_batch(spark, streamed):
    frame = spark.createDataFrame(TRIAL, schemas.EVENTS_SILVER)
    as_of = F.lit(at(240) - timedelta(hours=3))
    assert rows_of(live.reminders_of(streamed), "user_session") == rows_of(
        batch.cart_reminders(frame, as_of), "user_session")
    offers = live.offers_of(streamed)
    columns = ["user_session", "user_id", "total_cart_value", "num_cart_items",
               "num_views_before_cart", "session_duration_sec"]
    assert rows_of(offers, *columns) == rows_of(batch.offer_sessions(frame, as_of), *columns)


def test_fold_does_not_depend_on_arrival_order():
    processor = live.CartFollowUps()
    base = dict.fromkeys(live._RECORD.names) | {"items": 0, "views": 0, "value": 0.0, "cart": 100}
    events = [(90, "view", 1.0), (100, "cart", 5.0), (110, "view", 1.0), (120, "purchase", 1.0),
              (95, "purchase", 1.0), (100 + live.DELAYS["offer"] + 1, "cart", 9.0)]
    results = []
    for order in (events, events[::-1]):
        record = dict(base)
        for instant, sums in live.sums_by_instant(order).items():
            processor._fold(record, instant, sums)
        results.append(record)
    assert results[0] == results[1]
    assert (results[0]["views"], results[0]["items"], results[0]["bought"]) == (1, 1, 120)


PROBES = {
    # a cart 23.5 hours after the session's first view
    "late_cart": [event("p1", 1, at(0), "view"), event("p1", 1, at(1410), "cart", 9.0), event("zz", 9, at(1800), "view")],
    # a further cart 30 hours after the first: no second reminder, no second offer
    "second_cart": [event("p2", 2, at(0), "cart", 5.0), event("zz", 9, at(1740), "view"),
                    event("p2", 2, at(1800), "cart", 7.0), event("zz", 9, at(2400), "view")],
    # the session leaves the state twice before its cart; its views still count
    "idle": [event("p3", 3, at(0), "view"), event("p3", 3, at(1), "view"), event("zz", 9, at(400), "view"),
             event("p3", 3, at(500), "view"), event("zz", 9, at(900), "view"), event("p3", 3, at(1000), "view"),
             event("p3", 3, at(1001), "cart", 4.0), event("zz", 9, at(1500), "view")],
    # bought in time, so nothing was sent; the cart a day later still is not the first
    "bought_first": [event("p4", 4, at(0), "cart", 5.0), event("p4", 4, at(2), "purchase"), event("zz", 9, at(900), "view"),
                     event("p4", 4, at(1440), "cart", 7.0), event("p5", 5, at(1440), "cart", 1.0), event("zz", 9, at(2400), "view")],
}


@pytest.mark.parametrize("name, per_file", [("late_cart", 1), ("second_cart", 1), ("second_cart", 4), ("idle", 1), ("bought_first", 1)])
def test_no_message_is_lost_or_repeated(spark, tmp_path, name, per_file):
    """The same rows as the batch form, however the stream is cut into micro-batches."""
    rows = PROBES[name]
    for number in range(0, len(rows), per_file):
        spark.createDataFrame(rows[number: number + per_file], schemas.EVENTS_SILVER).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    # one more file moves the clock on after the last cart
    spark.createDataFrame([event("zz", 9, at(3000), "view")], schemas.EVENTS_SILVER).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = (
        spark.readStream.schema(schemas.EVENTS_SILVER).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    )
    from basketlake.streaming.silver import start_click_stream, stored_silver

    raw = stream.select(*[stream[c].cast("string").alias(c) for c in stream.columns])
    for running in start_click_stream(raw, f"{tmp_path}/out", f"{tmp_path}/progress", trigger={"availableNow": True}):
        running.awaitTermination()
    frame = stored_silver(spark, f"{tmp_path}/out/silver")
    as_of = F.lit(at(3000) - timedelta(minutes=10))
    keys = ["user_session", "first_cart_time", "deadline"]
    assert frame.count() == len(rows) + 1
    assert rows_of(live.read_messages(spark, f"{tmp_path}/out", "reminder"), *keys) == rows_of(batch.cart_reminders(frame, as_of), *keys)
    figures = [*keys, "total_cart_value", "num_cart_items", "num_views_before_cart", "session_duration_sec"]
    offers = live.read_messages(spark, f"{tmp_path}/out", "offer")
    assert rows_of(offers, *figures) == rows_of(batch.offer_sessions(frame, as_of), *figures)
    assert offers.count() == 1


def _run(spark, folder, files, lateness="10 minutes", **options):
    """Files of events, one a micro-batch, through the follow-up query; gives the finished query."""
    for number, rows in enumerate(files):
        spark.createDataFrame(rows, schemas.EVENTS_SILVER).coalesce(1).write.parquet(f"{folder}/in/{number}")
    stream = (
        spark.readStream.schema(schemas.EVENTS_SILVER).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(f"{folder}/in")
    )
    running = live.start_followups(
        stream.withWatermark("event_time", lateness), f"{folder}/out", f"{folder}/progress", {"availableNow": True}, **options)
    running.awaitTermination()
    return running


def _held(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/progress")


def test_state_ends_with_the_last_deadline(spark, tmp_path):
    """200 carts and 200 sessions that only looked are gone from the state a few hours later."""
    many = [event(f"c{i}", i, at(i % 7), "cart", 1.0) for i in range(200)] + [event(f"v{i}", i, at(i % 7), "view") for i in range(200)]
    _run(spark, tmp_path, [many, [event("zz", 9, at(400), "view")], [event("yy", 9, at(800), "view")]])
    left = {r["key"]["user_session"] for r in _held(spark, tmp_path, "record").collect()}
    assert left <= {"zz", "yy"}
    assert live.read_messages(spark, f"{tmp_path}/out", "offer").count() == 200
    ledger = live.read_ledger(spark, f"{tmp_path}/out/ledger")
    assert ledger.filter("first_cart_us is null").count() >= 200
    assert ledger.filter("first_cart_us is not null").select("user_session").distinct().count() == 200


def test_a_session_of_very_many_clicks_holds_few_sums(spark, tmp_path):
    """100,000 clicks of one session within ten minutes: one entry a second, figures exact."""
    second = timedelta(seconds=1)
    clicks = [event("bot", 1, at(0) + (i * 7919 % 600) * second, ("view", "view", "view", "cart")[i % 4], 1.0) for i in range(100_000)]
    first = min(e[0] for e in clicks if e[1] == "cart")
    _run(spark, tmp_path / "a", [clicks[:50_000], clicks[50_000:]])
    assert _held(spark, tmp_path / "a", "pending").count() <= 600
    _run(spark, tmp_path / "b", [clicks[:50_000], clicks[50_000:], [event("zz", 9, at(90), "view")], [event("zz", 9, at(91), "view")]])
    assert _held(spark, tmp_path / "b", "pending").filter("key.user_session = 'bot'").count() == 0
    offer = live.read_messages(spark, f"{tmp_path}/b/out", "offer").first()
    assert offer["first_cart_time"] == first and offer["num_cart_items"] == 25_000
    assert offer["num_views_before_cart"] == sum(e[1] == "view" and e[0] < first for e in clicks)


def test_a_batch_that_runs_again_decides_alike(spark, tmp_path):
    """The ledger of the batch itself does not count when the batch is repeated."""
    def due(session, cart, kind="offer"):
        us = int(cart * live.MINUTE)
        return (session, 1, kind, False, us, us + live.DELAYS[kind], 5.0, 1, 2, us - 10, us + 10)
    batch_rows = spark.createDataFrame([due("a", 0), due("a", 1800), due("b", 3)], live.OUTPUT)
    for _ in range(2):
        live.handle_due(batch_rows, 7, str(tmp_path))
    sent = live.read_messages(spark, str(tmp_path), "offer")
    assert rows_of(sent, "user_session") == [("a",), ("b",)]
    live.handle_due(spark.createDataFrame([due("b", 900), due("c", 900)], live.OUTPUT), 8, str(tmp_path))
    assert rows_of(live.read_messages(spark, str(tmp_path), "offer"), "user_session") == [("a",), ("b",), ("c",)]


class _Store:
    """A session's state and timers, with a count of the calls that would go to the state store."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def __getattr__(self, name):
        actions = {
            "exists": lambda: self.value is not None, "get": lambda: self.value,
            "update": lambda value: setattr(self, "value", value),
            "clear": lambda: (setattr(self, "value", None), self.map.clear()),
            "iterator": lambda: iter(list(self.map.items())), "keys": lambda: iter(list(self.map)),
            "containsKey": lambda key: key in self.map, "getValue": lambda key: self.map[key],
            "updateValue": lambda key, value: self.map.__setitem__(key, value), "removeKey": lambda key: self.map.pop(key),
            "registerTimer": lambda ms: self.timers.append(ms), "deleteTimer": lambda ms: self.timers.remove(ms),
        }
        if name not in actions:
            raise AttributeError(name)

        def call(*args):
            self.calls += 1
            return actions[name](*args)
        return call


class _Clock:
    def __init__(self, watermark, expiry=0):
        self.watermark, self.expiry = watermark, expiry

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.expiry


@pytest.mark.parametrize("instants, most", [(300, 3), (live.HELD_MOST + 200, 400)])
def test_a_session_costs_few_state_calls(instants, most):
    """A cart after many views: a read, a write and a timer; then both follow-ups from one timer."""
    from types import SimpleNamespace as Event

    store, processor = _Store(), live.CartFollowUps()
    processor.init(store)
    second = 1_000_000
    views = [Event(at=i * second, event_type="view", price=1.0) for i in range(instants)]
    cart = Event(at=instants * second, event_type="cart", price=5.0)
    list(processor.handleInputRows(("s", 1), iter([*views, cart]), _Clock(0)))
    assert store.calls <= most
    store.calls, sent = 0, []
    late = _Clock(10 * live.IDLE // 1000)
    while store.timers:
        timer = _Clock(0, store.timers.pop(0))
        sent += processor.handleExpiredTimer(("s", 1), late, timer)
    assert store.calls <= 5
    assert [(r["kind"], r["num_views_before_cart"], r["num_cart_items"]) for r in sent] == [
        ("reminder", instants, 1), ("offer", instants, 1)]
    assert store.value is None and not store.map


def test_an_offer_waits_for_its_own_deadline():
    """The watermark lies between the deadlines: a purchase in the gap still counts for the offer."""
    from types import SimpleNamespace as Event

    store, processor = _Store(), live.CartFollowUps()
    processor.init(store)
    list(processor.handleInputRows(("s", 1), iter([Event(at=0, event_type="cart", price=5.0)]), _Clock(0)))
    first = store.timers.pop()
    sent = list(processor.handleExpiredTimer(("s", 1), _Clock(first), _Clock(0, first)))
    bought = Event(at=20 * live.MINUTE, event_type="purchase", price=5.0)
    list(processor.handleInputRows(("s", 1), iter([bought]), _Clock(first)))
    second = store.timers.pop()
    sent += processor.handleExpiredTimer(("s", 1), _Clock(second), _Clock(0, second))
    assert [(r["kind"], r["bought"]) for r in sent] == [("reminder", False), ("offer", True)]
    assert store.value is None and not store.timers


def test_a_batch_of_silver_adds_few_files(spark, tmp_path):
    """900 rows of three days in 32 shuffle partitions: at most a file a day and core, each row once."""
    from basketlake.sinks import batches
    from basketlake.streaming.silver import store_batch, stored_silver

    clicks = [event(f"f{i}", i, at(i % 600 + 1440 * (i % 3)), "view") for i in range(900)]
    raw = spark.createDataFrame(clicks + clicks[:50], schemas.EVENTS_SILVER)
    raw = raw.select(*[raw[c].cast("string").alias(c) for c in raw.columns])
    changed = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false"}  # as in a stream
    before = {name: spark.conf.get(name) for name in changed}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        store_batch(raw.limit(300), 0, f"{tmp_path}/silver")
        store_batch(raw, 1, f"{tmp_path}/silver")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    files = [f for folder in batches.batch_folders(spark, f"{tmp_path}/silver") for f in (tmp_path / "silver" / folder).glob("*.parquet")]
    assert len(files) <= 2 * 3 * -(-spark.sparkContext.defaultParallelism // 3)
    assert stored_silver(spark, f"{tmp_path}/silver").count() == 900


def _random_sessions(count, seed):
    """(session, user, minutes, kind) of sessions over two days, some with gaps beyond the idle time."""
    import random

    draw, rows = random.Random(seed), []
    for number in range(count):
        minute = draw.randrange(48 * 60)
        for _ in range(draw.randrange(1, 6)):
            rows.append((f"r{number}", number if number % 7 else None, minute, draw.choice(("view", "view", "cart", "purchase"))))
            minute += draw.choice((1, 3, 5, 30, 60, 61, 130, 400))
    return rows


def test_whole_sessions_are_answered_as_by_their_state():
    """Sessions that begin and end in a batch make no state call; what they get is what the processor gives."""
    from types import SimpleNamespace as Sums

    import pyarrow as pa

    sessions = {}
    for session, user, minute, kind in _random_sessions(400, 5):
        sums = live.sums_by_instant([(minute * live.MINUTE, kind, 2.5)])[minute * live.MINUTE]
        held = sessions.setdefault((session, user), {})
        held[minute * live.MINUTE] = tuple(a + b for a, b in zip(sums, held.get(minute * live.MINUTE, (0, 0, 0, 0.0))))
    names = ["user_session", "user_id", "at", *live._SUMS.names]
    lines = [(*key, instant, *sums) for key, held in sessions.items() for instant, sums in held.items()]
    instants = pa.table([pa.array(column) for column in zip(*lines[::-1])], names=names)
    answers, others = live.settle_whole(instants, live.DELAYS, live.IDLE)
    stateful = {(r["user_session"], r["user_id"]) for r in others.to_pylist()}
    assert 0 < len(stateful) < len(sessions) / 3  # the ends of the batch only
    assert others.num_rows == sum(len(sessions[key]) for key in stateful)
    want, watermark = [], max(line[2] for line in lines)
    for key in sessions.keys() - stateful:
        store, processor = _Store(), live.FinalFollowUps()
        processor.init(store)
        rows = [Sums(at=instant, **dict(zip(live._SUMS.names, sums))) for instant, sums in sessions[key].items()]
        want += [tuple(r.asDict()[name] for name in live.OUTPUT.names)
                 for r in processor.handleInputRows(key, iter(rows), _Clock(watermark // 1000))]
        assert store.calls == 1 and store.value is None and not store.timers  # looked up, never stored
    assert sorted((tuple(r.values()) for r in answers.to_pylist()), key=repr) == sorted(want, key=repr)


def test_sessions_over_several_long_batches(spark, tmp_path):
    """Batches that span hours, sessions within one and across: the same rows as the batch form."""
    events = [event(session, user or 0, at(minute), kind, 2.5) for session, user, minute, kind in _random_sessions(150, 8)]
    files = [[e for e in events if e[0] < at(900)], [e for e in events if at(900) <= e[0] < at(1700)],
             [e for e in events if e[0] >= at(1700)]]
    _run(spark, tmp_path, files)
    frame = spark.createDataFrame(events, schemas.EVENTS_SILVER)
    as_of = F.lit(max(e[0] for e in events) - timedelta(minutes=10))
    figures = ["user_session", "user_id", "first_cart_time", "deadline"]
    assert rows_of(live.read_messages(spark, f"{tmp_path}/out", "reminder"), *figures) == rows_of(batch.cart_reminders(frame, as_of), *figures)
    figures += ["total_cart_value", "num_cart_items", "num_views_before_cart", "session_duration_sec"]
    assert rows_of(live.read_messages(spark, f"{tmp_path}/out", "offer"), *figures) == rows_of(batch.offer_sessions(frame, as_of), *figures)
