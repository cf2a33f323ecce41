"""Follow-ups after a first cart: reminder after 5 minutes, offer after 1 hour.

In the stream, events wait for late ones in a built-in aggregate (:func:`final_instants`), and
sessions that begin and end in one micro-batch need no state (:func:`settled_sessions`).

State is kept per session and user, and it ends. In :class:`CartFollowUps`, which takes events, those within the allowed lateness are
held as sums per instant, so a session with any number of clicks a second costs one entry
for that second: up to ``HELD_MOST`` of them in the session's record, which one call reads
and one writes, the rest in a map state. Entries that the watermark has passed are folded
into the record's figures. A session's state goes

- when its last deadline has passed: its first cart is then in the *ledger*, a stored
  table, and carts that start it over later are recognised there;
- when it has no cart and was idle for ``IDLE``: its figures so far go to the ledger and
  are added to an offer that may still come.

So the state grows with the sessions that are active, not with all sessions ever seen.
:func:`start_followups` runs the stream with its ledger; the batch forms in
:mod:`basketlake.operators.followups` give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basketlake.models.common import score
from basketlake.operators.decisions import offer_features, prescribe_offer
from basketlake.operators.followups import with_reminder_text
from basketlake.schemas import SESSION_KEYS
from basketlake.session import ROCKSDB_PROVIDER
from basketlake.sinks import batches, versions
from basketlake.sinks import lake as sink

MINUTE = 60_000_000  # microseconds
DELAYS = {"reminder": 5 * MINUTE, "offer": 60 * MINUTE}
FOLD_EVERY = MINUTE
IDLE = 120 * MINUTE  # a session without a cart leaves the state after so long
HELD_MOST = 1024  # instants kept in the record itself; every call to the state store is a round trip

#: kind: a follow-up that falls due, or "idle" (figures of a session without a cart so far).
OUTPUT = T.StructType([
    T.StructField("user_session", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("bought", T.BooleanType()),
    T.StructField("first_cart_us", T.LongType()),
    T.StructField("deadline_us", T.LongType()),
    T.StructField("total_cart_value", T.DoubleType()),
    T.StructField("num_cart_items", T.LongType()),
    T.StructField("num_views_before_cart", T.LongType()),
    T.StructField("first_us", T.LongType()),
    T.StructField("last_us", T.LongType()),
])

_AT = T.StructType([T.StructField("at", T.LongType())])
_SUMS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("views", "items", "purchases")]
    + [T.StructField("value", T.DoubleType())]
)
#: held: sums of the first instants; mapped: whether the map state holds more of them.
_RECORD = T.StructType(
    [T.StructField(n, T.LongType()) for n in
     ("cart", "bought", "items", "views", "first", "last", "oldest", "idle")]
    + [T.StructField("value", T.DoubleType()), T.StructField("mapped", T.BooleanType()),
       T.StructField("held", T.ArrayType(T.StructType(_AT.fields + _SUMS.fields)))]
)


def _timer(us: int) -> int:
    """Milliseconds at or after the instant."""
    return -(-us // 1000)


def _least(a: int | None, b: int) -> int:
    return b if a is None else min(a, b)


def sums_by_instant(events) -> dict[int, tuple]:
    """(views, carts, purchases, cart value) per time of (at, kind, price) events."""
    out: dict[int, tuple] = {}
    for at, kind, price in events:
        views, items, purchases, value = out.get(at, (0, 0, 0, 0.0))
        out[at] = (views + (kind == "view"), items + (kind == "cart"), purchases + (kind == "purchase"),
                   value + (price or 0.0) * (kind == "cart"))
    return out


class CartFollowUps(StatefulProcessor):
    """Emits one row per follow-up that falls due, bought or not, and one per idle session."""

    def __init__(self, delays: dict[str, int] | None = None, idle: int = IDLE) -> None:
        self.delays = dict(delays or DELAYS)
        self.horizon = max(self.delays.values())
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _RECORD)
        self.pending = handle.getMapState("pending", _AT, _SUMS)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        found = self.record.get()  # one call; None without a state
        if found is None:
            return dict.fromkeys(_RECORD.names, None) | {"items": 0, "views": 0, "value": 0.0, "mapped": False, "held": {}}
        record = dict(zip(_RECORD.names, found))
        record["held"] = {at: tuple(sums) for at, *sums in record["held"]}
        return record

    def _save(self, record: dict) -> None:
        held = [(at, *sums) for at, sums in record["held"].items()]
        self.record.update(tuple((record | {"held": held})[name] for name in _RECORD.names))

    def _forget(self, record: dict) -> None:
        self.record.clear()
        if record["mapped"]:
            self.pending.clear()

    def _fold(self, record: dict, at: int, sums: tuple) -> None:
        """Count one instant whose place relative to the first cart cannot change any more."""
        views, items, purchases, value = sums
        cart = record["cart"]
        if cart is not None and at > cart + self.horizon:
            return
        record["first"] = _least(record["first"], at)
        record["last"] = max(at, record["last"] or at)
        record["items"] += items
        record["value"] += value
        if cart is None or at < cart:
            record["views"] += views
        elif purchases:
            record["bought"] = _least(record["bought"], at)

    def _settle(self, record: dict, watermark: int) -> None:
        """Fold the held instants that are final at ``watermark``, oldest first."""
        if record["oldest"] is None:
            return
        cart = record["cart"]
        mapped = {tuple(k)[0]: tuple(v) for k, v in self.pending.iterator()} if record["mapped"] else {}
        held = sorted((record["held"] | mapped).items())
        final = held if cart is not None and cart <= watermark else [h for h in held if h[0] <= watermark]
        for at, sums in final:
            self._fold(record, at, sums)
        if len(final) == len(held):
            if mapped:
                self.pending.clear()
            record["held"], record["mapped"], record["oldest"] = {}, False, None
        else:
            for at, _ in final:
                if at in mapped:
                    self.pending.removeKey((at,))
                else:
                    del record["held"][at]
            record["oldest"] = held[len(final)][0]

    def _hold(self, record: dict, arrived: dict[int, tuple]) -> None:
        """Add to the held sums."""
        oldest, newest, held, mapped = record["oldest"], max(arrived), record["held"], record["mapped"]
        for at, sums in arrived.items():
            if at in held:
                held[at] = tuple(a + b for a, b in zip(sums, held[at]))
            elif mapped and self.pending.containsKey((at,)):
                self.pending.updateValue((at,), tuple(a + b for a, b in zip(sums, self.pending.getValue((at,)))))
            elif len(held) < HELD_MOST:
                held[at] = sums
            else:
                self.pending.updateValue((at,), sums)
                record["mapped"] = True
        record["oldest"] = min([*arrived, *([oldest] if oldest is not None else [])])
        if record["cart"] is None and record["idle"] is None:
            record["idle"] = newest + self.idle
            self.handle.registerTimer(_timer(record["idle"]))

    def _new_first_cart(self, record: dict, cart: int) -> None:
        """Move the timer to the first deadline of an earlier, or the first, cart.

        A deadline sets the timer for the next one when it falls due, so there is one at a time.
        """
        if record["idle"] is not None:
            self.handle.deleteTimer(_timer(record["idle"]))
            record["idle"] = None
        soonest = min(self.delays.values())
        if record["cart"] is not None:
            self.handle.deleteTimer(_timer(record["cart"] + soonest))
        self.handle.registerTimer(_timer(cart + soonest))
        record["cart"] = cart

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        record = self._load()
        before = record["cart"]
        arrived = sums_by_instant((row.at, row.event_type, row.price) for row in rows)
        if before is not None and before <= watermark:
            # No earlier cart can arrive: sums are counted at once, none is held.
            self._settle(record, watermark)
            for at, sums in sorted(arrived.items()):
                self._fold(record, at, sums)
            self._save(record)
            return iter([])
        carts = [at for at, sums in arrived.items() if sums[1]]
        if carts and (before is None or min(carts) < before):
            self._new_first_cart(record, min(carts))
        self._hold(record, arrived)
        final = record["cart"] is not None and record["cart"] <= watermark
        if final or record["oldest"] + FOLD_EVERY <= watermark:
            self._settle(record, watermark)
        self._save(record)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_ms, watermark_ms = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        record = self._load()
        self._settle(record, watermark_ms * 1000)
        cart, due = record["cart"], []
        if cart is not None:
            later = []
            for kind, delay in self.delays.items():
                if _timer(cart + delay) > watermark_ms:
                    later.append(_timer(cart + delay))
                elif _timer(cart + delay) >= now_ms:
                    bought = record["bought"] is not None and record["bought"] <= cart + delay
                    due.append(self._row(key, record, kind, bought, cart + delay))
            over = not later
            if later:
                self.handle.registerTimer(min(later))
        else:
            over = record["oldest"] is None and record["last"] is not None and _timer(record["last"] + self.idle) <= watermark_ms
            if over:
                due.append(self._row(key, record, "idle", False, None))
            else:  # events came since the timer was set
                newest = max([record["last"] or 0, *record["held"]])
                if record["mapped"]:
                    newest = max(newest, *(tuple(at)[0] for at in self.pending.keys()))
                record["idle"] = max(newest + self.idle, now_ms * 1000 + 1)
                self.handle.registerTimer(_timer(record["idle"]))
        if over:
            self._forget(record)
        else:
            self._save(record)
        return iter(due)

    @staticmethod
    def _row(key, record: dict, kind: str, bought: bool, deadline: int | None) -> Row:
        return Row(
            user_session=key[0], user_id=key[1], kind=kind, bought=bought, first_cart_us=record["cart"],
            deadline_us=deadline, total_cart_value=float(record["value"]),
            num_cart_items=record["items"], num_views_before_cart=record["views"],
            first_us=record["first"], last_us=record["last"],
        )


class FinalFollowUps(CartFollowUps):
    """The same on sums of instants that the watermark has passed, each instant once (:func:`final_instants`).

    Nothing can come before them any more, so nothing is held: a session whose deadlines
    have all passed is answered at once and never stored, and one that is still open
    stores its figures and one timer. Packs of answers (:func:`settled_sessions`) pass.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return (Row(**dict.fromkeys(OUTPUT.names), pack=row.pack) for row in rows)
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        record = self._load()
        stored, known = record["last"] is not None, record["cart"] is not None
        arrived = [(row.at, (row.views, row.items, row.purchases, row.value)) for row in rows]
        if not known:
            record["cart"] = min((at for at, sums in arrived if sums[1]), default=None)
        for at, sums in arrived:
            self._fold(record, at, sums)
        if known:  # its timer is set
            self._save(record)
            return iter([])
        due, timer = self._answers(key, record, watermark_ms)
        if record["idle"] is not None and (timer is None or record["cart"] is not None):
            self.handle.deleteTimer(_timer(record["idle"]))
            record["idle"] = None
        if timer is None:
            if stored:
                self._forget(record)
            return iter(due)
        if record["cart"] is not None:
            self.handle.registerTimer(timer)
        elif record["idle"] is None:
            record["idle"] = record["last"] + self.idle
            self.handle.registerTimer(timer)
        self._save(record)
        return iter(due)

    def _answers(self, key, record: dict, watermark_ms: int) -> tuple[list[Row], int | None]:
        """Rows that are due at the watermark, and the time of the next one (None: the session is over)."""
        cart = record["cart"]
        if cart is None:
            idle = _timer(record["last"] + self.idle)
            return ([], idle) if idle > watermark_ms else ([self._row(key, record, "idle", False, None)], None)
        due, later = [], []
        for kind, delay in self.delays.items():
            if _timer(cart + delay) > watermark_ms:
                later.append(_timer(cart + delay))
            else:
                bought = record["bought"] is not None and record["bought"] <= cart + delay
                due.append(self._row(key, record, kind, bought, cart + delay))
        return due, min(later, default=None)

    @staticmethod
    def _row(*args) -> Row:
        return Row(**CartFollowUps._row(*args).asDict(), pack=None)


_PACK = T.StructField("pack", T.BinaryType())
PACK_ROWS = 10_000


def final_instants(events: DataFrame) -> DataFrame:
    """Sums per session and instant, given out once the watermark has passed the instant.

    A built-in aggregate, so events wait for late ones in Spark's own state and reach the
    follow-ups once, as one row per instant.
    """
    def times(kind: str) -> Column:
        return F.count_if(F.col("event_type") == kind)

    value = F.sum(F.when(F.col("event_type") == "cart", F.col("price")))
    return events.groupBy(*SESSION_KEYS, "event_time").agg(
        times("view").alias("views"), times("cart").alias("items"), times("purchase").alias("purchases"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
    ).withColumn("at", F.unix_micros("event_time"))


def settle_whole(instants: pa.Table, delays: dict[str, int], idle: int) -> tuple[pa.Table, pa.Table]:
    """Answers (``OUTPUT``) of the sessions that need no state, and the instants of all others.

    ``instants`` are final ones of a micro-batch, all of a session's among them. The
    watermark was below the first of them before the batch and is at or above the last one
    now. A session that begins more than ``idle`` after the first instant cannot meet a
    state: whatever an earlier visit left there is over by then, and the ledger joins the
    two. If its last deadline (without a cart: its idle time) lies before the last instant
    as well, all that happens to it is in these rows.
    """
    never, horizon = np.iinfo(np.int64).max, max(delays.values())
    codes = [np.asarray(pc.dictionary_encode(instants[c].combine_chunks(), null_encoding="encode").indices) for c in SESSION_KEYS]
    at = instants["at"].to_numpy()
    order = np.lexsort((at, *codes))
    at, codes = at[order], [c[order] for c in codes]
    views, items, purchases, value = (instants[c].to_numpy()[order] for c in _SUMS.names)
    new = np.concatenate([[True], np.logical_or(*[c[1:] != c[:-1] for c in codes])])
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    first, cart = at[starts], np.minimum.reduceat(np.where(items > 0, at, never), starts)
    has_cart = cart < never
    until = np.where(has_cart, cart, never - horizon) + horizon
    counts = at <= until[of]
    last = np.maximum.reduceat(np.where(counts, at, first[of]), starts)
    bought = np.minimum.reduceat(np.where(counts & (purchases > 0) & (at >= cart[of]), at, never), starts)
    over = np.where(has_cart, until, last + idle)
    whole = (first > at.min() + max(idle, horizon)) & (over <= at.max())
    figures = {
        **{c: instants[c].take(order[starts]) for c in SESSION_KEYS}, "first_cart_us": cart,
        "total_cart_value": np.add.reduceat(np.where(counts, value, 0.0), starts),
        "num_cart_items": np.add.reduceat(np.where(counts, items, 0), starts),
        "num_views_before_cart": np.add.reduceat(np.where(at < cart[of], views, 0), starts),
        "first_us": first, "last_us": last,
    }
    answers = []
    for kind, delay in [*delays.items(), ("idle", None)]:
        rows = np.flatnonzero(whole & (has_cart if delay else ~has_cart))
        own = {c: v.take(rows) for c, v in figures.items()}
        if delay:
            own |= {"bought": bought[rows] <= cart[rows] + delay, "deadline_us": cart[rows] + delay}
        else:
            own |= {"bought": np.zeros(len(rows), bool), "first_cart_us": pa.nulls(len(rows), pa.int64()), "deadline_us": pa.nulls(len(rows), pa.int64())}
        own["kind"] = pa.repeat(pa.scalar(kind), len(rows))
        answers.append(pa.table({c: own[c] for c in OUTPUT.names}, schema=to_arrow_schema(OUTPUT)))
    return pa.concat_tables(answers), instants.take(np.sort(order[~whole[of]]))


def settled_sessions(instants: DataFrame, delays: dict[str, int], idle: int) -> DataFrame:
    """Instants of the sessions that need state; answers of all others in packs, without a session's name.

    In a batch of a minute nearly all sessions need state. When a stream catches up, a batch spans
    days and nearly all sessions begin and end in it: they cost no call to the state store.
    """
    # a pack's row has nulls; the metadata mark the watermark column
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True, f.metadata) for f in instants.schema], _PACK])

    def settle(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived = [b for b in arrived if b.num_rows]
        if not arrived:
            return
        answers, others = settle_whole(pa.Table.from_batches(arrived), delays, idle)
        yield from others.append_column("pack", pa.nulls(len(others), pa.binary())).to_batches(PACK_ROWS)
        packed = others.schema.append(pa.field("pack", pa.binary()))
        for start in range(0, len(answers), PACK_ROWS):
            part, held = answers.slice(start, PACK_ROWS), pa.BufferOutputStream()
            with pa.ipc.new_stream(held, part.schema) as out:
                out.write_table(part)
            line = {"user_id": part["user_id"][0].as_py(), "pack": held.getvalue().to_pybytes()}  # the id spreads packs over tasks
            yield pa.RecordBatch.from_pylist([line], schema=packed)

    return instants.repartition(*SESSION_KEYS).mapInArrow(settle, schema)


def unpacked(answers: DataFrame) -> DataFrame:
    """Follow-ups one a row: those of the state, and those of the packs."""
    def unpack(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            yield batch.filter(pc.is_null(batch["pack"])).select(OUTPUT.names)
            for pack in batch["pack"].drop_null():
                yield from pa.ipc.open_stream(pack.as_buffer())

    return answers.mapInArrow(unpack, OUTPUT)


def due_followups(silver_stream: DataFrame, kinds: list[str] | None = None, idle: int = IDLE) -> DataFrame:
    """Follow-ups that fall due on a watermarked Silver stream, told apart by ``kind``.

    Rows for later carts of a session that was already handled come too; only the
    ledger tells them (:func:`with_ledger`). With reminders alone, views never reach the
    state operator.
    """
    silver_stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER
    )
    # The driver starts a Python process of its own for the processor's setup, and files
    # shipped to the workers are not on its path: the processor travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    delays = {kind: DELAYS[kind] for kind in kinds or DELAYS}
    # The watermark column has to travel along for the timers to see it.
    narrow = silver_stream.filter(F.col("user_session").isNotNull()).select(
        *SESSION_KEYS, "event_time", "event_type", "price"
    )
    if list(delays) == ["reminder"]:
        narrow = narrow.filter(F.col("event_type").isin("cart", "purchase"))
    open_sessions = settled_sessions(final_instants(narrow), delays, idle)
    return unpacked(open_sessions.groupBy(*SESSION_KEYS).transformWithState(
        FinalFollowUps(delays, idle), T.StructType([*OUTPUT.fields, _PACK]), outputMode="append", timeMode="EventTime"
    ))


LEDGER = T.StructType([
    *[f for f in OUTPUT.fields if f.name in (*SESSION_KEYS, "first_cart_us", "num_views_before_cart", "first_us", "last_us")],
    T.StructField("batch_id", T.LongType()),
])


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Handled first carts, and figures of idle sessions (no cart), of the batches before one."""
    return versions.read_parts(spark, path, batches.batch_folders(spark, path, before), LEDGER).select(*LEDGER.names)


def with_ledger(due: DataFrame, ledger: DataFrame) -> DataFrame:
    """Due rows of first carts only, with the figures that idle sessions had before.

    Both sides are grouped by session; sessions without a row in ``due`` are dropped from
    the ledger first, so the join moves what the batch holds and nothing else.
    """
    names = [c for c in LEDGER.names if c != "batch_id"]
    touched = ledger.select(names).join(due.select(*SESSION_KEYS).distinct(), SESSION_KEYS, "left_semi")
    known = touched.unionByName(due.select(names))
    first = known.groupBy(*SESSION_KEYS).agg(F.min("first_cart_us").alias("_first_cart"))
    rows = due.filter(F.col("kind") != "idle").join(first, SESSION_KEYS)
    rows = rows.filter(F.col("first_cart_us") == F.col("_first_cart")).drop("_first_cart")
    early = known.filter(F.col("first_cart_us").isNull()).groupBy(*SESSION_KEYS, F.col("last_us").alias("_until")).agg(
        F.max("num_views_before_cart").alias("_views"), F.min("first_us").alias("_since"))
    # an idle session's events all lie before a cart that comes later
    spans = rows.select(*SESSION_KEYS, "first_cart_us").distinct().join(early, SESSION_KEYS)
    added = spans.filter(F.col("_until") < F.col("first_cart_us")).groupBy(*SESSION_KEYS).agg(
        F.sum("_views").alias("_views"), F.min("_since").alias("_since"))
    return rows.join(added, SESSION_KEYS, "left").withColumns({
        "num_views_before_cart": F.col("num_views_before_cart") + F.coalesce("_views", F.lit(0)),
        "first_us": F.least("first_us", "_since"),
    }).drop("_views", "_since")


def handle_due(
    batch: DataFrame, batch_id: int, target: str,
    risk_model: PipelineModel | None = None, profile_model: PipelineModel | None = None,
    kinds: list[str] | None = None,
) -> None:
    """``foreachBatch`` writer: messages to ``reminders`` and ``offers``, carts to ``ledger``.

    A batch that runs again replaces what it wrote; the ledger
    is read as it stood before the batch, so a rerun decides alike. The batch is worked out
    by a pass of its own: scans of rows not yet kept run side by side, and each of them
    would run the state operator.
    """
    kept = batch.persist()
    kept.count()
    rows = with_ledger(kept, read_ledger(kept.sparkSession, f"{target}/ledger", batch_id)).persist()
    for kind in kinds or DELAYS:
        out = reminders_of(rows) if kind == "reminder" else offers_of(rows, risk_model, profile_model)
        sink.append_curated(out, batch_id, f"{target}/{kind}s")
    lines = kept.select([c for c in LEDGER.names if c != "batch_id"]).distinct()
    sink.append_curated(lines, batch_id, f"{target}/ledger")
    rows.unpersist()
    kept.unpersist()


def start_followups(
    silver_stream: DataFrame, target: str, checkpoint: str, trigger: dict,
    risk_model: PipelineModel | None = None, profile_model: PipelineModel | None = None,
    kinds: list[str] | None = None, idle: int = IDLE,
):
    """Start the follow-up query with its ledger; gives the running query."""
    def route(batch: DataFrame, batch_id: int) -> None:
        handle_due(batch, batch_id, target, risk_model, profile_model, kinds)

    return (
        due_followups(silver_stream, kinds, idle).writeStream.foreachBatch(route).trigger(**trigger)
        .option("checkpointLocation", checkpoint).start()
    )


def read_messages(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """Messages of one kind that :func:`handle_due` has stored."""
    none = spark.createDataFrame([], OUTPUT)
    like = reminders_of(none) if kind == "reminder" else offers_of(none)
    path = f"{target}/{kind}s"
    return versions.read_parts(spark, path, batches.batch_folders(spark, path), like.schema).select(*like.columns)


def _times(due: DataFrame, kind: str) -> DataFrame:
    return due.filter((F.col("kind") == kind) & ~F.col("bought")).withColumns({
        "first_cart_time": F.timestamp_micros("first_cart_us"),
        "deadline": F.timestamp_micros("deadline_us"),
        "session_duration_sec": F.expr("last_us div 1000000 - first_us div 1000000"),
    }).drop("kind", "bought", "first_cart_us", "deadline_us", "first_us", "last_us")


def reminders_of(due: DataFrame) -> DataFrame:
    """Reminder rows among due follow-ups."""
    return with_reminder_text(_times(due, "reminder").select(*SESSION_KEYS, "first_cart_time", "deadline"))


def offers_of(
    due: DataFrame,
    risk_model: PipelineModel | None = None,
    profile_model: PipelineModel | None = None,
) -> DataFrame:
    """Offers for the due follow-ups of kind offer."""
    sessions = _times(due, "offer").withColumn("hour_of_day", F.hour("first_cart_time"))
    return scored_offers(sessions, risk_model, profile_model)


def scored_offers(
    sessions: DataFrame,
    risk_model: PipelineModel | None = None,
    profile_model: PipelineModel | None = None,
) -> DataFrame:
    """Offers for session figures; works the same on a stream and on a table."""
    scored = offer_features(sessions)
    keep = scored.columns
    risk = profile = None
    if risk_model is not None:
        scored = score(risk_model, scored, "_risk").select(*keep, "_risk")
        keep, risk = [*keep, "_risk"], F.col("_risk")
    if profile_model is not None:
        scored = profile_model.transform(scored).select(
            *keep, F.col("ml_predicted_profile").alias("_profile")
        )
        profile = F.col("_profile")
    return prescribe_offer(scored, risk, profile).drop("_risk", "_profile")
