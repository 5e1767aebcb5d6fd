"""Structured Streaming over snapshots and events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: transformWithState keeps its state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Columns of change events, spelled out, as workers cannot parse type strings.
OUT = T.StructType([
    T.StructField("business_id", T.LongType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("event_type", T.StringType()),
    T.StructField("previous_val", T.StringType()), T.StructField("new_val", T.StringType()),
])
#: The same as the processor gives them, times in microseconds.
TIMED = T.StructType([T.StructField("us", T.LongType()) if f.name == "occurred_at" else f for f in OUT])
#: Rows of a business that are one value of the state at most.
CHUNK = 1_000


class Changes(StatefulProcessor):
    """Snapshots wait, in any order, until the watermark has passed them; then each is compared with the one before it.

    State of a business: the snapshots that wait, column-wise in chunks, as each value of the
    state is a call of its own, the last one compared, and when its timer is due. A timer at
    the earliest that waits, or else at the end of the idle time, is all that wakes it; after the idle time the state is gone.
    """

    def __init__(self, fields: list[str], idle_us: int) -> None:
        self.fields, self.idle_us = fields, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = [T.StructField(f, T.StringType()) for f in self.fields]
        several = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in (T.StructField("us", T.LongType()), T.StructField("tie", T.LongType()), *values)]
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType(several))
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), *values]))

    @staticmethod
    def _columns(rows: list[tuple]) -> tuple[list, ...]:
        return tuple(map(list, zip(*rows, strict=True)))

    def _timed(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        least = None
        while some := list(islice(rows, CHUNK)):
            columns = self._columns([tuple(r[f] for f in ("us", "tie", *self.fields)) for r in some])
            self.waiting.appendValue(columns)
            least = min(columns[0]) if least is None else min(least, *columns[0])
        if least is not None:
            due, ms = self.due.get(), -(-least // 1_000)
            if due is None or ms < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self._timed(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        """The timer that has expired was the only one, and Spark removes it."""
        upto = timerValues.getCurrentWatermarkInMs() * 1_000
        held = [r for columns in self.waiting.get() for r in zip(*columns, strict=True)]
        ready = sorted((r for r in held if r[0] <= upto), key=lambda r: (r[0], r[1]))
        later = [r for r in held if r[0] > upto]
        last = self.last.get()
        events = []
        for us, _, *values in ready:
            if last is not None and us - last[0] <= self.idle_us:
                for name, old, new in zip(self.fields, last[1:], values, strict=True):
                    a, b = (old or "").strip(" "), (new or "").strip(" ")
                    if a and b and a.lower() != b.lower():
                        events.append(Row(business_id=key[0], us=us, event_type=f"{name.upper()}_CHANGED", previous_val=old, new_val=new))
            last = (us, *values)
        if ready and later:
            self.waiting.put([self._columns(later[k : k + CHUNK]) for k in range(0, len(later), CHUNK)])
        elif ready:
            self.waiting.clear()
        if later:
            self._timed(-(-min(r[0] for r in later) // 1_000))
        elif last is not None and last[0] + self.idle_us > upto:
            self._timed(-(-(last[0] + self.idle_us) // 1_000))
        else:
            last = None
            self.due.clear()
        if last is None:
            self.last.clear()
        elif ready:
            self.last.update(last)
        return iter(events)

    def close(self) -> None:
        pass


def changes(snapshots: DataFrame, fields: list[str], late: str = "1 hour", idle_days: int = 365) -> DataFrame:
    """Change events of a stream of snapshots (business_id, snapshot_timestamp, fields), whatever the order in which they come.

    The rows are those of monitoring.changes over all snapshots up to the watermark, `late`
    behind the newest one: a field changed if it is filled in two neighbouring snapshots and
    differs whatever the case. Equal times are ordered as there. Snapshots behind the
    watermark are left out; a business without snapshots for `idle_days` is forgotten, and its next one is a first.
    """
    key, at = F.col("business_id").cast("long"), F.col("snapshot_timestamp").cast("timestamp").alias("snapshot_timestamp")
    values = [F.col(f).cast("string").alias(f) for f in fields]
    keyed = snapshots.select(key.alias("business_id"), at, F.unix_micros(at).alias("us"), F.xxhash64(*fields).alias("tie"), *values).where("business_id is not null and us is not null")
    found = keyed.withWatermark("snapshot_timestamp", late).groupBy("business_id").transformWithState(Changes(fields, idle_days * 86_400_000_000), TIMED, "Append", "EventTime")
    return found.select("business_id", F.timestamp_micros("us").alias("occurred_at"), "event_type", "previous_val", "new_val")


def reincarnations(removed: DataFrame, seen: DataFrame, within: str = "90 days", late: str = "1 hour") -> DataFrame:
    """A REINCARNATION_SIGNAL for a business first seen within a time after one of equal phone, domain or postal code was removed.

    removed(id, at, normalized_phone, domain, postal_code) and seen, likewise, are streams
    or tables. Their states end with the watermarks: a removal is held for the time that it can still be answered.
    """
    kinds = {"phone": "normalized_phone", "domain": "domain", "postal": "postal_code"}

    def keyed(df: DataFrame, into: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in kinds.items()])
        timed = df.withWatermark("at", late) if df.isStreaming else df
        return timed.select(F.col("id").alias(f"{into}_id"), F.col("at").alias(f"{into}_at"), F.explode(pairs).alias("x")).select(f"{into}_id", f"{into}_at", F.col("x.kind").alias(f"{into}_kind"), F.col("x.key").alias(f"{into}_key")).where(f"coalesce({into}_key, '') <> ''")

    gone, new = keyed(removed, "removed"), keyed(seen, "business")
    on = "removed_kind = business_kind AND removed_key = business_key AND business_id <> removed_id AND business_at > removed_at"
    found = gone.join(new, F.expr(f"{on} AND business_at <= removed_at + INTERVAL {within}"))
    return found.select("business_id", F.lit("REINCARNATION_SIGNAL").alias("event_type"), "removed_id", F.col("business_kind").alias("shared"), F.col("business_at").alias("occurred_at"))


def rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per type and window of event time, with a watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with gaps under `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
