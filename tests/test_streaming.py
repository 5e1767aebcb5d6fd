from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import monitoring as batch
from ledgerlens.streaming import monitoring

SNAPSHOTS = "business_id long, snapshot_timestamp timestamp, name string, phone string"


@pytest.fixture
def store(spark):
    for k, v in monitoring.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in monitoring.STORE:
        spark.conf.unset(k)


def written(spark, rows, ddl, path, times="snapshot_timestamp"):
    made = spark.createDataFrame([tuple(r) for r in rows], ddl.replace(f"{times} timestamp", f"{times} string"))
    made.withColumn(times, F.to_timestamp(times)).coalesce(1).write.mode("append").parquet(path)


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_changes_of_a_shuffled_stream_equal_the_batch(spark, tmp_path, store):
    """Rows come in five batches in any order within the lateness; neither order nor batches show in the answer."""
    r = random.Random(5)
    rows = [(r.choice([1, 2, 3, None]), f"2024-01-01 {m // 60:02}:{m % 60:02}:{r.randint(0, 2)}0", r.choice(["Foo", "foo ", "Bar", "", None]), r.choice(["1", "2", None])) for m in range(300)]
    rows += [(4, "2024-01-01 00:00:00", "same", "1"), (4, "2024-01-01 00:00:00", "time", "1")]
    late = 60
    shuffled = sorted(rows, key=lambda x: int(x[1][11:13]) * 60 + int(x[1][14:16]) + r.random() * late)
    path = f"{tmp_path}/s"
    (tmp_path / "s").mkdir()
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(path)
    for k in range(5):
        written(spark, shuffled[k * len(rows) // 5 : (k + 1) * len(rows) // 5], SNAPSHOTS, path)
    written(spark, [(9, "2024-01-01 12:00:00", "end", "1")], SNAPSHOTS, path)
    drained(monitoring.changes(stream, ["name", "phone"], f"{late + 1} minutes").writeStream.format("memory").queryName("shuffled").outputMode("append").start())
    columns = ["business_id", "occurred_at", "event_type", "previous_val", "new_val"]
    got = sorted(map(str, spark.table("shuffled").select(*columns).collect()))
    every = spark.read.schema(SNAPSHOTS).parquet(path).where("business_id is not null")
    want = sorted(map(str, batch.changes(every, ["name", "phone"]).select(*columns).collect()))
    assert got == want and len(got) > 50


def test_idle_businesses_are_forgotten_and_late_rows_left_out(spark, tmp_path, store):
    path = f"{tmp_path}/s"
    (tmp_path / "s").mkdir()
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(path)
    query = monitoring.changes(stream, ["name"], "1 hour", idle_days=2).writeStream.format("memory").queryName("idle").outputMode("append").start()
    for rows in ([(1, "2024-01-01 00:00:00", "Foo", None), (2, "2024-01-01 00:00:00", "Foo", None)], [(1, "2024-01-02 12:00:00", "Bar", None)], [(9, "2024-01-08 00:00:00", "x", None)], [(1, "2024-01-05 00:00:00", "too late", None)], [(2, "2024-01-09 00:00:00", "Baz", None), (1, "2024-01-09 00:00:00", "Qux", None)], [(9, "2024-01-20 00:00:00", "y", None)]):
        written(spark, rows, SNAPSHOTS, path)
        query.processAllAvailable()
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert [(r["business_id"], r["previous_val"], r["new_val"]) for r in spark.table("idle").collect()] == [(1, "Foo", "Bar")]
    assert state < 10


def test_reincarnations_in_stream_and_batch(spark, tmp_path):
    ddl = "id long, at timestamp, normalized_phone string, domain string, postal_code string"
    r = random.Random(2)
    make = lambda k: [(k * 1000 + i, f"2024-{r.randint(1, 9):02}-{r.randint(1, 28):02} 00:00:00", str(r.randint(0, 9)), f"d{r.randint(0, 9)}", r.choice(["", None, "1"])) for i in range(40)]
    rows = {k: make(k) for k in (0, 1)}
    for k in rows:
        written(spark, rows[k], ddl, f"{tmp_path}/{k}", "at")
    streams = [spark.readStream.schema(ddl).parquet(f"{tmp_path}/{k}") for k in rows]
    drained(monitoring.reincarnations(*streams, "30 days").writeStream.format("memory").queryName("again").outputMode("append").start())
    got = {(x["removed_id"], x["business_id"], x["shared"]) for x in spark.table("again").collect()}
    whole = monitoring.reincarnations(*[spark.read.parquet(f"{tmp_path}/{k}") for k in rows], "30 days")
    assert {(x["removed_id"], x["business_id"], x["shared"]) for x in whole.collect()} == got
    days = lambda t: int(t[5:7]) * 31 + int(t[8:10])
    phones = {(a[0], b[0]) for a in rows[0] for b in rows[1] if a[2] == b[2] and 0 < days(b[1]) - days(a[1]) <= 28}
    assert phones <= {(a, b) for a, b, shared in got if shared == "phone"} and phones


def test_rates_in_batch(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 03:00:00", "b", 1.0)], "user_id long, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value")
    assert {(r["event_type"], r["n"]) for r in monitoring.rates(e).collect()} == {("a", 2), ("b", 1)}
    assert monitoring.sessions(e).count() == 3


def test_snapshots_go_to_the_state_in_chunks():
    """A business of many snapshots costs few calls of the state, and all of them are compared, whichever chunk holds them."""
    from pyspark.sql import Row

    class State(list):
        calls = 0

        def get(self):
            return list(self)

        def appendValue(self, value):  # noqa: N802
            State.calls += 1
            self.append(value)

        def put(self, values):
            self[:] = values

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        timers = set()
        getListState = staticmethod(lambda *_: State())  # noqa: N815
        getValueState = staticmethod(lambda *_: Value())  # noqa: N815
        registerTimer, deleteTimer = timers.add, timers.remove  # noqa: N815

    class Until:
        getCurrentWatermarkInMs = staticmethod(lambda: 3_000)  # noqa: N815

    made = monitoring.Changes(["name"], 10**12)
    made.init(Handle())
    n = 4 * monitoring.CHUNK
    rows = [Row(business_id=1, us=k * 1_000, tie=0, name=str(k)) for k in range(1, n + 1)]
    random.Random(3).shuffle(rows)
    assert not list(made.handleInputRows((1,), iter(rows[:100]), None)) and not list(made.handleInputRows((1,), iter(rows[100:]), None))
    assert State.calls <= 6 and Handle.timers == {1}
    events = list(made.handleExpiredTimer((1,), Until, None))
    assert [(e.us, e.previous_val, e.new_val) for e in events] == [(k * 1_000, str(k - 1), str(k)) for k in range(2, 3_001)]
    assert sum(len(c[0]) for c in made.waiting) == n - 3_000 and 3_001 in Handle.timers
