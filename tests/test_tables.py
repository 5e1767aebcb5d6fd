"""Stored tables: changes, versions, conflicts and writers that die."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.readers import reference_list
from ledgerlens.sources.sinks import replace_partition
from ledgerlens.sources.tables import Conflict, StoredTable

DDL = "k long, v string, n int"


@pytest.fixture
def table(spark, tmp_path):
    t = StoredTable.created(spark, f"file://{tmp_path}/t", spark.createDataFrame([], DDL).schema, ["k"], 8)
    t.upsert(spark.createDataFrame([(k, f"v{k}", 0) for k in range(40)], DDL))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_equal_a_dictionary(spark, table):
    r, held = random.Random(3), {k: (f"v{k}", 0) for k in range(40)}
    for step in range(1, 5):
        new = {r.randint(0, 60): (f"s{step}", step) for _ in range(6)}
        if step == 3:
            new = {k: x for k, x in new.items() if k not in held}
            table.upsert(spark.createDataFrame([(k, *x) for k, x in [*new.items(), *((k, ("old", 9)) for k in (1, 2, 3) if k in held)]], DDL), replace=False)
        else:
            table.upsert(spark.createDataFrame([(k, *x) for k, x in new.items()], DDL))
        held |= new
        gone = r.sample(sorted(held), 3)
        table.delete(F.col("k").isin(*gone))
        held = {k: x for k, x in held.items() if k not in gone}
        assert rows(table.read()) == sorted([(k, *x) for k, x in held.items()], key=str)
    assert rows(table.read(1)) == sorted([(k, f"v{k}", 0) for k in range(40)], key=str) and table.versions() == list(range(10))


def test_only_touched_buckets_are_written(spark, table):
    before = table.manifest()["folders"]
    table.upsert(spark.createDataFrame([(3, "x", 1)], DDL))
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    version = table.manifest()["version"]
    assert table.upsert(spark.createDataFrame([], DDL)) == version and table.delete(F.col("k") == 999) == version


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, table, monkeypatch):
    want = rows(table.read())

    def dies(_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", dies)
        with pytest.raises(OSError, match="lost"):
            table.upsert(spark.createDataFrame([(3, "x", 1)], DDL))
    assert rows(table.read()) == want and table.versions() == [0, 1]
    assert len(table.dropped(keep=2)) == 1 and rows(table.read()) == want
    table.upsert(spark.createDataFrame([(3, "x", 1)], DDL))
    assert (3, "x", 1) in rows(table.read())
    assert len(table.dropped()) == 0 and table.versions() == [2]  # the first folder still holds the untouched buckets


def test_two_writers(spark, table):
    """The second takes over what the first did elsewhere, and gives way where both touched a bucket."""
    of = {k: spark.range(k, k + 1).select(F.pmod(F.xxhash64(F.col("id")), F.lit(8))).first()[0] for k in range(12)}
    a, same = next((x, y) for x in of for y in of if x < y and of[x] == of[y])
    other = next(k for k in of if of[k] != of[a])
    base, columns = table.manifest(), table.read().schema
    second = lambda k: table._written(table.read(base["version"], {of[k]}).withColumn("n", F.lit(7)), base)  # noqa: E731, SLF001
    mine, theirs = second(other), second(same)
    table.upsert(spark.createDataFrame([(a, "first", 1)], DDL))
    assert table._changed(base, {of[other]}, mine, columns) == 3  # noqa: SLF001
    found = {r["k"]: (r["v"], r["n"]) for r in table.read().collect()}
    assert found[a] == ("first", 1) and found[other] == (f"v{other}", 7) and len(found) == 40
    with pytest.raises(Conflict):
        table._changed(base, {of[a]}, theirs, columns)  # noqa: SLF001
    assert table.versions() == [0, 1, 2, 3]
    with pytest.raises(Conflict):
        StoredTable.created(spark, table.path, columns, ["k"])


def test_columns_come_and_types_stay(spark, table):
    table.upsert(spark.createDataFrame([(1, "x", "new")], "k long, v string, extra string"))
    got = {r["k"]: (r["v"], r["n"], r["extra"]) for r in table.read().where("k < 3").collect()}
    assert got == {0: ("v0", 0, None), 1: ("x", None, "new"), 2: ("v2", 0, None)}
    with pytest.raises(ValueError, match="column v is string"):
        table.upsert(spark.createDataFrame([(1, 2)], "k long, v int"))
    table.upsert(spark.createDataFrame([(None, "a", 1), (None, "b", 1)], DDL))
    assert table.read().where("k is null").count() == 1
    table.refresh(spark.createDataFrame([(5, "only", 1)], DDL))
    assert rows(table.read()) == [(5, "only", 1)] and table.read(1).count() == 40


def test_declared_tables(spark, tmp_path):
    t = StoredTable.declared(spark, f"file://{tmp_path}/networks", "networks")
    assert t.manifest()["keys"] == ["network_code"] and t.read().count() == 0
    with pytest.raises(ValueError, match="no version"):
        t.read(7)
    with pytest.raises(ValueError, match="no table"):
        StoredTable(spark, f"file://{tmp_path}/none").read()


def test_reference_lists(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"chains": ["Primera", "GLS Point"]}', encoding="utf-8")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    assert reference_list(spark, f"file://{tmp_path}/l.json", "chains") == ["primera", "gls point"]
    assert reference_list(spark, f"file://{tmp_path}/l.json", "none") == [] == reference_list(spark, f"file://{tmp_path}/gone.json", "chains")
    with pytest.raises(ValueError, match="Expecting"):
        reference_list(spark, f"file://{tmp_path}/bad.json", "chains")


def test_replaced_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "n int, c string").write.partitionBy("c").parquet(path)
    replace_partition(spark.createDataFrame([(9, "b"), (8, "d")], "n int, c string"), path, "c")
    assert sorted((r["n"], r["c"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (8, "d"), (9, "b")]
