"""Links and duplicates of hot keys: tiles, one business's neighbourhood, counts without pairs, recurrence within a time."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import linkage

PROFILES = "id long, address string, phone string, website string, official_branch boolean"


def invented(seed, n):
    r = random.Random(seed)
    pick = lambda xs, none=0.2: None if r.random() < none else r.choice(xs)
    return [(k, pick(["Laan 1", "Laan 2", "Weg 3"]), pick(["020 1111111", "020 2222222"]), pick(["https://a.nl", "b.nl", "www.a.nl"]), pick([True, False], 0.1)) for k in range(n)]


def alike(x, y):
    same = sum(x[k] is not None and x[k] == y[k] for k in (1, 2, 3))
    return same >= 2 and not ((x[4] or y[4]) and x[1] is not None and y[1] is not None and x[1] != y[1])


def test_duplicate_counts_equal_pairs(spark):
    rows = invented(2, 90)
    host = lambda w: None if w is None else w.removeprefix("https://").removeprefix("www.")
    plain = [(i, a, p, host(w), bool(b)) for i, a, p, w, b in rows]
    met = [(x[0], y[0]) for x, y in combinations(plain, 2) if alike(x, y)]
    want = Counter(i for pair in met for i in pair)
    df = spark.createDataFrame([*rows, rows[3]], PROFILES)
    got = {r["id"]: r["matches_count"] for r in linkage.duplicates(df).collect()}
    assert got == dict(want) and len(want) > 40
    assert {tuple(r) for r in linkage.duplicate_pairs(df).collect()} == set(met)
    assert linkage.duplicates(df.limit(0)).count() == 0 and linkage.duplicate_pairs(df.limit(0)).count() == 0


def test_a_key_that_half_the_table_shares_costs_no_pairs(spark):
    """50,000 profiles of one address and phone: 2.5 thousand million pairs, counted from a few rows."""
    n = 100_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "Laan 1").otherwise(F.concat(F.lit("Weg "), "id")).alias("address"), F.when(F.col("id") % 2 == 0, "0201111111").otherwise(F.col("id").cast("string")).alias("phone"), F.lit(None).cast("string").alias("website"), F.lit(False).alias("official_branch"))
    assert [tuple(r) for r in linkage.duplicates(rows).groupBy("matches_count", "score").count().collect()] == [(n // 2 - 1, 100, n // 2)]


@pytest.mark.parametrize("tile", [1, 3, 7, 2048])
def test_tiles_give_every_pair_once(spark, tile):
    rows = [(k, "T", "hot") for k in range(23)] + [(k, "T", f"k{k % 4}") for k in range(9)] + [(k, "U", "hot") for k in range(2)] + [(5, "T", "hot"), (99, "T", "alone")]
    keyed = spark.createDataFrame(rows, "id long, type string, key string")
    want = sorted({(t, k, a, b) for t, k in {(t, k) for _, t, k in rows} for a, b in combinations(sorted({i for i, t2, k2 in rows if (t2, k2) == (t, k)}), 2)})
    assert sorted(map(tuple, linkage.pairs(keyed, tile).collect())) == want
    assert sorted((r["relationship_type"], r["source_business_id"], r["target_business_id"]) for r in linkage.edges(keyed, tile=tile).collect()) == sorted({(t, a, b) for t, _, a, b in want})


def test_no_task_holds_more_than_two_parts_of_a_hot_key(spark):
    keyed = spark.range(5_000).select("id", F.lit("T").alias("type"), F.lit("hot").alias("key"))
    tile = 250
    found = linkage.pairs(keyed, tile)
    assert found.count() == 5_000 * 4_999 // 2
    sizes = keyed.groupBy(F.pmod(F.xxhash64("id"), F.lit(20))).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * tile


def test_the_neighbourhood_of_one_business(spark):
    r = random.Random(1)
    keyed = spark.createDataFrame([(r.randint(1, 30), r.choice("TU"), r.choice("abcdef")) for _ in range(90)], "id long, type string, key string")
    for kinds in (None, ["T"]):
        every = linkage.edges(keyed, kinds).where("source_business_id = 7 OR target_business_id = 7")
        assert sorted(map(str, linkage.neighbourhood(keyed, 7, kinds).collect())) == sorted(map(str, every.collect()))
    assert linkage.neighbourhood(keyed, 999).count() == 0


def test_recurrence_within_a_time(spark):
    r = random.Random(7)
    make = lambda k: [(k + i, r.choice([None, r.randint(0, 400)]), r.choice(["1", "2", "", None]), r.choice(["a.nl", None]), r.choice(["1000 AA", None, "1000 AB"])) for i in range(60)]
    gone, new = make(0), make(30)
    as_df = lambda rows: spark.createDataFrame(rows, "id long, s long, normalized_phone string, domain string, postal_code string").withColumn("at", F.timestamp_seconds("s"))
    got = {(x["removed_id"], x["candidate_id"]): (x["waited_us"], x["shared_phone"], x["shared_domain"], x["shared_postal"]) for x in linkage.recurrence_within(as_df(gone), as_df(new), 60).collect()}
    want = {}
    for a in gone:
        for b in new:
            same = [bool(a[k]) and a[k] == b[k] for k in (2, 3, 4)]
            if a[0] != b[0] and None not in (a[1], b[1]) and 0 < b[1] - a[1] <= 60 and any(same):
                want[a[0], b[0]] = ((b[1] - a[1]) * 1_000_000, *same)
    assert got == want and len(want) > 50
    assert "NestedLoop" not in linkage.recurrence_within(as_df(gone), as_df(new), 60)._jdf.queryExecution().toString()  # noqa: SLF001


def test_full_width_names_have_the_brand_of_plain_ones(spark):
    df = spark.createDataFrame([("Ａｃｍｅ　Ｂｏｕｗ　Ｂ．Ｖ．",), ("Acme Bouw B.V.",), (None,)], "n string")
    assert [r[0] for r in df.select(linkage.brand(F.col("n"))).collect()] == ["Acme Bouw", "Acme Bouw", ""]


@pytest.mark.parametrize("tile", [2, 2048])
def test_recurrence_of_ids_in_several_rows(spark, tile):
    r = random.Random(3)
    make = lambda n: [(r.randint(0, 25), r.choice(["1", "2", "", None]), r.choice(["a.nl", None, "b.nl"]), r.choice(["1000 AA", None, "1000 AB"])) for _ in range(n)]
    gone, new = make(30), make(40)
    want = {}
    for a in gone:
        for b in new:
            same = [bool(a[k]) and a[k] == b[k] for k in (1, 2, 3)]
            if a[0] != b[0] and any(same):
                want[a[0], b[0]] = tuple(x or y for x, y in zip(want.get((a[0], b[0]), (False,) * 3), same, strict=True))
    as_df = lambda rows: spark.createDataFrame(rows, "id long, normalized_phone string, domain string, postal_code string")
    got = sorted(tuple(x) for x in linkage.recurrence(as_df(gone), as_df(new), tile).collect())
    assert got == sorted((*k, *v) for k, v in want.items()) and len(want) > 100


def _exchanges_over(df):
    """Names of what stands above the last join of a plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString()  # noqa: SLF001
    return plan[: plan.index("Join")]


def test_pairs_are_not_shuffled_again(spark):
    """A pair comes once where it is met: no grouping of all pairs follows the join."""
    keyed = spark.createDataFrame([(k, "T", x) for k in range(9) for x in ("p", "q")], "id long, type string, key string")
    assert {r["shared_key"] for r in linkage.edges(keyed, tile=4).collect()} == {"p"} and linkage.edges(keyed, tile=4).count() == 36
    biz = spark.createDataFrame([(k, "1", "a.nl", "1000 AA") for k in range(9)], "id long, normalized_phone string, domain string, postal_code string")
    timed = biz.withColumn("at", F.timestamp_seconds("id"))
    for found in (linkage.edges(keyed), linkage.recurrence(biz, biz), linkage.recurrence_within(timed, timed, 60)):
        assert "Aggregate" not in _exchanges_over(found)


def test_star_edges_make_the_keys_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(i):
        made.add(1)
        return str(i % 3)

    keyed = spark.range(30).select("id", F.lit("K").alias("type"), key("id").alias("key"))
    assert linkage.star_edges(keyed).count() == 27
    assert made.value == 30


def _timed(spark, n):
    return spark.range(n).select("id", F.timestamp_seconds("id").alias("at"), F.lit("1").alias("normalized_phone"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("postal_code"))


def test_recurrence_within_shuffles_a_row_once(spark):
    """One exchange a side in the whole plan: what is dealt comes by broadcast."""
    timed = _timed(spark, 9)
    plan = linkage.recurrence_within(timed, timed, 60)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_hot_key_of_recurrence_is_dealt_over_tasks(spark):
    """A key of 2,000 rows, less than a full tile, would be one task with all four million pairs."""
    biz = _timed(spark, 2_000).drop("at")
    shares = [r["count"] for r in linkage.recurrence(biz, biz).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 2_000 * 1_999 and max(shares) < 3_000_000
