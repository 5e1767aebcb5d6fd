"""Incremental networks against full recomputation, and the inheritance of codes."""

from __future__ import annotations

import random

import pytest

from ledgerlens.operators import identity

EDGES = "a long, b long"


def plain_components(edges, ids=()):
    up = {i: i for i in ids}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in list(up)}


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["component"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_delta_gives_what_all_links_give(spark, seed):
    r = random.Random(seed)
    edges = list({tuple(sorted((r.randint(1, 120), r.randint(1, 120)))) for _ in range(70)})
    removed = r.sample(edges, 15)
    added = [(r.randint(0, 140), r.randint(1, 140)) for _ in range(20)] + [(7, 7), (5, 5), *removed[:2]]
    labels = plain_components(edges)
    make = lambda rows: spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in rows] + [(None, 3)], EDGES)
    stored = spark.createDataFrame([(i, c, "x") for i, c in labels.items()], "id long, component long, a string")
    assert as_dict(identity.merged(stored, make(added))) == plain_components(edges + added)
    left = [e for e in edges if e not in removed] + [e for e in added if tuple(sorted(e)) not in removed]
    assert as_dict(identity.changed(stored, make(edges), make(added), make(removed))) == plain_components(left, labels)


def test_empty_deltas_and_empty_labels(spark):
    none, labels = spark.createDataFrame([], EDGES), spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    assert as_dict(identity.merged(labels, none)) == {1: 1, 2: 1}
    assert as_dict(identity.merged(labels.limit(0), spark.createDataFrame([(4, 3)], EDGES))) == {3: 3, 4: 3}
    assert as_dict(identity.changed(labels, spark.createDataFrame([(1, 2)], EDGES), none, spark.createDataFrame([(2, 1)], EDGES))) == {1: 1, 2: 2}


def test_codes_stay_under_merge_split_and_a_smaller_id(spark):
    before = {"NETWORK-00001": range(10, 15), "NETWORK-00002": range(20, 28), "NETWORK-00003": range(30, 36), "NETWORK-00007": range(40, 43)}
    now = {1: [1, 20, 21, 22, 23, 24], 25: [25, 26, 27], 10: [*range(10, 15), 40, 41, 42], 50: [50, 51]}
    old = spark.createDataFrame([(c, i) for c, ids in before.items() for i in ids], "code string, id long")
    new = spark.createDataFrame([(c, i) for c, ids in now.items() for i in ids], "component long, id long")
    coded, lineage = identity.inherited(old, new)
    assert {r["component"]: r["code"] for r in coded.collect()} == {1: "NETWORK-00002", 10: "NETWORK-00001", 25: "NETWORK-00008", 50: "NETWORK-00009"}
    assert {(r["code"], r["event"], r["other"]) for r in lineage.collect()} == {
        ("NETWORK-00002", "KEPT", None), ("NETWORK-00001", "KEPT", None), ("NETWORK-00007", "MERGED", "NETWORK-00001"), ("NETWORK-00003", "GONE", None),
        ("NETWORK-00008", "SPLIT", "NETWORK-00002"), ("NETWORK-00009", "NEW", None),
    }
    coded, lineage = identity.inherited(old.limit(0), new)
    assert [r["code"] for r in coded.orderBy("component").collect()] == [f"NETWORK-0000{k}" for k in range(1, 5)] and lineage.where("event <> 'NEW'").count() == 0
    assert identity.inherited(old, new.limit(0))[1].where("event = 'GONE'").count() == 4


def test_matching_goes_down_the_ranked_list(spark):
    r = random.Random(4)
    pairs = {(f"c{r.randint(0, 25):02}", r.randint(0, 25)): r.randint(1, 6) for _ in range(120)}
    got = identity.matched(spark.createDataFrame([(c, k, n) for (c, k), n in pairs.items()], "code string, component long, common long")).collect()
    codes, parts, want = set(), set(), set()
    for (c, k), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if c not in codes and k not in parts:
            codes.add(c)
            parts.add(k)
            want.add((c, k))
    assert {tuple(x) for x in got} == want and len(got) == len(want)
