"""Connected components by randomised contraction.

Every round maps each vertex to the neighbour (or itself) of least rank, rank being a
hash that changes with the round, and rewrites the edges between those images. A round
removes a constant share of the vertices in expectation, whatever the shape of the graph
(chains in id order included), so rounds grow with the logarithm of the largest
component. The maps of the rounds are unwound backwards at the end; their sizes fall
geometrically, so the whole costs a constant number of passes over the edges.
Once at most `SMALL` edges are left, one task finishes them, whatever their shape: a
bounded number of rows, mostly after one or two rounds, instead of several more rounds.
Everything else is grouping by min (combined before the shuffle) and equi-joins that adaptive
execution can split when a vertex is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.storage import checkpointed


#: Edges (16 bytes each) that one task takes at most.
SMALL = 200_000


def _finished(live: DataFrame) -> DataFrame:
    """(id, up) of the vertices of a bounded number of edges: up is the least id reachable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "up"])

    return live.select("a", "b").repartition(1).mapInArrow(run, "id long, up long")


def connected_components(edges: DataFrame, max_rounds: int = 64, small: int = SMALL) -> DataFrame:
    """(id, component) for each endpoint of edges(a, b): the least id reachable.

    Ids are longs. Null endpoints are left out, self-loops give singletons, repeated
    edges count once, an empty table gives an empty result.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct()
    vertices_alone = both.where("a = b").select(F.col("a").alias("id"))
    live = checkpointed(both.where("a <> b"))
    maps: list[DataFrame] = []
    for step in range(max_rounds):
        left = live.count()
        if not left:
            break
        if left <= small:
            maps.append(checkpointed(_finished(live)))
            break
        ranked = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("rank"), c.alias("id"))
        arcs = live.select(F.col("a").alias("id"), ranked(F.col("b")).alias("to")).union(
            live.select(F.col("b").alias("id"), ranked(F.col("a")).alias("to"))
        )
        image = checkpointed(
            arcs.groupBy("id").agg(F.min("to").alias("to"))
            .select("id", F.least("to", ranked(F.col("id"))).getField("id").alias("up"))
        )
        maps.append(image)
        live = checkpointed(
            live.join(image.select(F.col("id").alias("a"), F.col("up").alias("a2")), "a")
            .join(image.select(F.col("id").alias("b"), F.col("up").alias("b2")), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .where("a <> b").distinct()
        )
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return vertices_alone.select("id", F.col("id").alias("component")).distinct()
    roots = maps[-1].select("id", F.col("up").alias("root"))
    for image in reversed(maps[:-1]):
        over = roots.select(F.col("id").alias("up"), "root")
        roots = image.join(over, "up", "left").select("id", F.coalesce("root", "up").alias("root"))
    roots = checkpointed(roots)
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    found = roots.join(least, "root").select("id", "component")
    alone = vertices_alone.join(found.select("id"), "id", "left_anti").distinct()
    return found.union(alone.select("id", F.col("id").alias("component")))
