"""Embedding near-duplicates through spherical-cap filters with random product codes.

Each of `codes` product codes has a random rotation and cuts a unit vector into two
sub-vectors, with `directions` random code directions each; every combination of one
direction a block is a filter direction: directions^2 of them a code, never written out.
A vector is list-decoded to all filters whose inner product with it exceeds the cap's
threshold: a block's scores are bounded by the best of the other block, and only
combinations that can reach the threshold are formed. Vectors that meet in a filter are
verified in double precision. The threshold leaves a random vector in `per_vector`
filters of a code on average; the number of filters of a code follows the number of
vectors, so chance meetings per vector stay constant as the table grows.

Exact copies are grouped first and decoded once. A filter with more than `tile` members
is split into tiles, each pair of tiles a group of its own, so that no task holds an
unbounded group and no pair is left out. Pairs are counted where they are verified, not
emitted: each vector carries the list of its filters, a pair counts only in the first
filter that its vectors share, and what leaves a filter is one row a vector (its number
of links there, and the least member of its component there).

Cases: null, empty and zero vectors, and those with null or non-finite components, link
with nothing. Vectors of different lengths are never compared. A null vec_id links with
nothing and has a null component. Repeated rows are vectors like any other: they link
with each other. Rows may share a vec_id, whatever their vectors. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.components import connected_components
from ledgerlens.plans.storage import checkpointed

COSINE = 0.9
CODES = 12
PER_VECTOR = 3.0
TILE = 1024


def directions_for(n: int) -> int:
    """Code directions a block: about one filter of a code a vector."""
    return max(64, math.ceil(math.sqrt(n)))


@lru_cache(maxsize=64)
def code(number: int, dim: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation (padded to two equal blocks) and the unit directions of each block."""
    rng = np.random.default_rng([number, dim, directions])
    width = -(-dim // 2)
    turn = np.linalg.qr(rng.standard_normal((2 * width, 2 * width)))[0][:dim]
    arms = rng.standard_normal((2, directions, width))
    return turn, arms / np.linalg.norm(arms, axis=2, keepdims=True)


@lru_cache(maxsize=64)
def threshold(dim: int, directions: int, per_vector: float) -> float:
    """The inner product that a random unit vector exceeds in per_vector filters of a code.

    Measured on random vectors: the tail of a product code is thinner than a normal one.
    """
    rng, turn_arms = np.random.default_rng([dim, directions]), code(0, dim, directions)[1]
    width, tries = turn_arms.shape[2], int(max(8, min(200, 8_000_000 // directions**2)))
    best = []
    for x in rng.standard_normal((tries, 2 * width)):
        x /= np.linalg.norm(x)
        s = (turn_arms[0] @ x[:width])[:, None] + (turn_arms[1] @ x[width:])[None, :]
        best.append(np.partition(s.ravel(), -min(s.size, 400))[-400:])
    flat = np.sort(np.concatenate(best))[::-1]
    return float(flat[min(len(flat) - 1, int(per_vector * tries))])


def decode(unit: np.ndarray, number: int, directions: int, per_vector: float = PER_VECTOR) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters of a code that rows of unit vectors exceed."""
    turn, arms = code(number, unit.shape[1], directions)
    width = arms.shape[2]
    least = threshold(unit.shape[1], directions, per_vector)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(unit), 512):
        part = unit[at : at + 512] @ turn
        head, tail = part[:, :width] @ arms[0].T, part[:, width:] @ arms[1].T
        row, i = np.nonzero(head >= least - tail.max(axis=1, keepdims=True))
        floor = least - head[row, i]
        order = np.argsort(-tail, axis=1, kind="stable")
        falling = -np.take_along_axis(tail, order, axis=1)
        depth = 0
        while len(row):  # the k-th best tails of the heads that still reach the threshold
            row, i, floor = (x[go] for go in [(falling[row, depth] <= -floor)] for x in (row, i, floor))
            rows.append(row + at)
            found.append(i.astype(np.int64) * directions + order[row, depth])
            depth += 1
            if depth == directions:
                break
    return np.concatenate(rows), np.concatenate(found)


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])


def _resolved(filter_: int, tile: np.ndarray, unit: np.ndarray, copies: np.ndarray, filters: list[np.ndarray], cosine: float) -> tuple[np.ndarray, ...]:
    """(rows, linked copies, row of the component's least member) of a filter's new links.

    tile: where members stand; of two tiles, only pairs across them are compared.
    """
    near = unit @ unit.T >= cosine
    if tile.min() != tile.max():
        near &= tile[:, None] != tile[None, :]
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(rows, rows)]
    if len(rows):
        before = [f[: np.searchsorted(f, filter_)] for f in (filters[i] for i in rows)]
        value, column, count = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), [len(f) for f in before])
        shared = np.flatnonzero(count > 1)
        place = np.searchsorted(shared, column)
        for at in range(0, len(shared), 2048):  # pairs that met in an earlier filter are counted there
            here = (count[column] > 1) & (place >= at) & (place < at + 2048)
            holds = np.zeros((len(rows), min(2048, len(shared) - at)), np.float32)
            holds[owner[here], place[here] - at] = 1
            near &= holds @ holds.T < 0.5
    label = np.arange(len(rows))
    while len(rows):
        least = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(near.any(axis=1)) if len(rows) else rows
    return rows[some], (near @ copies[rows])[some] if len(rows) else rows, rows[label[some]]


def links(vectors: DataFrame, cosine: float = COSINE, per_vector: float = PER_VECTOR, codes: int = CODES, tile: int = TILE) -> DataFrame:
    """(rep, others, root) of distinct vectors(rep, embedding, copies), over the filters they meet in.

    The sum of others is the number of copies of other vectors of cosine or more; the
    pairs (rep, root) have the components of those links.
    """
    directions = directions_for(vectors.count())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    x = values[starts[part][:, None] + np.arange(dim)]
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    found = [(row, (where * codes + number) * 65_536 + dim) for number in range(codes) for row, where in [decode(unit, number, directions, per_vector)]]
                    row, spot = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.lexsort((spot, row))
                    edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(edge), pa.array(spot[order].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), batch.column(2).take(pa.array(part)), listed], ["rep", "vector", "copies", "filters"])

    kind = dict(vectors.dtypes)["embedding"]
    held = checkpointed(vectors.select("rep", "embedding", "copies").mapInArrow(decoded, f"rep long, vector {kind}, copies long, filters array<long>"))
    placed = held.select("rep", F.explode("filters").alias("filter"))
    sizes = placed.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("rep"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    tiled = (
        placed.join(sizes, "filter").withColumns({"tiles": tiles, "own": own}).withColumn("pair", F.explode(pairs))
        .select("filter", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "own", "rep").join(held, "rep")
    )
    key = ["filter", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            own_, ids, copies = (t.column(c).to_numpy() for c in ("own", "rep", "copies"))
            (values, starts), (filters, from_) = (
                (x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])) for x in (t.column(c).combine_chunks() for c in ("vector", "filters"))
            )
            edge = _runs(keys)
            for at, to in zip(edge[:-1], edge[1:], strict=True):
                if to - at > 1:
                    x = values[starts[at] : starts[to]].reshape(to - at, -1).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    tile_ = own_[at:to] if keys[at, 1] != keys[at, 2] else np.zeros(to - at, np.int64)
                    rows, others, root = _resolved(keys[at, 0], tile_, x, copies[at:to], [filters[from_[i] : from_[i + 1]] for i in range(at, to)], cosine)
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + rows]), pa.array(others.astype(np.int64)), pa.array(ids[at + root])], ["rep", "others", "root"])

        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            t = pa.Table.from_batches(wait)
            keys = np.stack([t.column(c).to_numpy() for c in key], axis=1)
            cut = _runs(keys)[-2]  # the last group may go on in the next batch
            if cut:
                yield from solved(t.slice(0, cut), keys[:cut])
                wait = t.slice(cut).combine_chunks().to_batches()
        if wait:
            t = pa.Table.from_batches(wait)
            yield from solved(t, np.stack([t.column(c).to_numpy() for c in key], axis=1))

    return tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "rep long, others long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, per_vector: float = PER_VECTOR, codes: int = CODES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & ~F.exists("embedding", odd) & (length > 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    grouped = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    copies = checkpointed(grouped.withColumn("rep", F.monotonically_increasing_id()))  # numbers hold once written
    found = checkpointed(links(copies.select("rep", "embedding", "copies"), cosine, per_vector, codes, tile).groupBy("rep", "root").agg(F.sum("others").alias("others")))
    linked = found.groupBy("rep").agg(F.sum("others").alias("others"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "rep"})
    classes = (
        copies.join(linked, "rep", "left").join(component, "rep", "left")
        .select("embedding", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    )
    classes = checkpointed(classes)
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    groups = classes.join(named, "class").select("embedding", "n_links", "component_id")
    named = rows.where("sound").join(groups, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = named.union(alone)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
