"""SimHash near-duplicates through covering locality-sensitive hashing.

A text is lower-cased (A-Z only), split into words at the six ASCII white-space
characters and read as 3-word shingles; a fingerprint bit is the majority of that bit
over the shingles' XXH64 hashes (seed 42), repeats included.

Fingerprints within radius r are found with 2^(r+1) - 1 bit masks. Each of the 64 bit
positions gets a non-zero vector m(i) of r + 1 bits; mask v keeps the positions with
<m(i), v> = 1. The at most r positions in which two fingerprints differ span less than
the whole space, so some v is orthogonal to all of them and both agree under that mask:
every pair within the radius meets in some table, with certainty.

A bucket of a table is verified pair by pair while it is small. A bucket over
`pair_limit` distinct fingerprints is resolved exactly in linear work: two fingerprints
are within 2 bits iff a common third is within 1 bit of both, so each member is linked
with the 65 fingerprints around it instead of with the other members. Nothing is cut off.

Cases: null text counts as no words, as do empty texts: fingerprint zero, linked like any
other. Fewer than three words: the whole sequence is the shingle. Rows with a null doc_id
get a fingerprint and take part as bridges under no id: they never become component_id.
Repeated rows come back as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import documents
from ledgerlens.operators.components import connected_components
from ledgerlens.plans.storage import checkpointed

RADIUS = 2
PAIR_LIMIT = 64


def fingerprint(text: str | None, width: int = 3, chunk: int = 65_536) -> int:
    """The 64-bit fingerprint of one whole text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h, seed = xxhash.xxh64_intdigest, 42
    if len(words) < width:
        return int(np.array([h(b" ".join(words), seed)], dtype=np.uint64).view(np.int64)[0])
    total, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for start in range(0, n, chunk):
        end = min(n, start + chunk)
        columns = [words[start + k : end + k] for k in range(width)]
        hashes = np.fromiter((h(b" ".join(x), seed) for x in zip(*columns, strict=True)), dtype="<u8", count=end - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * total > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks as signed 64-bit integers."""
    space = 1 << (radius + 1)
    assigned = [1 + i % (space - 1) for i in range(bits)]
    masks = []
    for v in range(1, space):
        mask = sum(1 << i for i, m in enumerate(assigned) if bin(m & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def links(prints: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of the
    relation "at most `radius` bits apart". prints(fp) holds each fingerprint once.

    Edges are verified pairs, or, out of crowded buckets, stars around a fingerprint
    (present or not) within one bit of all its members.
    """
    if radius != 2:
        pair_limit = 2**31  # the one-bit neighbourhood argument is for radius 2
    masks = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(m).alias("m")) for k, m in enumerate(covering_masks(radius))])
    keyed = prints.select("fp", F.explode(masks).alias("t")).select(
        "fp", F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key")
    )
    sizes = keyed.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = checkpointed(keyed.join(sizes, ["v", "key"]))
    small = placed.where(F.col("n") <= pair_limit)
    left = small.select("v", "key", F.col("fp").alias("a"))
    right = small.select("v", "key", F.col("fp").alias("b"))
    pairs = (
        left.join(right, ["v", "key"]).where("a < b")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    )
    around = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = (
        placed.where(F.col("n") > pair_limit).select("fp").distinct()
        .select("fp", F.explode(around).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    )
    hubs = near.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "a")
    stars = near.join(hubs, "hub").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable."""
    rows = checkpointed(fingerprints(docs, width))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(prints.select("fp"), radius, pair_limit)).withColumnsRenamed({"id": "fp"})
    classes = prints.join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class"))
    least = classes.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = classes.join(least, "class").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


#: The pipeline's stage takes, beside op5's fingerprints, five-word shingles and exact Jaccard similarity.
STAGE_WIDTH, SIMILARITY = 5, 0.8
#: Min-wise bands that propose candidates: a pair at 0.8 shares one with probability 1 - (1 - 0.8^4)^20 = 0.99997.
BANDS, BAND_ROWS = 20, 4
#: Members of a block that one task compares at a time.
TILE = 512
#: So many ids (8 MB) are broadcast at most; beyond, joins shuffle.
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(5)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: str | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """The distinct shingle hashes of one whole text, rising; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    columns = [words[k : n + k] for k in range(min(width, len(words)))]
    return np.unique(np.fromiter((h(b" ".join(x), 42) for x in zip(*columns, strict=True)), dtype=np.uint64, count=n))


def band_keys(shingles: np.ndarray, chunk: int = 8_192) -> np.ndarray:
    """BANDS keys of BAND_ROWS min-wise hashes each."""
    least = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), chunk):
        x = shingles[None, at : at + chunk] * _FACTOR[:, None] + _SHIFT[:, None]
        least = np.minimum(least, x.min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), 42) for r in rows], np.uint64).view(np.int64)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, v (names the shingle set), size, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            v = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64)
            bands = pa.array([band_keys(x) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v), pa.array([len(x) for x in found], pa.int64()), bands], ["doc_id", "v", "size", "bands"])

    return documents(docs).mapInArrow(run, "doc_id long, v long, size long, bands array<long>")


def _linked(sets: list[np.ndarray], side: np.ndarray, similarity: float, width: int = 4_096) -> np.ndarray:
    """The place of each set's least component member, by pairs of that similarity; sides 1 and 2 are compared with one another only, 0 with all."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set is in no intersection
    kept = count[column] > 1
    owner, column = owner[kept], shared[column[kept]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        here = slice(*np.searchsorted(column, [at, at + width]))
        holds = np.zeros((len(sets), width), np.float32)
        holds[owner[here], column[here] - at] = 1
        both += holds @ holds.T
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 0)
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(sets)).min(axis=1))
        if (least == label).all():
            return label
        label = least


def _blocks(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, v, root) of members(bucket, i, j, side, v): root is the least member that v is joined to in its block (bucket, i, j).

    A block holds a bounded number of members and leaves one row for each of them; pairs are never written out.
    """
    key = ["bucket", "i", "j"]

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([(c, "ascending") for c in [*key, "v"]])
        keys = np.stack([t.column(c).to_numpy() for c in key], axis=1)
        v, side, bucket = (t.column(c).to_numpy() for c in ("v", "side", "bucket"))
        found, edge = t.column("shingles").to_pylist(), np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        root = np.empty(len(v), np.int64)
        for at, to in zip(edge[:-1], edge[1:], strict=True):
            root[at:to] = v[at:to][_linked([np.frombuffer(x, np.uint64) for x in found[at:to]], side[at:to], similarity)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(v), pa.array(root)], ["bucket", "v", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            wait.append(batch)
            t = pa.Table.from_batches(wait)
            last = [t.column(c)[-1] for c in key]  # the last block may go on in the next batch
            ended = np.flatnonzero(np.any([t.column(c).to_numpy() != x.as_py() for c, x in zip(key, last, strict=True)], axis=0))
            if len(ended):
                yield from solved(t.slice(0, ended[-1] + 1))
                wait = t.slice(ended[-1] + 1).combine_chunks().to_batches()
        if wait:
            yield from solved(pa.Table.from_batches(wait))

    return members.join(sets, "v").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "bucket long, v long, root long")


def _few(ids: DataFrame) -> DataFrame:
    """ids (checkpointed), to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def near_copies(docs: DataFrame, width: int = STAGE_WIDTH, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) of the relation "Jaccard similarity of the shingle sets at least `similarity`".

    Equal sets are one vertex. Vertices that share a band are candidates, all of them, and
    are verified exactly; buckets with the same members count once. A bucket is dealt into
    blocks of about `tile` members, each with the bucket's least member, so a large group
    of near copies is mostly joined through that one, in linear work. In a bucket of
    several blocks, members outside its largest part are then compared with all of it,
    tile by tile: exact, in blocks of bounded size, at most quadratic in the members that
    are similar to the rest but not near copies of it.
    """
    rows = checkpointed(_sketches(docs, width))
    prints = checkpointed(rows.groupBy("v").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")))
    keyed = prints.select("v", F.posexplode("bands").alias("band", "key"))
    members = [F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.bit_xor("v").alias("x"), F.bit_xor(F.xxhash64("v")).alias("y")]
    buckets = keyed.groupBy("band", "key").agg(*members).where("n > 1").groupBy("n", "least", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"))
    buckets = checkpointed(buckets.select("b.*", "n", "least", F.monotonically_increasing_id().alias("bucket")))
    placed = checkpointed(keyed.join(buckets, ["band", "key"]).select("bucket", "v", (F.col("v") == F.col("least")).alias("head"), F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    wanted = placed.select("v").distinct()
    ids = checkpointed(prints.join(wanted, "v").select(F.col("rep").alias("doc_id")).dropna())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            v = np.array([xxhash.xxh64_intdigest(x, 42) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(found, pa.binary())], ["v", "shingles"])

    texts = documents(docs)
    chosen = texts.join(_few(ids), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    sets = checkpointed(chosen.mapInArrow(hashed, "v long, shingles binary").join(wanted, "v", "left_semi").dropDuplicates(["v"]))
    part = lambda c, n, salt: F.pmod(F.xxhash64(F.lit(salt), c), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    spread = F.when(F.col("head"), every(F.col("tiles"))).otherwise(F.array(part("v", F.col("tiles"), 1)))
    first = checkpointed(_blocks(placed.select("bucket", F.explode(spread).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "v"), sets, similarity))
    edges = first.where("v <> root").select(F.col("root").alias("a"), F.col("v").alias("b"))
    crowded = placed.where("tiles > 1").select("bucket").distinct()
    if not crowded.isEmpty():
        parts = checkpointed(first.join(crowded, "bucket", "left_semi").groupBy("bucket", "v").agg(F.min("root").alias("root")))
        sizes = parts.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
        main = checkpointed(main.where("n > most").select("bucket", "main", F.ceil(F.col("n") / tile).cast("int").alias("js"), F.ceil((F.col("n") - F.col("most")) / tile).cast("int").alias("is")))
        whole = parts.join(main, "bucket")
        left = whole.where("root <> main").select("bucket", part("v", F.col("is"), 2).alias("i"), F.explode(every(F.col("js"))).alias("j"), F.lit(1).alias("side"), "v")
        right = whole.select("bucket", F.explode(every(F.col("is"))).alias("i"), part("v", F.col("js"), 3).alias("j"), F.lit(2).alias("side"), "v")
        crossed = _blocks(left.unionByName(right), sets, similarity).where("v <> root")
        edges = edges.unionByName(crossed.select(F.col("root").alias("a"), F.col("v").alias("b")))
    found = connected_components(edges).withColumnsRenamed({"id": "v"})
    classes = prints.join(found, "v", "left").select("v", "rep", F.coalesce("component", "v").alias("class"))
    least = classes.groupBy("class").agg(F.min("rep").alias("component_id"))
    return rows.join(classes.join(least, "class").select("v", "component_id"), "v").select("doc_id", "component_id")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of both relations together: fingerprints at most RADIUS bits apart (near_duplicates), or similar
    five-word shingle sets (near_copies), in any order of steps, a row for every row.

    Rows with a null doc_id bridge within each relation, not from one to the other, and have a null component_id. Rows that repeat a doc_id are of one group.
    """
    copies = checkpointed(near_copies(docs))
    each = near_duplicates(docs).select("doc_id", "component_id").unionByName(copies).where("doc_id <> component_id")
    joined = connected_components(each.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")))
    return copies.select("doc_id").join(joined.withColumnsRenamed({"id": "doc_id", "component": "component_id"}), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stand for their group, one of each; all columns stay.

    Groups are the given (doc_id, component_id), or those of near_copies: five-word shingles at a similarity of 0.8 or more.
    Rows with a null doc_id have no group of their own and stay. Rows that repeat a
    doc_id are the same document: it stays if it names the group of one of them, as the
    row whose text sorts first.
    """
    own = F.col("doc_id") == F.col("component_id")
    named = (near_copies(docs) if grouped is None else grouped).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    judged = checkpointed(named.agg(F.max(own).alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"))
    id_ = docs["doc_id"].cast("long")
    odd, often = judged.select("__id"), judged.where("stays").select("__id")
    single = docs.join(_few(odd), id_ == F.col("__id"), "left_anti")  # null ids match nothing and stay
    several = docs.join(_few(often), id_ == F.col("__id"), "left_semi").groupBy(id_.alias("__id"))
    first = several.agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("row"))
    return single.unionByName(first.select("row.*"))
