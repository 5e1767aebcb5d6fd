"""Language-model scores by online logistic context mixing.

A token (a word, or the end of a text) is coded bit by bit in two parts. First its cell:
the leading `bits` bits of its hash, enough to tell the vocabulary's words apart, each bit
predicted in three hashed contexts: the bits so far alone, with the token before, and with
the two tokens before. A predictor's state is the number of zeros and ones that the
training tokens of the whole corpus showed there. Their stretched probabilities are
combined by logistic mixing whose weights are gated, chosen by
how much either of the longer contexts has seen; where neither has seen anything, the first predictor stands alone.
Coding is online, predict and then learn:
a batch of tokens is coded by the weights that the batches before it have left, then the
weights learn from it; and the token itself is taken out of every state that codes it, once:
what a training text repeats is still coded by its other occurrences. The mixed
probability is refined adaptively by an error table learned online over (confidence,
probability). Then the word within its cell: by its count in the training texts, or, where
no other training token holds it, spelled byte by byte, with the same kind of gated and
refined online mixing over hashed contexts of the last 1, 2, 3 and 5 bytes. Within each
text the total is refined as the text is read, by online Bayesian mixing of these
predictions with caches of the text's own tokens in several strengths.

How it is spread out: each task cuts its texts into chunks of about `CHUNK_TOKENS` tokens
and writes them once, as numbers into the chunk's dictionary of words. Words go to shards by hash, distinct token triples to shards by the token before (for a
frequent one also by a hash class of the token before that, so that no shard is hot); what
is moved are packed arrays. A word shard counts its words over the corpus; a triple shard
holds all triples of its contexts, so its states are exact counts of contexts that are hashed: the token
before to 32 bits, the one before that to 12, the token itself to its cell, of which there are 2^20 at most. It learns its own weights and codes every distinct triple once. What
is gathered grows with the corpus: words, counts, triples, and the number of shards. Only
three things are broadcast: counts of the cells (2^`MOST_BITS` at most), the spelling
model (fixed tables of byte contexts) and the frequent tokens, those with over half a
shard of occurrences.

Cases: null texts are empty: one end token. Rows with a null doc_id are scored and train
the model as not held out. Repeated rows count as often as they occur. No training tokens
leave uniform bits. Extra columns are ignored. bits_per_byte is null for a text without bytes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.storage import checkpointed, removed, shared_dir

CHUNK_TOKENS, PIECE_TOKENS = 2_000_000, 100_000
SHARD_WORDS, SHARD_TOKENS = 400_000, 1_500_000
LEAST_BITS, MOST_BITS = 8, 20
END = b"\n"
ORDERS = (1, 2, 3, 5)
TABLE_BITS = (16, 18, 19, 20)
SLICE = 1 << 15
CONFIDENCE = 8
PLACES = 3
STRENGTHS = (10_000.0, 1_000.0, 100.0, 10.0)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, by rising keys, and which one each key is."""
    order = None if (key[1:] >= key[:-1]).all() else np.argsort(key)  # not stable, which np.unique is where it gives places, and slower
    key = key if order is None else key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    which = np.cumsum(fresh) - 1
    if order is None:
        return np.flatnonzero(fresh), which
    inverse = np.empty(len(key), np.int64)
    inverse[order] = which
    return order[fresh], inverse


def _pairs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Zeros and ones side by side as one number (real, imaginary), so that they are looked up together."""
    found = np.empty(len(zeros), np.complex64)
    found.real, found.imag = zeros, ones
    return found


class Spelling:
    """The distinct coded bytes of some words: contexts of each, and which words use it."""

    def __init__(self, words: list[bytes]) -> None:
        coded = [w if w == END else w + b" " for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        contexts, key = [], np.zeros(len(data), np.uint64)
        for order in ORDERS:
            h = np.full(len(data), np.uint64(order))
            for k in range(order):  # the byte k + 1 back, 0 before the token
                back = np.zeros(len(data), np.uint64)
                back[k + 1 :] = np.where(place[k + 1 :] > k, data[: max(len(data) - k - 1, 0)], 0)
                h = (h ^ back) * _MIX
                h ^= h >> np.uint64(31)
            contexts.append(h)
            key = (key ^ h) * _MIX2
        key = (key ^ (data + np.uint64(257)) ^ (np.minimum(place, PLACES - 1).astype(np.uint64) << np.uint64(12))) * _MIX2
        first, self.inverse = _ranks(key ^ (key >> np.uint64(29)))
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.byte, self.place = data[first].astype(np.int64), np.minimum(place[first], PLACES - 1)
        self.contexts = [h[first] for h in contexts]
        self.uses = np.bincount(self.inverse, minlength=len(first)).astype(np.float64)
        self.n_words = len(words)

    def bit(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The node (bits of the byte so far, with a leading 1) and the k-th bit, of every coded byte."""
        return (self.byte | 256) >> (8 - k), (self.byte >> (7 - k)) & 1

    def slot(self, o: int, node: np.ndarray) -> np.ndarray:
        h = (self.contexts[o] + node.astype(np.uint64)) * _MIX2
        return (h >> np.uint64(64 - TABLE_BITS[o])).astype(np.int64) + _OFFSET[o]


_OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
SLOTS = int(_OFFSET[-1])


def states(words: list[bytes], total: np.ndarray) -> None:
    """Adds to total [2, SLOTS] the zeros and ones in every byte context of the words, once each."""
    flat = total.reshape(-1)
    for at in range(0, len(words), 50_000):
        s = Spelling(words[at : at + 50_000])
        uses = s.uses.astype(flat.dtype)  # of one type with the sums, which is many times faster
        for k in range(8):
            node, bit = s.bit(k)
            for o in range(len(ORDERS)):
                np.add.at(flat, s.slot(o, node) + bit * SLOTS, uses)


def _stretch(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


def _confidence(n: np.ndarray) -> np.ndarray:
    """The binary order of n + 1, up to CONFIDENCE - 1, read off the float's exponent."""
    return np.minimum((n + np.float32(1)).astype(np.float32, copy=False).view(np.int32) >> 23, 126 + CONFIDENCE) - 127


#: Bounds of a stretched probability, in the type of its array.
LEAST, MOST = np.float32(-14), np.float32(14)


class Gated:
    """Weights of a logistic mix, one set a gate, and the error table that refines it; both learned online."""

    def __init__(self, gates: int, inputs: int, cells: int) -> None:
        self.weight, self.bias, self.refine = np.full((inputs, gates), 1.0 / inputs), np.zeros(gates), np.zeros((cells, 33))
        self.seen, self.bias_seen, self.refine_seen = np.full((inputs, gates), 1e-2), np.full(gates, 1e-2), np.full((cells, 33), 30.0)

    def mixed(self, st: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        x = self.bias.astype(np.float32).take(gate)
        for w, s in zip(self.weight.astype(np.float32), st, strict=True):
            x += w.take(gate) * s
        return np.clip(x, LEAST, MOST, out=x)

    def refined(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = (cell * 33 + np.rint(x * np.float32(16 / 14)).astype(np.int32) + 16).astype(np.intp)
        y = x + self.refine.ravel().astype(np.float32).take(spot)
        return np.clip(y, LEAST, MOST, out=y), spot

    def online(self, st: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, bit: np.ndarray, n: np.ndarray, rate: float = 0.02) -> np.ndarray:
        """Natural log probability of each bit; the weights then learn from bits that occur n times."""
        gate = gate.astype(np.intp)  # once, instead of in every count and look-up
        x, side = self.mixed(st, gate), (2 * bit - 1).astype(np.float32)
        y, spot = self.refined(x, cell)
        learned, gates = n * side, len(self.bias)
        miss = learned * (1 - 1 / (1 + np.exp(-side * x)))
        for i, s in enumerate(st):
            g = np.bincount(gate, weights=miss * s, minlength=gates)
            self.seen[i] += g * g
            self.weight[i] += rate * g / np.sqrt(self.seen[i])
        g = np.bincount(gate, weights=miss, minlength=gates)
        self.bias_seen += g * g
        self.bias += rate * g / np.sqrt(self.bias_seen)
        p = 1 / (1 + np.exp(-side * y))
        late = np.bincount(spot, weights=learned * (1 - p), minlength=self.refine.size)
        self.refine_seen += np.bincount(spot, weights=n, minlength=self.refine.size).reshape(self.refine.shape)
        self.refine += 2.0 * late.reshape(self.refine.shape) / self.refine_seen
        return np.log(p)

    def log(self, st: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Natural log probability of each bit."""
        y, _ = self.refined(self.mixed(st, gate.astype(np.intp)), cell)
        return -np.log(1 + np.exp(np.where(bit == 1, -y, y)))


class Speller:
    """Byte-level predictor states and their mix."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.mix = _pairs(*counts), Gated(PLACES * CONFIDENCE * CONFIDENCE, len(ORDERS), 256)

    def inputs(self, s: Spelling, k: int, own: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """own: one occurrence of the coded bit is taken out of every state."""
        node, bit = s.bit(k)
        st, cf = [], []
        for o in range(len(ORDERS)):
            seen = self.counts.take(s.slot(o, node))
            zeros, ones = seen.real, seen.imag
            if own:
                zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
            st.append(_stretch(ones, zeros)), cf.append(_confidence(zeros + ones))
        return st, (s.place * CONFIDENCE + cf[2]) * CONFIDENCE + cf[3], node, bit

    def log10(self, words: list[bytes], own: bool, batch: int = 4_000) -> np.ndarray:
        """log10 probability of each spelling; own: of training words, of which one is taken out, and the weights learn on."""
        found = [np.zeros(0)]
        for at in range(0, len(words), batch):
            s = Spelling(words[at : at + batch])
            logs = np.zeros(len(s.byte))
            for k in range(8):
                coded_ = self.inputs(s, k, own)
                logs += self.mix.online(*coded_, s.uses) if own else self.mix.log(*coded_)
            found.append(np.bincount(s.word, weights=logs[s.inverse], minlength=s.n_words))
        return np.concatenate(found) / math.log(10)


def hash32(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) >> 32


def tokens_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return [*raw.lower().split(), END]


def _listed(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.large_binary())


def _numbered(pieces: list[pa.Array]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of all pieces as they come, and the numbers of each piece's words."""
    found = pa.chunked_array(pieces).dictionary_encode()  # one dictionary for all; empty pieces are left out
    flat = np.concatenate([x.indices.to_numpy() for x in found.chunks]).astype(np.uint32)
    return found.chunk(0).dictionary.to_pylist(), np.split(flat, np.cumsum([len(x) for x in pieces])[:-1])


def _pack(x: np.ndarray) -> bytes:
    """x in byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    planes = data.reshape(size, len(data) // size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _join(words: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(words), 1)  # no word holds a space


def _split(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b" ")


def _row(fields: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in fields.values()], list(fields))


def _rows(fields: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))


def chunked(docs: DataFrame, held_out: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row a chunk: its texts as numbers of its words, and the words, sorted by hash, with training counts."""
    schema = (
        "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, bytes array<long>, n_tokens long, n_words long, ids binary, "
        "words binary, word_hash binary, word_counts binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        docs_, held_, sizes_, bytes_, pieces, waiting = [], [], [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array(sizes_, np.int32)
            if waiting:
                pieces.append(_listed(waiting).dictionary_encode())
            words, numbers = _numbered([x.dictionary for x in pieces])
            flat = np.concatenate([x[y.indices.to_numpy()] for x, y in zip(numbers, pieces, strict=True)])
            h = np.fromiter(map(hash32, words), np.uint32, len(words))
            order = np.argsort(h, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words))
            flat, words = place[flat], [words[i] for i in order]
            train = np.repeat(~np.array(held_, dtype=bool), sizes)
            counts = np.bincount(flat[train], minlength=len(words)).astype(np.uint32)
            b = pa.binary()
            return _row({
                "chunk": (chunk, pa.int64()), "doc_ids": (docs_, pa.list_(pa.int64())), "held": (held_, pa.list_(pa.bool_())), "sizes": (sizes, pa.list_(pa.int32())),
                "bytes": (bytes_, pa.list_(pa.int64())), "n_tokens": (len(flat), pa.int64()), "n_words": (len(words), pa.int64()), "ids": (_pack(flat), b),
                "words": (_join(words), b), "word_hash": (_pack(np.diff(h[order], prepend=np.uint32(0))), b), "word_counts": (_pack(counts), b),
            })

        for batch in batches:
            for doc, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = tokens_of(text)
                waiting += tokens
                docs_.append(doc), held_.append(bool(held)), sizes_.append(len(tokens)), bytes_.append(len(text or b""))
                total += len(tokens)
                if len(waiting) >= PIECE_TOKENS:
                    pieces.append(_listed(waiting).dictionary_encode())  # a short piece's words stay in the processor's cache
                    waiting = []
                if total >= chunk_tokens:
                    yield flush()
                    chunk, total = chunk + 1, 0
                    docs_, held_, sizes_, bytes_, pieces, waiting = [], [], [], [], [], []
        if docs_:
            yield flush()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), held_out.alias("held"))
    return read.mapInArrow(run, schema)


#: A triple is 64 bits: 32 of the hash of the token before, 20 of the token's cell, 12 of the hash of the token two before.
CELL, BEFORE = np.uint64(MOST_BITS), np.uint64(32 - MOST_BITS)


def triples(flat: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct triples of a chunk, rising, and which one each token is."""
    now, end = hashes.astype(np.uint64)[flat], np.uint64(hash32(END))
    starts = np.cumsum(sizes) - sizes
    one, two = np.concatenate([[end], now[:-1]]), np.concatenate([[end, end], now[:-2]])[: len(now)]
    one[starts], two[starts], two[starts[sizes > 1] + 1] = end, end, end
    cell = now >> np.uint64(32 - bits) << (CELL - np.uint64(bits))
    return np.unique(one << np.uint64(32) | cell << BEFORE | two >> CELL, return_inverse=True)


def repeats(doc: np.ndarray, ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a text (texts in order) uses a token again, and how often it did before."""
    n, bits = len(ids), (len(ids).bit_length(), n_words.bit_length())
    if sum(bits) + int(doc[-1]).bit_length() < 64:  # text, token and place in one number, which sorts many times faster
        key = np.sort((doc.astype(np.int64) << bits[1] | ids) << bits[0] | np.arange(n))
        order, group = key & ((1 << bits[0]) - 1), key >> bits[0]
        fresh = np.flatnonzero(np.diff(group, prepend=-1))
    else:
        order = np.lexsort((ids, doc))
        fresh = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=-1) != 0))
    earlier = np.arange(n) - np.repeat(fresh, np.diff(fresh, append=n))
    return order[earlier > 0], earlier[earlier > 0].astype(np.float64)


def _slices(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of `shards` equal ranges of 32-bit hashes begins in sorted hashes, and the end."""
    edges = np.array([-(-(k << 32) // shards) for k in range(shards)] + [1 << 32], np.uint64)
    return np.searchsorted(hashes, edges)


def counted_words(chunks: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its distinct words, their training counts, and for each chunk where its words stand among them."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                words, h, c = _split(words), np.cumsum(_unpack(h, "<u4"), dtype=np.uint64), _unpack(c, "<u4")
                edge = _slices(h, shards)
                parts = [(k, slice(edge[k], edge[k + 1])) for k in np.flatnonzero(np.diff(edge)).tolist()]
                yield _rows({"shard": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "counts": pa.binary()}, [(k, chunk, _join(words[x]), _pack(c[x])) for k, x in parts])

    def merged(t: pa.Table) -> pa.Table:
        chunks_, words, counts = zip(*sorted(zip(*(t.column(x).to_pylist() for x in ("chunk", "words", "counts")), strict=True)), strict=True)
        listed, numbers = _numbered([_listed(_split(x)) for x in words])
        total, places = np.zeros(len(listed), np.int64), [_pack(x) for x in numbers]
        for x, c in zip(numbers, counts, strict=True):
            total[x] += _unpack(c, "<u4")
        row = [[t.column("shard")[0].as_py()], [_join(listed)], [_pack(total)], [list(chunks_)], [places], [int(total.sum())], [int((total > 0).sum())], [int((total == 1).sum())]]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(row, types, strict=True)], names=["shard", "words", "totals", "chunks", "places", "n", "v", "once"])

    sent = chunks.select("chunk", "words", "word_hash", "word_counts").mapInArrow(dealt, "shard int, chunk long, words binary, counts binary")
    return sent.repartition(shards, "shard").groupBy("shard").applyInArrow(merged, "shard int, words binary, totals binary, chunks array<long>, places array<binary>, n long, v long, once long")


def cell_counts(words: DataFrame, bits: int) -> np.ndarray:
    """Training tokens in each of the 2^bits cells; summed on the executors, a bounded array comes back."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for listed, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                listed = _split(listed)
                cell = np.fromiter(map(hash32, listed), np.int64, len(listed)) >> (32 - bits)
                total += np.bincount(cell, weights=_unpack(c, "<i8"), minlength=len(total)).astype(np.int64)
        for at in range(0, len(total), SLICE):
            if total[at : at + SLICE].any():
                yield _row({"at": (at, pa.int64()), "part": (total[at : at + SLICE].tobytes(), pa.binary())})

    total = np.zeros(1 << bits, np.int64)
    for r in _summed(words.select("words", "totals").mapInArrow(partial, "at long, part binary"), "<i8"):
        part = np.frombuffer(bytes(r["part"]), "<i8")
        total[r["at"] : r["at"] + len(part)] = part
    return total


def _summed(parts: DataFrame, kind: str) -> Iterator:
    """Slices (at, part) added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(part, kind)
                found[at] = found[at] + x if at in found else x
        for at, x in found.items():
            yield _row({"at": (at, pa.int64()), "part": (x.tobytes(), pa.binary())})

    return parts.repartition("at").mapInArrow(run, "at long, part binary").toLocalIterator()


def spelling_states(words: DataFrame) -> np.ndarray:
    """The byte contexts' zeros and ones over the training words, each counted once."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.float32)
        for batch in batches:
            for listed, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states([w for w, n in zip(_split(listed), _unpack(c, "<i8").tolist(), strict=True) if n], total)
        for at in range(0, SLOTS, SLICE):
            part = total[:, at : at + SLICE]
            if part.any():
                yield _row({"at": (at, pa.int64()), "part": (part.tobytes(), pa.binary())})

    raw = np.zeros((2, SLOTS), np.float32)
    for r in _summed(words.select("words", "totals").mapInArrow(partial, "at long, part binary"), "<f4"):
        part = np.frombuffer(bytes(r["part"]), "<f4").reshape(2, -1)
        raw[:, r["at"] : r["at"] + part.shape[1]] = part
    return raw


def spelled(words: list[bytes], c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of the spelling of words that one training token or none holds, 0 for the others.

    counts: the states of the spelling model.
    """
    speller, found = Speller(counts), np.zeros(len(words))
    for times, own in ((1, True), (0, False)):
        rows = np.flatnonzero(c == times)
        found[rows] = speller.log10([words[i] for i in rows], own)
    return found


class Cells:
    """Counts of the cells at every depth, and the mass left to unknown words."""

    def __init__(self, counts: np.ndarray, once: int) -> None:
        self.bits = int(math.log2(len(counts)))
        self.leaf, self.unknown = counts, max(1, once) / len(counts)

    @cached_property
    def depth(self) -> list[np.ndarray]:
        found = [self.leaf]
        while len(found[0]) > 1:
            found.insert(0, found[0].reshape(-1, 2).sum(axis=1))
        return found

    @cached_property
    def paths(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per depth the log probability of the way to each node by cell counts alone: one token of it taken out, and as it is."""
        found = []
        for own in (1, 0):
            logs = [np.zeros(1)]
            for k in range(self.bits):
                below, above = self.depth[k + 1], np.repeat(self.depth[k], 2)
                logs.append(np.repeat(logs[-1], 2) + np.log((np.maximum(below - own, 0) + 0.4) / (np.maximum(above - own, 0) + 0.8)))
            found.append(logs)
        return found[0], found[1]

    def rest(self, k: int, cell: np.ndarray, own: bool) -> np.ndarray:
        """Log probability of the bits of a cell from depth k on, by cell counts alone."""
        logs = self.paths[0 if own else 1]
        return logs[self.bits][cell] - logs[k][cell >> (self.bits - k)]

    def in_cell(self, hashes: np.ndarray, c: np.ndarray, spelling: np.ndarray, own: int) -> np.ndarray:
        """log10 probability of each word within its cell; own: one token of it is taken out."""
        leaf, c = np.maximum(self.leaf[hashes.astype(np.int64) >> (32 - self.bits)] - own, 0), c - own
        new = np.log10(self.unknown / (leaf + self.unknown)) + np.minimum(spelling + self.bits * math.log10(2), 0)
        return np.where(c > 0, np.log10(np.maximum(c, 1) / (leaf + self.unknown)), new)


class Router:
    """Which shard a triple goes to: by the token before it, and for frequent ones by a class of the one before that."""

    def __init__(self, frequent: dict[int, int], shards: int) -> None:
        self.hash = np.array(sorted(frequent), np.uint64)
        self.classes = np.array([frequent[h] for h in sorted(frequent)], np.uint64)
        self.shards = shards

    def context(self, triple: np.ndarray) -> np.ndarray:
        """A 64-bit name of the order-1 context: the token before and its class."""
        one, before = triple >> np.uint64(32), triple & np.uint64((1 << int(BEFORE)) - 1)
        if not len(self.hash):
            return one << BEFORE
        at = np.minimum(np.searchsorted(self.hash, one), len(self.hash) - 1)
        return one << BEFORE | before % np.where(self.hash[at] == one, self.classes[at], np.uint64(1))

    def shard(self, context: np.ndarray) -> np.ndarray:
        h = (context * _MIX) >> np.uint64(32)
        found = (h * np.uint64(self.shards)) >> np.uint64(32)
        return found.astype(np.uint16 if self.shards <= 1 << 16 else np.int64)  # short ones are sorted by radix


def _parted(key: np.ndarray) -> np.ndarray:
    """How many bits of the cell each of some rising keys shares with the one before it, and one more; 0 if the contexts differ."""
    length = np.frexp((key[1:] ^ key[:-1]).astype(np.float64))[1]
    return np.concatenate([[0], np.maximum(MOST_BITS + 1 - length, 0)]).astype(np.uint8)[: len(key)]


def coded(context: np.ndarray, triple: np.ndarray, n: np.ndarray, held: np.ndarray, cells: Cells, batch: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the cell of every triple of a shard, which holds all triples of its contexts.

    First for training texts, the token itself taken out, then for held-out texts, where
    they use it (held). Bit by bit: states are sums over the shard; batches are spread
    evenly over its contexts, each coded by the weights so far, which then learn from it.
    Triples leave once no other training token shares their order-1 context and bits: the
    longer contexts then say nothing on the bits that follow.
    """
    bits, most = cells.bits, np.uint64((1 << MOST_BITS) - 1)
    code, low = (triple >> BEFORE) & most, np.uint64((1 << int(BEFORE)) - 1)
    first, inverse = _ranks(key1 := context << CELL | code)
    key1 = key1[first]
    key2 = triple >> np.uint64(32) << np.uint64(32) | (triple & low) << CELL | code
    live = np.argsort(key2)
    part1, part2, inverse = _parted(key1), _parted(key2[live]), inverse.astype(np.int32)[live]
    cell1, cell = (((x & most) >> (CELL - np.uint64(bits))).astype(np.int32) for x in (key1, code[live]))
    n, used = n.astype(np.float64)[live], held[live]
    n1, held1 = np.bincount(inverse, weights=n, minlength=len(key1)), np.bincount(inverse, weights=used, minlength=len(key1)) > 0
    logs, held_logs = np.zeros(len(live)), np.zeros(len(live))
    now, held_now = np.zeros(len(live)), np.zeros(len(live))
    mix = Gated(CONFIDENCE * CONFIDENCE, 3, CONFIDENCE)
    for k in range(bits):
        if not len(live):
            break
        begin1 = np.flatnonzero(part1 <= k)
        all1 = np.add.reduceat(n1, begin1)
        alone = (all1 == 0) | (all1 <= 1) & ~np.logical_or.reduceat(held1, begin1)
        if alone.any():
            stay1 = np.repeat(~alone, np.diff(begin1, append=len(n1)))
            stay = stay1[inverse]
            gone, stay = np.flatnonzero(~stay), np.flatnonzero(stay)
            logs[live[gone]] = now[gone] + np.where(n[gone] > 0, cells.rest(k, cell[gone], True), 0)
            held_logs[live[gone]] = held_now[gone] + cells.rest(k, cell[gone], False)
            inverse = (np.cumsum(stay1, dtype=np.int32) - np.int32(1))[inverse[stay]]
            live, part2, cell, n, used, now, held_now = (x[stay] for x in (live, part2, cell, n, used, now, held_now))
            part1, cell1, n1, held1, all1 = part1[stay1], cell1[stay1], n1[stay1], held1[stay1], all1[~alone]
            if not len(live):
                break
        begin1, begin2, last = np.flatnonzero(part1 <= k), np.flatnonzero(part2 <= k), bits - 1 - k
        bit = ((cell >> last) & 1).astype(np.float32)
        up1, all2, up2 = np.add.reduceat(n1 * ((cell1 >> last) & 1), begin1), np.add.reduceat(n, begin2), np.add.reduceat(n * bit, begin2)
        group1, group2 = (np.cumsum(x <= k, dtype=np.int32) - np.int32(1) for x in (part1, part2))
        depth = cells.depth[k + 1].reshape(-1, 2)
        states_ = [(_pairs(depth[:, 0], depth[:, 1]), cell >> (bits - k)), (_pairs(all1 - up1, up1), group1[inverse]), (_pairs(all2 - up2, up2), group2)]

        def inputs(seen: list[tuple[np.ndarray, np.ndarray]], b: np.ndarray) -> tuple:
            cf = [_confidence(z + o) for z, o in seen[1:]]
            return [_stretch(o, z) for z, o in seen], cf[0] * CONFIDENCE + cf[1], cf[1], b

        steps = max(1, len(live) // batch)
        whole = len(live) // (steps * RUN) * (steps * RUN)
        for j in range(steps + (whole < len(live))):  # short runs from all over the shard, then what is left
            part = (lambda x: x[:whole].reshape(-1, steps, RUN)[:, j]) if j < steps else (lambda x: x[whole:])  # noqa: B023, E731
            take = lambda x: part(x).ravel()  # noqa: B023, E731
            b, times, some = take(bit), take(n).astype(np.float32), np.flatnonzero(take(used))
            seen = [state.take(take(at)) for state, at in states_]
            if len(some):
                held_part = np.zeros(len(b))
                held_part[some] = mix.log(*inputs([(x.real, x.imag) for x in (y[some] for y in seen)], b[some]))
                part(held_now)[...] += held_part.reshape(part(held_now).shape)
            own = np.minimum(times, 1)
            one = own * b
            zero = own - one
            coded_ = mix.online(*inputs([(x.real - zero, x.imag - one) for x in seen], b), times)
            part(now)[...] += coded_.reshape(part(now).shape)
    logs[live], held_logs[live] = now, held_now
    return logs / math.log(10), held_logs / math.log(10)


#: Batches are made of runs of so many neighbouring triples.
RUN = 64
#: Log probabilities travel as whole multiples of 2^-14 (6e-5).
STEP = 1 << 14


def score(docs: DataFrame, held_out: Column, chunk_tokens: int = CHUNK_TOKENS, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/contextmix-{uuid.uuid4().hex}"
    chunked(docs, held_out, chunk_tokens).write.option("compression", "none").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    size = chunks.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-int(size["t"] or 0) // shard_tokens))
    counted_words(chunks, max(1, -(-int(size["w"] or 0) // shard_words))).write.option("compression", "none").parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    totals = words.agg(*[F.sum(c).alias(c) for c in ("n", "v", "once")]).first()
    n_train, distinct = int(totals["n"] or 0), int(totals["v"] or 0)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(distinct + 1)) + 2))
    cells = spark.sparkContext.broadcast(Cells(cell_counts(words, bits), int(totals["once"] or 0)))
    spelling = spark.sparkContext.broadcast(spelling_states(words))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for listed, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = _unpack(c, "<i8")
                hot = np.flatnonzero(c > shard_tokens // 2)
                listed = _split(listed) if len(hot) else []
                yield pa.RecordBatch.from_arrays([pa.array([hash32(listed[i]) for i in hot], pa.int64()), pa.array(c[hot])], ["h", "c"])

    hot = words.select("words", "totals").mapInArrow(often, "h long, c long").collect()  # few: half a shard of tokens each
    router = spark.sparkContext.broadcast(Router({r["h"]: min(1 << int(BEFORE), 2 * r["c"] // shard_tokens + 1) for r in hot}, shards))
    answer = {"chunk": pa.int64(), "kind": pa.int32(), "shard": pa.int32(), "lp": pa.binary(), "held_lp": pa.binary(), "c": pa.binary()}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, listed, c, chunks_, places in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c = _unpack(c, "<i8")
                lp = np.rint(-STEP * spelled(_split(listed), c, spelling.value)).astype("<u8")  # a token may be very long
                places = [_unpack(x, "<u4") for x in places]
                yield _rows(answer, [(chunk, 0, shard, _pack(lp[x]), None, _pack(c[x])) for chunk, x in zip(chunks_, places, strict=True)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, b = router.value, pa.binary()
        for batch in batches:
            for chunk, held, sizes, ids, h in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sizes = np.array(sizes, np.int64)
                found, which = triples(_unpack(ids, "<u4"), np.cumsum(_unpack(h, "<u4"), dtype=np.uint64), sizes, bits)
                held = np.repeat(np.array(held, bool), sizes)
                n, uses = np.bincount(which[~held], minlength=len(found)).astype("<u4"), np.zeros(len(found), np.uint8)
                uses[which[held]] = 1
                to = route.shard(route.context(found))
                order = np.argsort(to, kind="stable")
                edge = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=shards))])
                parts = [(k, order[edge[k] : edge[k + 1]]) for k in np.flatnonzero(np.diff(edge)).tolist()]
                rows = [(k, chunk, _pack(np.diff(found[x], prepend=np.uint64(0))), _pack(n[x]), _pack(uses[x])) for k, x in parts]
                yield _rows({"shard": pa.int32(), "chunk": pa.int64(), "triples": b, "counts": b, "uses": b}, rows)

    def solved(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(x).to_pylist() for x in ("chunk", "triples", "counts", "uses")), strict=True))
        listed = [np.cumsum(_unpack(r[1], "<u8")) for r in rows]
        found, which = np.unique(np.concatenate(listed), return_inverse=True)
        uses, held = np.concatenate([_unpack(r[3], "u1") for r in rows]) > 0, np.zeros(len(found), bool)
        n, held[which[uses]] = np.bincount(which, weights=np.concatenate([_unpack(r[2], "<u4") for r in rows])), True
        lp, held_lp = (np.rint(-STEP * x).astype("<u4")[which] for x in coded(router.value.context(found), found, n, held, cells.value))
        shard, split = t.column("shard")[0].as_py(), lambda x: np.split(x, np.cumsum([len(y) for y in listed])[:-1])
        out = [(r[0], 1, shard, _pack(x), _pack(y[u]), None) for r, x, y, u in zip(rows, split(lp), split(held_lp), split(uses), strict=True)]
        return pa.Table.from_batches([_rows(answer, out)])

    reply = "chunk long, kind int, shard int, lp binary, held_lp binary, c binary"
    in_cell = words.select("shard", "words", "totals", "chunks", "places").mapInArrow(within, reply)
    sent = chunks.select("chunk", "held", "sizes", "ids", "word_hash").mapInArrow(dealt, "shard int, chunk long, triples binary, counts binary, uses binary")
    answers = in_cell.unionByName(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(solved, reply))
    bottom = math.log10(n_train + distinct + 1)

    def summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(zip(*(right.column(x).to_pylist() for x in ("kind", "shard", "lp", "held_lp", "c")), strict=True), key=lambda r: r[:2])
        take = lambda kind, at, form: np.concatenate([_unpack(r[at], form) for r in got if r[0] == kind])
        held = np.array(left.column("held")[0].as_py(), bool)
        ids, sizes = _unpack(left.column("ids")[0].as_py(), "<u4").astype(np.int64), np.array(left.column("sizes")[0].as_py(), np.int64)
        hashes = np.cumsum(_unpack(left.column("word_hash")[0].as_py(), "<u4"), dtype=np.uint64)
        spelling_, c = take(0, 2, "<u8") / -STEP, take(0, 4, "<i8")  # words are sorted by hash, so shards follow one another
        in_word, held_word = (cells.value.in_cell(hashes, c, spelling_, own) for own in (1, 0))
        found, which = triples(ids, hashes, sizes, bits)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out = held[doc]
        uses = np.zeros(len(found), bool)
        uses[which[out]] = True
        order = np.argsort(router.value.shard(router.value.context(found)), kind="stable")
        lp, held_lp = np.empty(len(found)), np.zeros(len(found))
        lp[order], held_lp[order[uses[order]]] = take(1, 2, "<u4") / -STEP, take(1, 3, "<u4") / -STEP
        p = np.where(out, held_lp[which] + held_word[ids], lp[which] + in_word[ids])
        add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        again, earlier = repeats(doc, ids, len(c))
        at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums, likely, later, places = [add(p)], 10.0 ** np.maximum(p[again], -300), at[again], np.arange(sizes.max())
        for strength in STRENGTHS:
            cached = p + np.log10(strength / (strength + places))[at]
            cached[again] = np.log10(np.maximum(strength * likely + earlier, 1e-300) / (strength + later))
            sums.append(add(cached))
        sums = np.array(sums) * math.log(10)
        top = sums.max(axis=0)
        total = (top + np.log(np.exp(sums - top).sum(axis=0) / len(sums))) / math.log(10)
        n_bytes = np.array(left.column("bytes")[0].as_py(), np.float64)
        per_byte = pa.array(np.where(n_bytes > 0, -total / math.log10(2) / np.maximum(n_bytes, 1), np.nan), pa.float64(), from_pandas=True)
        base, known = add(np.log10(c + 1.0)[ids]) - bottom * sizes, add((c > 0)[ids]).astype(np.int64)
        columns = [left.column("doc_ids")[0].values, left.column("held")[0].values, sizes, known, np.full(len(sizes), n_train), base, total, per_byte]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=names)

    texts = chunks.select("chunk", "doc_ids", "held", "sizes", "bytes", "ids", "word_hash")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    tasks = max(1, int(size["n"]))
    scored = texts.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(summed, schema)
    result = checkpointed(scored)
    removed(spark, folder)
    return result
