"""Packing token sequences by lexical retrieval.

A document's token ids (a public byte-level BPE vocabulary, special tokens off, then id 0;
merged by tiktoken, ids equal to the tokenizers library's, to which texts with an added token of
the vocabulary are left) are first cut
into whole windows; what is left over, shorter than a window, is a piece to be packed
with lexical neighbours. Pieces are dealt by a min-wise signature of their token 4-grams
into range shards of bounded size, so that related pieces, copies above all, share a
shard and a hot signature still spreads over several shards. Each shard builds a BM25
inverted index over token bigrams. A seed (the longest unused piece) queries it, and its
best unused neighbours fill the window greedily; the last one is cut to fit and what
remains of it stays unused. Pieces without a lexical neighbour are taken in length order.
A shard therefore leaves at most one window short of full.

Cases: null and empty texts are the single id 0. Repeated rows and null doc_ids are
separate documents, packed like any other. Long texts are tokenised whole. Extra columns
are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import documents
from ledgerlens.plans.storage import checkpointed

WINDOW = 1024
SHARD_PIECES = 1500


#: The pre-token pattern of byte-level BPE vocabularies of this kind (fixed value).
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
def byte_level(path: str) -> tiktoken.Encoding:
    """The byte-level BPE vocabulary of a tokenizers file, merged by rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t) and not t.startswith("<|")}
    return tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space from this length on are left to the tokenizers library: the other's pattern engine gives up.
LONG_SPACE = re.compile(r"\s{20000}")


class TextTokenizer:
    """ids of whole texts as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        self.path, self.ordinary, self.library = path, byte_level(path).encode_ordinary, None
        with open(path, encoding="utf-8") as f:
            listed = json.load(f)
        self.added = [t["content"] for t in listed.get("added_tokens", [])]
        if max([*listed["model"]["vocab"].values(), *(t["id"] for t in listed.get("added_tokens", []))]) >= 1 << 16:
            raise ValueError("pieces are indexed by ids of 16 bits")

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added) or len(text) >= 20_000 and LONG_SPACE.search(text):
            ids = self._library().encode(text, add_special_tokens=False).ids
        else:
            ids = self.ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)

    def _library(self):  # noqa: ANN202
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library


def _signature(ids: np.ndarray) -> int:
    """Min-wise hash of the 4-grams of ids."""
    x = ids.astype(np.uint64)
    if len(x) >= 4:
        pairs = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]
        x = pairs[:-2] * np.uint64(0xD6E8FEB86659FD93) + pairs[2:]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(x.min() >> np.uint64(1))


def tokenized(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_tokens, crcs (of its whole windows), tail (ids left over), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size = TextTokenizer(tokenizer), 4 * window
        for batch in batches:
            totals, crcs, tails, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = model.encode(text or "") + b"\0\0\0\0"
                full = len(ids) // size * size
                totals.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + size]) for i in range(0, full, size)])
                tails.append(ids[full:])
                signatures.append(_signature(np.frombuffer(ids[full:], "<u4")) if full < len(ids) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(signatures, pa.int64())],
                ["doc_id", "doc_tokens", "crcs", "tail", "signature"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, tail binary, signature long")


class ShardIndex:
    """BM25 over the token bigrams of a shard's pieces."""

    def __init__(self, pieces: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        n = len(pieces)
        grams = [x[:-1].astype(np.int64) * 65_536 + x[1:] if len(x) > 1 else x.astype(np.int64) for x in pieces]
        lengths = np.array([len(g) for g in grams], dtype=np.float64)
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths.astype(np.int64))
        occurrences = np.sort((np.concatenate(grams) if n else np.zeros(0, np.int64)) * n + doc)
        fresh = np.flatnonzero(np.diff(occurrences, prepend=-1))
        pairs, tf = occurrences[fresh], np.diff(fresh, append=len(occurrences))
        term, doc = pairs // max(n, 1), pairs % max(n, 1)
        number = np.cumsum(np.diff(term, prepend=-1) != 0) - 1
        df = np.bincount(number)
        shared = df[number] > 1  # a term of one piece retrieves nothing
        number, doc, tf, kept = number[shared], doc[shared], tf[shared], np.flatnonzero(df > 1)
        number = np.searchsorted(kept, number)
        df = df[kept]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / max(lengths.mean(), 1e-9)) if n else lengths
        self.n, self.doc = n, doc
        self.weight = idf[number] * tf * (k1 + 1) / (tf + norm[doc])
        self.start = np.concatenate([[0], np.cumsum(df)])
        order = np.sort((doc << 32) + np.arange(len(doc))) & 0xFFFFFFFF  # by piece, terms rising
        self.term_of, self.term_from = number[order], np.searchsorted(doc[order], np.arange(n + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Pieces by falling BM25 score for all of the seed's terms."""
        query = self.term_of[self.term_from[seed] : self.term_from[seed + 1]]
        if not len(query):
            return query
        at, to = self.start[query], self.start[query + 1]
        flat = np.repeat(at - np.concatenate([[0], np.cumsum(to - at)[:-1]]), to - at) + np.arange((to - at).sum())
        score = np.bincount(self.doc[flat], weights=self.weight[flat], minlength=self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(pieces: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, length); every id of every piece lies in exactly one."""
    used = np.zeros(len(pieces), dtype=np.int64)
    size = np.array([len(x) for x in pieces], dtype=np.int64)
    index = ShardIndex(pieces)
    by_length = np.argsort(-size, kind="stable")
    sequences, pending = [], 0

    def unused_longest() -> int:
        nonlocal pending
        while pending < len(by_length) and used[by_length[pending]] == size[by_length[pending]]:
            pending += 1
        return by_length[pending] if pending < len(by_length) else -1

    while (seed := unused_longest()) >= 0:
        sequence, room = [], window

        def take(i: int) -> None:
            nonlocal room
            n = int(min(room, size[i] - used[i]))
            sequence.append((int(i), int(used[i]), n))  # noqa: B023
            used[i] += n
            room -= n

        take(seed)
        if room:
            found = index.neighbours(int(seed))
            for i in found[used[found] < size[found]]:
                if not room:
                    break
                take(i)
        while room and (i := unused_longest()) >= 0:
            take(i)
        sequences.append(sequence)
    return sequences


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = checkpointed(tokenized(docs, tokenizer, window).withColumn("at", F.monotonically_increasing_id()))  # rows that are equal otherwise can be parted
    shards = max(1, -(-rows.count() // shard_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        wait: list[tuple[int | None, int, np.ndarray]] = []

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces in pack_shard([x[2] for x in wait], window):
                offset = 0
                for i, at, n in pieces:
                    doc, total, ids = wait[i]
                    crc = zlib.crc32(ids[at : at + n].astype("<u4").tobytes())
                    out.append((doc, total - len(ids) + at, n, crc, total, sequence, offset))
                    offset += n
                sequence += 1
            wait.clear()
            return table(out)

        for batch in batches:
            out = []
            for doc, total, crcs, tail in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for k, crc in enumerate(crcs):
                    out.append((doc, k * window, window, crc, total, sequence, 0))
                    sequence += 1
                if tail:
                    wait.append((doc, total, np.frombuffer(tail, "<u4").astype(np.uint16)))
                    if len(wait) >= 2 * shard_pieces:  # a range partition far over its share
                        yield flush()
            yield table(out)
        yield flush()

    dealt = rows.repartitionByRange(shards, "signature", "doc_id", "at").sortWithinPartitions("signature", "doc_id", "at")
    return dealt.select("doc_id", "doc_tokens", "crcs", "tail").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
