"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of the linked ids.

A is a byte-level BPE vocabulary read over space + text, B a sentencepiece model read over
the text (it adds the space itself); strings of special tokens inside a text are plain
text. The ends of the tokens are cumulative sums of their byte lengths. Where ends of A
and B coincide (intersect1d) the text is cut into groups, and searchsorted names every
token's group. Tokens are linked when their byte ranges overlap: for each A token the first
and the last such B token are found by searchsorted, and the pairs are written out by
repeat. A text is linked in slices between common cuts, so memory beyond its tokens is bounded.

A pair's count is the number of documents that hold it linked. A task counts the pairs of
a chunk of documents, a bounded number of links, before anything is shuffled; the chunks'
counts are added in two stages, by (pair, salt) and by pair. The highest count of each A
id is one row an id of the vocabulary, 65,536 at most, and is broadcast. The counts return
to the chunks by a join on the pair, one row for each pair of a chunk, and every chunk's
documents, kept as deltas into the chunk's list of pairs, take their sums from that list.
No pair is written once per document, and nothing is collected.

Cases: a text that is null or empty, or whose A or B tokens do not spell space + text, has no
tokens: zeros, and '' instead of a hash. Rows that repeat, or share or lack a doc_id, are
documents of their own and count as such. Ties for the highest count are all best. Very
long texts are tokenised whole. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import documents
from ledgerlens.llm.packing import LONG_SPACE, byte_level
from ledgerlens.plans.storage import checkpointed

#: A chunk is closed at so many links or documents.
CHUNK_LINKS, CHUNK_DOCS = 2_000_000, 4_096
#: A tokens linked at a time.
SLICE = 1 << 20
SALTS = 16
IDS = 1 << 16

CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary, pairs array<long>, docs array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Both vocabularies, their tokens' bytes, and what they make of a text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.path, self.bytes_a, self.library = a_path, byte_level(a_path), None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            listed = json.load(f)
        size = 1 + max([*listed["model"]["vocab"].values(), *(t["id"] for t in listed.get("added_tokens", []))])
        if max(size, self.b.get_piece_size()) > IDS:
            raise ValueError("a pair of ids is kept in 32 bits")
        self.size_a, self.size_b = size, self.b.get_piece_size()
        self.len_a = np.zeros(size, np.int64)
        for token in self.bytes_a.token_byte_values():
            self.len_a[self.bytes_a.encode_single_token(token)] = len(token)
        self.piece = [self._spelled(k) for k in range(self.size_b)]
        self.len_b = np.fromiter(map(len, self.piece), np.int64, self.size_b)
        a, b = [str(k) for k in range(self.size_a)], [str(k) for k in range(self.size_b)]
        self.written = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]

    def _spelled(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def _encode_a(self, text: str) -> list[int]:
        if len(text) < 20_000 or not LONG_SPACE.search(text):
            return self.bytes_a.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of A and B; None where the text has no tokens."""
        if not text:
            return None
        spelled = b" " + text.encode()
        a, b = self._encode_a(" " + text), self.b.encode(text)
        if self.bytes_a.decode_bytes(a) != spelled or b"".join([self.piece[k] for k in b]) != spelled:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray) -> np.ndarray:
    """a * IDS + b of every pair of occurrences whose byte ranges overlap."""
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    ahead = np.cumsum(n) - n
    return np.repeat(a, n) * IDS + b[np.arange(n.sum()) - np.repeat(ahead - first, n)]


class Aligned:
    """One text: its numbers of tokens, groups and links, the hash of its groups, its pairs and how often each is linked."""

    def __init__(self, both: Tokenizers, text: str | None, step: int = SLICE) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.pairs, self.times = "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = both.encode(text)
        if ids is None:
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(both.len_a[a]), np.cumsum(both.len_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.n_a, self.n_b, self.n_groups = len(a), len(b), len(common)
        upto = np.searchsorted(ends_a, common, "right")
        cuts = np.unique(np.minimum(np.searchsorted(upto, np.arange(step, len(a) + step, step)), len(common) - 1))
        digest, pairs, times, at, of = hashlib.sha256(), [], [], 0, 0
        for cut in cuts:
            here, there = slice(at, upto[cut]), slice(of, np.searchsorted(ends_b, common[cut], "right"))
            at, of = here.stop, there.stop
            pair = linked(a[here], b[there], ends_a[here], ends_b[there], ends_a[here] - both.len_a[a[here]])
            self.n_links += len(pair)
            for into, x in zip((pairs, times), np.unique(pair, return_counts=True), strict=True):
                into.append(x)
            text_ = self._written(both, a[here], b[there], np.searchsorted(common, ends_a[here]), np.searchsorted(common, ends_b[there]))
            digest.update((text_[:-1] if cut == cuts[-1] else text_).encode())
        self.sha = digest.hexdigest()
        self.pairs, self.times = (pairs[0], times[0]) if len(pairs) == 1 else _added(pairs, times)

    @staticmethod
    def _written(both: Tokenizers, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """Groups in order: ids of A, |, ids of B, each group closed by a semicolon."""
        end_a, end_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        token = np.concatenate([a + both.size_a * end_a, 2 * both.size_a + b + both.size_b * end_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        return "".join([both.written[k] for k in token[order].tolist()])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, with their summed counts."""
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _chunk(number: int, docs: list[tuple[int | None, Aligned]]) -> pa.RecordBatch:
    """Rows of the chunk's documents, and one row with its pairs and in how many of the documents each is."""
    pairs, place, n = np.unique(np.concatenate([x.pairs for _, x in docs]), return_inverse=True, return_counts=True)
    packed, at = [], 0
    for _, x in docs:
        mine = place[at : at + len(x.pairs)]
        at += len(x.pairs)
        packed.append(zlib.compress(np.concatenate([np.diff(mine, prepend=0), x.times]).astype("<u4").tobytes(), 1))
    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                        ("packed", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
    none = [None] * len(docs)
    numbers = [[getattr(x, c) for _, x in docs] + [None] for c in ("n_a", "n_b", "n_groups", "n_links")]
    columns = [[number] * (len(docs) + 1), [i for i, _ in docs] + [None], *numbers, [x.sha for _, x in docs] + [None], [*packed, None], [*none, pairs], [*none, n]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def chunked(docs: DataFrame, a_path: str, b_path: str, links: int = CHUNK_LINKS, rows: int = CHUNK_DOCS) -> DataFrame:
    """Documents and pairs of chunks (CHUNKS): a document has packed, the list of pairs of its chunk has pairs and docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number, wait, held = Tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wait.append((doc, Aligned(both, text.as_py())))
                held += wait[-1][1].n_links
                if held >= links or len(wait) >= rows:
                    yield _chunk(number, wait)
                    number, wait, held = number + 1, [], 0
        if wait:
            yield _chunk(number, wait)

    return documents(docs).mapInArrow(run, CHUNKS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of documents, each chunk's after the counts of its pairs in the pairs' order."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    chunk, waiting, n, best = None, [], None, None
    for batch in batches:
        chunks, is_doc = batch.column("chunk").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False).astype(bool)
        edges = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(is_doc.astype(np.int8)) != 0)) + 1
        for at, to in zip([0, *edges], [*edges, len(chunks)], strict=True):
            if at == to:
                continue
            if chunks[at] != chunk:
                chunk, waiting, n = chunks[at], [], None
            part = batch.slice(at, to - at)
            if not is_doc[at]:
                waiting.append((part.column("n").to_numpy(), part.column("best").to_numpy(zero_copy_only=False).astype(np.int64)))
                continue
            if n is None:
                n, best = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.int64),) * 2
            bests, sums = [], []
            for packed in part.column("packed"):
                deltas, times = np.frombuffer(zlib.decompress(packed.as_py()), "<u4").astype(np.int64).reshape(2, -1)
                mine = np.cumsum(deltas)
                bests.append(int((best[mine] * times).sum()))
                sums.append(int((n[mine] * times).sum()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:5]), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), part.column(names[7])], names)


def counted(chunks: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of the pair's A id) from chunks."""
    listed = chunks.where("packed is null").select("chunk", F.inline(F.arrays_zip("pairs", "docs")).alias("pair", "docs"))
    salted = listed.groupBy("pair", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = checkpointed(salted.groupBy("pair").agg(F.sum("docs").alias("n")))
    a = F.shiftright("pair", IDS.bit_length() - 1)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # one row an id of A
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str, links: int = CHUNK_LINKS, rows: int = CHUNK_DOCS) -> DataFrame:
    """One row a document (DIGEST): tokens, groups and links, links whose count is their A id's highest, the sum of the links' counts, the groups' hash."""
    chunks = checkpointed(chunked(docs, a_path, b_path, links, rows))
    listed = chunks.where("packed is null").select("chunk", F.explode("pairs").alias("pair"))
    answers = listed.join(counted(chunks), "pair").select("chunk", "pair", "n", "best", F.lit(False).alias("is_doc"))
    held = chunks.where("packed is not null").drop("pairs", "docs").withColumn("is_doc", F.lit(True))
    both = answers.unionByName(held, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "is_doc", "pair").mapInArrow(_summed, DIGEST)
