"""Language identification with a linear-chain conditional random field over words.

Every word of a text (a run of letters, lower-cased) gets a label. A word's potentials sum
learned weights of its character n-grams between boundaries (lengths 1 to 4; those that
touch a boundary are its affixes) and of its lexicon entry; learned transitions join
neighbouring words. Forward-backward gives each word's label distribution, so passages
of another language inside a text are labelled as such. The text's language is the label
with the largest expected number of words; the score is its expected share.

Weights are learned on a bounded sample of labelled rows (`SAMPLE_ROWS`, by id hash): the
segments of texts in different languages are spliced into training sequences, which is
what teaches the transitions how code-switched text changes language.

Inference is exact on whole texts of any length: words are cut into blocks whose transfer
matrices are multiplied side by side, a short recursion over the blocks carries the state
across them, and a second sweep inside the blocks gives the marginals. It is one pass
without a shuffle; each worker keeps potentials of recent distinct words.

Cases: null texts and texts without letters are `und` with score 0. Without labelled rows
every text is `und`. Ties go to the label that sorts first. Repeated rows are labelled
alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.training import chosen_texts, trained

SAMPLE_ROWS = 3_000
SEGMENT, SEGMENTS = 24, 6
BUCKETS = 1 << 16
BLOCK = 32
WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after another, and how many each word has."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in range(1, 5):
        if len(chars) < n:
            break
        h = np.full(len(chars) - n + 1, np.uint64(n))
        for k in range(n):
            h = (h ^ chars[k : len(chars) - n + 1 + k]) * _MIX
            h ^= h >> np.uint64(31)
        whole = owner[: len(h)] == owner[n - 1 :]
        found.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(h)][whole])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    entries = np.flatnonzero(known >= 0)
    found.append(BUCKETS + known[entries])
    owners.append(entries)
    owner, feature = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.bincount(owner, minlength=len(words))


def forward_backward(potentials: np.ndarray, transfer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [B, T, L] and expected transitions [L, L] of B sequences of one length."""
    b, t, n = potentials.shape
    e = np.exp(potentials - potentials.max(axis=2, keepdims=True))
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    state = np.full((b, n), 1.0 / n)
    for k in range(t):
        state = (state @ transfer) * e[:, k]
        state /= state.sum(axis=1, keepdims=True)
        alpha[:, k] = state
    for k in range(t - 2, -1, -1):
        ahead = (e[:, k + 1] * beta[:, k + 1]) @ transfer.T
        beta[:, k] = ahead / ahead.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    before = np.concatenate([np.full((b, 1, n), 1.0 / n), alpha[:, :-1]], axis=1)
    pair = before[:, :, :, None] * transfer * (e * beta)[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return marginal, pair.sum(axis=(0, 1))


class Field:
    """A fitted field: labels, feature weights and transitions."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 1) -> None:
        self.labels = sorted(set(langs))
        if not self.labels:
            return
        rng, n = np.random.default_rng(seed), len(self.labels)
        number = {x: i for i, x in enumerate(self.labels)}
        segments: list[tuple[list[str], int]] = []
        for text, lang in zip(texts, langs, strict=True):
            words = words_of(text)
            for at in np.unique(np.linspace(0, max(0, len(words) - SEGMENT), SEGMENTS).astype(int)):
                if len(words) - at >= SEGMENT:
                    segments.append((words[at : at + SEGMENT], number[lang]))
        counts = Counter(w for ws, _ in segments for w in ws)
        self.lexicon = {w: i for i, w in enumerate(sorted(w for w, c in counts.items() if c >= 3))}
        self.weights = np.zeros((BUCKETS + len(self.lexicon), n))
        self.log_transfer = np.zeros((n, n))
        if not segments:
            return
        vocabulary = {w: i for i, w in enumerate(counts)}
        feature, size = _features(list(vocabulary), self.lexicon)
        begin = np.concatenate([[0], np.cumsum(size)])
        ids = np.array([[vocabulary[w] for w in ws] for ws, _ in segments])
        label = np.array([y for _, y in segments])
        square, square_t, rate = np.full_like(self.weights, 1e-3), np.full_like(self.log_transfer, 1e-3), 0.3
        for _ in range(3):
            order = rng.permutation(len(segments))
            order = order[: len(order) // 2 * 2].reshape(-1, 2) if len(order) > 1 else order[None, :]
            for at in range(0, len(order), 64):
                pair = order[at : at + 64]
                words = ids[pair].reshape(len(pair), -1)
                truth = np.repeat(label[pair], SEGMENT, axis=1)
                distinct, inverse = np.unique(words, return_inverse=True)
                spans = np.concatenate([np.arange(begin[w], begin[w + 1]) for w in distinct])
                own, columns = np.repeat(np.arange(len(distinct)), size[distinct]), feature[spans]
                emission = np.stack([np.bincount(own, weights=self.weights[columns, k], minlength=len(distinct)) for k in range(n)], axis=1)
                marginal, pairs = forward_backward(emission[inverse].reshape(*words.shape, n), np.exp(self.log_transfer))
                miss = marginal.copy()
                np.put_along_axis(miss, truth[:, :, None], np.take_along_axis(miss, truth[:, :, None], 2) - 1, 2)
                scale = 1.0 / words.shape[0]
                per_word = np.stack([np.bincount(inverse.ravel(), weights=miss[:, :, k].ravel(), minlength=len(distinct)) for k in range(n)], axis=1) * scale
                touched, where = np.unique(columns, return_inverse=True)
                grad = np.stack([np.bincount(where, weights=per_word[own, k], minlength=len(touched)) for k in range(n)], axis=1) + 1e-5 * self.weights[touched]
                square[touched] += grad**2
                self.weights[touched] -= rate * 0.3 * grad / np.sqrt(square[touched])
                seen = np.zeros((n, n))
                np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
                np.add.at(seen, (slice(None), truth[:, 0]), 1.0 / n)
                grad_t = (pairs - seen) * scale + 1e-3 * self.log_transfer
                square_t += grad_t**2
                self.log_transfer -= rate * grad_t / np.sqrt(square_t)
        self.weights = self.weights.astype(np.float32)

    def potentials(self, words: list[str]) -> np.ndarray:
        feature, size = _features(words, self.lexicon)
        own = np.repeat(np.arange(len(words)), size)
        return np.stack([np.bincount(own, weights=self.weights[feature, k], minlength=len(words)) for k in range(len(self.labels))], axis=1)


class Labeller:
    """Expected label counts of whole texts."""

    def __init__(self, field: Field, limit: int = 400_000) -> None:
        self.field, self.limit = field, limit
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)), np.float32)

    def _ids(self, listed: list[list[str]]) -> list[np.ndarray]:
        wanted = {w for ws in listed for w in ws}
        new = wanted.difference(self.number)
        if len(self.number) + len(new) > self.limit:
            self.number, self.table, new = {}, self.table[:0], wanted
        if new:
            words, at = sorted(new), len(self.number)
            self.number.update(zip(words, range(at, at + len(words)), strict=True))
            parts = [self.field.potentials(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
            e = np.concatenate(parts)
            self.table = np.concatenate([self.table, np.exp(np.clip(e - e.max(axis=1, keepdims=True), -60, 0)).astype(np.float32)])
        return [np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws)) for ws in listed]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """[texts, labels]: expected number of words with each label."""
        listed = [words_of(t) for t in texts]
        listed = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in listed]  # other numerals are no letters
        ids = self._ids(listed)
        n, total = len(self.field.labels), np.zeros((len(texts), len(self.field.labels)))
        sizes = np.array([len(i) for i in ids])
        blocks = -(-sizes // BLOCK)
        if not blocks.sum():
            return total
        first = np.concatenate([[0], np.cumsum(blocks)])
        flat = np.full((first[-1], BLOCK), -1, np.int64)
        for i, at in zip(ids, first[:-1], strict=True):
            flat.reshape(-1)[at * BLOCK : at * BLOCK + len(i)] = i
        real = flat >= 0
        e = np.where(real[:, :, None], self.table[np.maximum(flat, 0)], np.float32(1))
        transfer = np.exp(self.field.log_transfer)
        product = np.broadcast_to(np.eye(n), (len(flat), n, n)).copy()
        for k in range(BLOCK):
            step = (product @ transfer) * e[:, k, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            product = np.where(real[:, k, None, None], step, product)
        enter, leave = np.full((len(flat), n), 1.0 / n), np.ones((len(flat), n))
        for k in range(1, int(blocks.max())):
            at = first[:-1][blocks > k] + k
            state = np.einsum("bi,bij->bj", enter[at - 1], product[at - 1])
            enter[at] = state / state.sum(axis=1, keepdims=True)
        for k in range(1, int(blocks.max())):
            at = first[1:][blocks > k] - 1 - k
            state = np.einsum("bij,bj->bi", product[at + 1], leave[at + 1])
            leave[at] = state / state.sum(axis=1, keepdims=True)
        alpha, state = np.zeros((BLOCK, len(flat), n), np.float32), enter
        for k in range(BLOCK):
            step = (state @ transfer) * e[:, k]
            step /= step.sum(axis=1, keepdims=True)
            state = np.where(real[:, k, None], step, state)
            alpha[k] = state
        owner, beta = np.repeat(np.arange(len(texts)), blocks), leave
        summed = np.zeros((len(flat), n))
        for k in range(BLOCK - 1, -1, -1):
            marginal = alpha[k] * beta
            marginal /= marginal.sum(axis=1, keepdims=True)
            summed += np.where(real[:, k, None], marginal, 0)
            back = (e[:, k] * beta) @ transfer.T
            beta = np.where(real[:, k, None], back / back.sum(axis=1, keepdims=True), beta)
        for k in range(n):
            total[:, k] = np.bincount(owner, weights=summed[:, k], minlength=len(texts))
        return total

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        at = 0
        while at < len(texts):
            to, room = at, 1_500_000  # characters taken together
            while to < len(texts) and (to == at or room > 0):
                room -= len(texts[to] or "")
                to += 1
            c = self.counts(texts[at:to])
            total = c.sum(axis=1)
            best = c.argmax(axis=1)
            names += [self.field.labels[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
            scores.append(np.where(total > 0, c.max(axis=1) / np.maximum(total, 1e-9), 0.0).clip(0, 1))
            at = to
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS) -> Field:
    """The field of at most `rows` labelled documents, by id hash; of several langs of one id the first counts."""
    known = docs.where("doc_id is not null and lang is not null")
    known = known.where(usable) if usable is not None else known
    named = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    least = named.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("lang"), "doc_id"), "doc_id").limit(rows)
    chosen = named.join(F.broadcast(least), "doc_id").groupBy("doc_id").agg(F.min("lang").alias("y"))
    return trained(chosen_texts(docs.where("lang is not null"), chosen), Field)


def label(docs: DataFrame, field: Field) -> Column:
    """struct(lang_pred, score) of docs.text."""
    if not field.labels:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for batch in batches:
            names, scores = labeller.label(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return labelled(F.col("text").cast("string"))
