"""Toxicity from class-conditional Kneser-Ney models.

Words are spelled between boundaries and read by two character models of order `ORDER`,
one learned from toxic texts, one from ordinary texts. The highest order is interpolated
absolute discounting of the class's own counts; what it discounts goes to lower orders of
shared Kneser-Ney continuation counts (distinct left contexts over both classes), so a
spelling that is rare in both classes gets nearly the same probability from either and
says little. A word's evidence is the difference of its log-likelihoods per character
times its length; a text's is compared after normalising by length: mean over all words,
the share of strongly toxic words, the strongest word. A logistic regression over these,
fitted on texts the counts have not seen, gives the score.

The models are fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, by id hash) in
one task and broadcast: their size is bounded by the sample. Scoring is one pass of
whole texts, no shuffle; each worker keeps the evidence of recent distinct words.

Cases: null and empty texts have no words and get the score of no evidence. Without
labels, or with labels of one class, every score is the labelled share of toxic (0
without labels). Repeated rows are scored alike; extra columns are ignored. Long words
are spelled whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.training import fit_logistic, labelled_sample, logistic, trained

ORDER = 5
SAMPLE_ROWS = 5_000
THRESHOLD = 0.3
STRONG = 3.0
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER characters at each character of the words and their ends, and its word."""
    pad = "\x02" * (ORDER - 1)
    text = "".join(f"{pad}{w}\x03" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.flatnonzero(place >= ORDER - 1)
    return chars[ends[:, None] - np.arange(ORDER - 1, -1, -1)], np.repeat(np.arange(len(words)), sizes - ORDER + 1)


def _key(columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's characters."""
    h = np.full(len(columns), np.uint64(columns.shape[1]))
    for k in range(columns.shape[1]):
        h = (h ^ columns[:, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class _Table:
    """key -> value by binary search; 0 or a default where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float64)

    def get(self, keys: np.ndarray, default: float = 0.0) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


def _level(grams: np.ndarray, counts: np.ndarray) -> tuple[_Table, _Table]:
    """Discounted part of each gram and the weight that its context leaves to lower orders."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    context, inverse = np.unique(_key(grams[:, :-1]), return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    left = np.bincount(inverse, weights=np.minimum(counts, discount))
    part = np.maximum(counts - discount, 0) / total[inverse]
    return _Table(_key(grams), part), _Table(context, left / total)


class ClassModels:
    """Two highest orders over shared lower orders."""

    def __init__(self, toxic: Counter, ordinary: Counter) -> None:
        own = []
        for counter in (toxic, ordinary):
            words = list(counter)
            grams, word = _grams(words)
            weight = np.fromiter(counter.values(), np.float64, len(words))[word]
            _, first, inverse = np.unique(_key(grams), return_index=True, return_inverse=True)
            own.append((grams[first], np.bincount(inverse, weights=weight)))
        self.classes = [_level(g, c) for g, c in own]
        both = np.concatenate([g for g, _ in own])
        _, first = np.unique(_key(both), return_index=True)
        higher, self.shared = both[first], []
        for _ in range(ORDER - 1):  # counts of distinct left contexts
            lower = higher[:, 1:]
            _, first, inverse = np.unique(_key(lower), return_index=True, return_inverse=True)
            higher = lower[first]
            self.shared.append(_level(higher, np.bincount(inverse).astype(np.float64)))
        self.shared.reverse()

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        grams, word = _grams(words)
        _, first, inverse = np.unique(_key(grams), return_index=True, return_inverse=True)
        distinct = grams[first]
        p = np.full(len(distinct), 1e-5)
        for width, (part, left) in enumerate(self.shared, 1):
            tail = distinct[:, ORDER - width :]
            p = part.get(_key(tail)) + left.get(_key(tail[:, :-1]), 1.0) * p
        logs = [np.log(part.get(_key(distinct)) + left.get(_key(distinct[:, :-1]), 1.0) * p) for part, left in self.classes]
        return np.bincount(word, weights=(logs[0] - logs[1])[inverse], minlength=len(words))


class WordEvidence(dict):
    """Evidence of recent distinct words; missing ones are computed together."""

    def __init__(self, models: ClassModels, limit: int = 200_000) -> None:
        super().__init__()
        self.models, self.limit = models, limit

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        listed = [words_of(t) for t in texts]
        wanted = set(chain.from_iterable(listed)).difference(self)
        if len(self) + len(wanted) > self.limit:
            self.clear()
            wanted = set(chain.from_iterable(listed))
        new = list(wanted)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.update(zip(part, self.models.evidence(part).tolist(), strict=True))
        return [np.fromiter(map(self.__getitem__, ws), np.float64, len(ws)) for ws in listed]


def _features(evidence: np.ndarray) -> list[float]:
    n = len(evidence)
    if not n:
        return [0.0, 0.0, 0.0, 0.0]
    strong = np.maximum(evidence - STRONG, 0)
    return [float(evidence.mean()), float(np.sqrt(strong.sum() / n)), float(np.log1p(strong.sum())), float(max(evidence.max(), 0.0))]


class Scorer:
    """Fitted models and calibration; picklable, of bounded size."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        y = np.array(labels, np.int64)
        self.share = float(y.mean()) if len(y) else 0.0
        self.models = None
        if len(y) < 4 or y.min() == y.max():
            return
        half = np.zeros(len(y), dtype=bool)
        for label in (0, 1):  # each fold with half of either class
            half[np.flatnonzero(y == label)[::2]] = True
        counts = {(fold, label): Counter() for fold in (True, False) for label in (0, 1)}
        for text, fold, label in zip(texts, half.tolist(), y.tolist(), strict=True):
            counts[fold, label].update(words_of(text))
        x = np.zeros((len(y), 4))
        for fold in (True, False):
            cache = WordEvidence(ClassModels(counts[fold, 1], counts[fold, 0]))
            rows = np.flatnonzero(half != fold)
            for at in range(0, len(rows), 200):
                part = rows[at : at + 200]
                x[part] = [_features(e) for e in cache.of([texts[i] for i in part])]
        self.calibration = fit_logistic(x, y.astype(np.float64))
        for label in (0, 1):
            counts[True, label].update(counts.pop((False, label)))
        self.models = ClassModels(counts[True, 1], counts[True, 0])

    def score(self, texts: list[str | None], cache: WordEvidence) -> np.ndarray:
        found = [np.array([_features(e) for e in cache.of(texts[at : at + 500])]) for at in range(0, len(texts), 500)]
        return logistic(self.calibration, np.concatenate(found)) if found else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS) -> Scorer:
    return trained(labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, rows), Scorer)


def score(docs: DataFrame, scorer: Scorer) -> Column:
    """The score of docs.text as a column."""
    if scorer.models is None:
        return F.lit(scorer.share)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        cache = WordEvidence(model.models)
        for batch in batches:
            yield pa.array(model.score(batch.to_pylist(), cache), pa.float64())

    return toxic(F.col("text").cast("string"))
