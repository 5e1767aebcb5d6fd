"""Quality classification by gated-attention multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is described by counts
per word of character classes, by its repetition and by its word lengths, encoded by a
tanh layer h, and weighted by gated attention softmax(w . (tanh(V h) * sigmoid(U h))).
The weighted sum of the encodings is scored by a logistic output. All weights are learned
together from document labels by gradient descent on a bounded sample (`SAMPLE_ROWS`
labelled rows by id hash) in one task; the model is a few kilobytes and is broadcast.
Scoring is one pass over whole texts, no shuffle.

Cases: null and empty texts are one empty passage, scored like any other. Without labels,
or with labels of one class, every score is the labelled share of good texts (0 without
labels). Repeated rows are scored alike; extra columns are ignored. A very long text has
as many passages as it needs; they are encoded in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.training import labelled_sample, trained

PASSAGE = 64
SAMPLE_ROWS = 4_000
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&", "|<>", "!", "?", ".", ",", "\n", "@/\\:_=+~^{}[]()", "\"'`;-"]
_OTHER = len(_CLASSES)
_LOOKUP = np.full(256, _OTHER, dtype=np.uint8)
for _k, _letters in enumerate(_CLASSES):
    _LOOKUP[[ord(c) for c in _letters]] = _k
_LOOKUP[[ord(c) for c in " \t\r\x0b\x0c"]] = _OTHER + 1
WIDTH = _OTHER + 1 + 6


def passages(text: str | None) -> np.ndarray:
    """One row of WIDTH statistics a passage."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH))
    starts = np.arange(0, n, PASSAGE)
    if n - starts[-1] < PASSAGE // 4 and len(starts) > 1:
        starts = starts[:-1]  # a short rest joins the passage before it
    sizes = np.diff(np.append(starts, n))
    data = np.frombuffer(raw, np.uint8)
    kinds = _LOOKUP[data]
    space = (kinds == _OTHER + 1) | (data == 10)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    edges = np.append(first[starts], len(data))
    edges[0] = 0
    passage = np.repeat(np.arange(len(starts)), np.diff(edges))
    counts = np.bincount(passage * (_OTHER + 2) + kinds, minlength=len(starts) * (_OTHER + 2)).reshape(len(starts), -1)
    per_word = counts[:, : _OTHER + 1] / sizes[:, None]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    of = np.repeat(np.arange(len(starts)), sizes)
    same = np.concatenate([[0.0], (ids[1:] == ids[:-1]).astype(np.float64)])
    seen = np.zeros(n)
    _, index = np.unique(ids, return_index=True)
    seen[index] = 1.0  # first use in the text
    distinct = np.bincount(np.unique(of * len(number) + ids) // len(number), minlength=len(starts)) / sizes
    lengths = np.fromiter(map(len, words), np.float64, n)
    total = np.add.reduceat(lengths, starts) / sizes
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths * lengths, starts) / sizes - total**2, 0))
    extra = np.column_stack([np.add.reduceat(same, starts) / sizes, distinct, np.add.reduceat(seen, starts) / sizes, total / 8, spread / 8, np.minimum(sizes, PASSAGE) / PASSAGE])
    return np.column_stack([np.log1p(4 * per_word), extra])


class Attention:
    """Encoder, gated attention and output; weights in self.w."""

    def __init__(self, width: int = WIDTH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
        self.mean, self.dev = np.zeros(width), np.ones(width)
        self.w = {
            "E": draw(width, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "a": draw(GATE, 1)[:, 0], "o": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """bag: the number of each passage's document, rising."""
        w = self.w
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        h = np.tanh(z @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = np.clip((t * g) @ w["a"], -30, 30)
        raw = np.exp(s)
        attention = raw / np.bincount(bag, weights=raw, minlength=bags)[bag]
        pooled = np.stack([np.bincount(bag, weights=attention * h[:, k], minlength=bags) for k in range(HIDDEN)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["o"] + w["b"][0], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "attention": attention, "pooled": pooled, "p": p}

    def gradients(self, f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(y)
        d = (f["p"] - y) / n
        d_pool = d[:, None] * w["o"]
        d_h = f["attention"][:, None] * d_pool[bag]
        gain = (f["h"] * d_pool[bag]).sum(axis=1)
        d_s = f["attention"] * (gain - np.bincount(bag, weights=f["attention"] * gain, minlength=n)[bag])
        d_tg = d_s[:, None] * w["a"]
        d_v, d_u = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = d_h + d_v @ w["V"].T + d_u @ w["U"].T
        d_e = d_h * (1 - f["h"] ** 2)
        return {
            "E": f["z"].T @ d_e, "e": d_e.sum(axis=0), "V": f["h"].T @ d_v, "U": f["h"].T @ d_u,
            "a": (f["t"] * f["g"]).T @ d_s, "o": f["pooled"].T @ d, "b": np.array([d.sum()]),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Attention:
        every = np.concatenate(bags)
        self.mean, self.dev = every.mean(axis=0), every.std(axis=0) + 0.02
        rng = np.random.default_rng(3)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x = np.concatenate([bags[i] for i in rows])
                bag = np.repeat(np.arange(len(rows)), [len(bags[i]) for i in rows])
                g = self.gradients(self.forward(x, bag, len(rows)), bag, y[rows])
                step += 1
                for k in self.w:  # Adam
                    g[k] = g[k] + decay * self.w[k]
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 200):
            bags = [passages(t) for t in texts[at : at + 200]]
            bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            out.append(self.forward(np.concatenate(bags), bag, len(bags))["p"])
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str], labels: list[int]) -> Attention | float:
    """The model, or the share of good texts where labels can't be told apart."""
    y = np.array(labels, np.int64)
    if len(y) < 4 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return Attention().fit([passages(t) for t in texts], y.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = SAMPLE_ROWS) -> Attention | float:
    return trained(labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, rows), train)


def score(docs: DataFrame, model: Attention | float) -> Column:
    """The score of docs.text as a column."""
    if isinstance(model, float):
        return F.lit(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(batch.to_pylist()), pa.float64())

    return quality(F.col("text").cast("string"))
