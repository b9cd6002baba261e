"""A hashed linear text scorer: words, character n-grams within words, and word pairs.

A text's features are its hashed words, their character n-grams and the pairs of neighbouring words,
each as a share of all its features, so texts of any length are on one scale. Sums per distinct word
are kept by the worker, so scoring costs a lookup per word and one gather per pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import WordRows, map_chunks, mix64, word_grams, word_hashes
from .textstats import encode

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Scale of the shares; with it, weights of order one separate the classes.
SCALE = 20.0
STEPS, RATE = 60, 0.1
_PAIR = np.uint64(0xD1342543DE82EF95)


@dataclass
class LinearModel:
    """Weights by bucket and the calibrated line: probability = logistic(slope * raw + bias)."""

    weights: np.ndarray
    slope: float
    bias: float


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word index) of every feature inside words, and each word's 64-bit hash."""
    hashes = word_hashes(words)
    buckets, owner = [(mix64(hashes) % BUCKETS).astype(np.int64)], [np.arange(len(words))]
    for h, starts in word_grams(words, GRAMS):
        ids = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(h))))
        buckets.append((h[h > 0] % BUCKETS).astype(np.int64))
        owner.append(ids[h > 0])
    return np.concatenate(buckets), np.concatenate(owner), hashes


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring word pairs."""
    return (mix64(hashes[:-1] * _PAIR + hashes[1:]) % BUCKETS).astype(np.int64)


class Scorer:
    """Raw scores of tokenised texts under one model."""

    def __init__(self, model: LinearModel):
        self.model, self.words = model, WordRows(self._rows, 2, np.float64)
        self.hashes = np.zeros(1024, np.uint64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        bucket, owner, hashes = word_features([w.decode("utf-8", "surrogatepass") for w in words])
        out = np.zeros((len(words), 2))
        out[:, 0] = np.bincount(owner, self.model.weights[bucket], len(words))
        out[:, 1] = np.bincount(owner, minlength=len(words))
        first = self.words[words[0]]
        if first + len(words) > len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros(max(len(words) + first, len(self.hashes)), np.uint64)))
        self.hashes[first : first + len(words)] = hashes
        return out

    def __call__(self, tokens: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probability per text, word numbers); lengths partition the tokens."""
        raw = np.zeros(len(lengths))
        at = self.words.lookup(tokens) if tokens else np.zeros(0, np.int64)
        if tokens:
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            has = lengths > 0
            total = np.zeros((len(lengths), 2))
            total[has] = np.add.reduceat(self.words.rows[at], starts[has], axis=0)
            if len(tokens) > 1:
                pair = np.append(self.model.weights[pair_buckets(self.hashes[at])], 0.0)
                pair[(starts + lengths - 1)[has]] = 0.0
                total[has, 0] += np.add.reduceat(pair, starts[has])
                total[has, 1] += lengths[has] - 1
            raw[has] = SCALE * total[has, 0] / total[has, 1]
        return 1 / (1 + np.exp(-np.clip(self.model.slope * raw + self.model.bias, -30, 30))), at


def shares_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A text's feature buckets and each one's share of its features."""
    names, inverse = np.unique(np.array(words, dtype=object), return_inverse=True)
    times = np.bincount(inverse)
    bucket, owner, hashes = word_features([w.decode("utf-8", "surrogatepass") for w in names])
    total = np.bincount(bucket, times[owner], BUCKETS)
    if len(words) > 1:
        total += np.bincount(pair_buckets(hashes[inverse]), minlength=BUCKETS)
    at = np.nonzero(total)[0]
    return at.astype(np.int32), (total[at] / total.sum()).astype(np.float32)


def sparse_rows(df: DataFrame, target: str) -> DataFrame:
    """Per row with words: its feature shares as (buckets, shares), the target and the fold."""

    def make():
        def run(chunk):
            out = {"target": [], "fold": [], "buckets": [], "shares": []}
            for text, y, fold in zip(chunk["text"], chunk[target], chunk["fold"], strict=True):
                if words := encode(text).split():
                    at, share = shares_of(words)
                    for k, v in (("target", float(y)), ("fold", fold), ("buckets", at), ("shares", share)):
                        out[k].append(v)
            return out

        return run

    return map_chunks(df, ["text", target, "fold"], "target double, fold int, buckets array<int>, shares array<float>", make)


def train(sample: DataFrame, target: str, steps: int = STEPS) -> LinearModel:
    """Fit logistic regression on a bounded sample (columns text, the target in 0..1, fold).

    Nine tenths of the sample fit the weights; the rest (fold 0) calibrates slope and bias, so the
    probability is one for the sampled population. An empty or one-sided sample gives the constant
    share of the target.
    """
    rows = sparse_rows(sample, target).toArrow().combine_chunks()
    if not len(rows):
        return LinearModel(np.zeros(BUCKETS), 1.0, 0.0)
    lists, shares = (rows[c].chunk(0) for c in ("buckets", "shares"))
    return fit_rows(rows["target"].to_numpy(), rows["fold"].to_numpy(), lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values.to_numpy(), shares.values.to_numpy(), steps)


def fit_rows(y: np.ndarray, fold: np.ndarray, starts: np.ndarray, bucket: np.ndarray, share: np.ndarray, steps: int) -> LinearModel:
    """Full-batch logistic regression over sparse rows with per-weight step sizes, then calibration."""
    if y.max() - y.min() < 1e-9:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return LinearModel(np.zeros(BUCKETS), 1.0, float(np.log(p / (1 - p))))
    value, length = share * np.float32(SCALE), np.diff(np.append(starts, len(bucket)))
    fit = fold != 0
    if not fit.any() or y[fit].max() - y[fit].min() < 1e-9:
        fit[:] = True
    w, b, g2, gb2 = np.zeros(BUCKETS), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.full(BUCKETS, 1e-12), 1e-12

    def raw():
        return np.add.reduceat(w[bucket] * value, starts)

    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(raw() + b, -30, 30))) - y) * fit / fit.sum()
        g = np.bincount(bucket, np.repeat(r, length) * value, BUCKETS)
        g2, gb2 = g2 + g * g, gb2 + r.sum() ** 2
        w -= RATE * g / np.sqrt(g2)
        b -= RATE * r.sum() / np.sqrt(gb2)
    left = ~fit if (~fit).sum() >= 50 and y[~fit].max() - y[~fit].min() > 0.5 else np.ones(len(y), bool)
    x, t, line = raw()[left], y[left], np.array([1.0, b])
    ones = t.sum()
    t = (t * (ones + 1) / (ones + 2)) + (1 - t) / (len(t) - ones + 2)  # smoothed targets: separable classes stay finite
    design = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (p - t) + 1e-3 * (line - np.array([1.0, b])))
        line = line - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return LinearModel(w.astype(np.float32), float(max(line[0], 1e-3)), float(line[1]))
