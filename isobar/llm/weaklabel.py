"""Quality classifier without labels: heuristic labellers, EM over their votes, a hashed linear scorer.

Each labeller votes good (1), junk (0) or abstains (-1) on a whole text. Expectation-maximisation over
the counts of vote patterns of all documents estimates every labeller's vote rates per class and the
class share; the posterior of a text's pattern is its weak label. Posteriors of a bounded, documented
sample train the hashed linear scorer, which then scores every text.

Defined results: posteriors of exactly MIN_SCORE count as good; a text without words (null included) scores 0 and is not kept; repeated rows are
counted and scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_chunks, table
from .linear import LinearModel, Scorer, train
from .textstats import duplicate_lines, encode, repeated_words, symbols

#: The scorer is fitted on at most this many distinct texts, those that hash lowest.
TRAIN_ROWS = 2_000
MIN_SCORE = 0.5


def _range_vote(value: float, good: tuple[float, float], junk_from: float | None) -> int:
    if good[0] <= value <= good[1]:
        return 1
    return 0 if junk_from is None or value >= junk_from else -1


def votes(text: str, words: list[bytes], ids: np.ndarray) -> list[int]:
    """The votes of all labellers on one text with at least one word."""
    n = len(words)
    times = Counter(text)
    letters = sum(k for c, k in times.items() if c.isalpha())
    upper = sum(k for c, k in times.items() if c.isupper())
    n_seen = max(1, len(text) - sum(k for c, k in times.items() if c.isspace()))
    lines = text.count("\n") + 1
    stops = text.count(".") + text.count("?") + text.count("!")
    return [
        _range_vote(symbols(text) / n, (0.0, 0.05), 0.3),
        _range_vote(upper / max(1, letters), (0.0, 0.2), 0.6) if n > 2 else -1,
        _range_vote(letters / n_seen, (0.88, 1.0), None) if letters / n_seen < 0.8 or letters / n_seen >= 0.88 else -1,
        _range_vote(text.count("!") / n, (0.0, 0.1), 0.5),
        0 if text.count("|") / n > 0.2 else -1 if "|" in text else 1,
        _range_vote(repeated_words(ids) / n, (0.0, 0.1), 0.5),
        0 if lines >= 8 and duplicate_lines(encode(text)) > 0.3 * lines else -1,
        _range_vote((len(text) - n) / n, (2.0, 14.0), None),
        -1 if n < 20 else _range_vote(1 - len(set(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))) / max(1, n - 1), (0.0, 0.25), 0.4),
        -1 if n < 20 else 1 if 0.02 <= stops / n <= 0.4 else -1 if stops / n <= 0.7 else 0,
    ]


N_LABELLERS = 10


def pattern_of(v: list[int]) -> int:
    """Votes as one number in base 3."""
    return sum((x + 1) * 3**i for i, x in enumerate(v))


@dataclass
class VoteModel:
    """Share of good texts, and per labeller the rates of (abstain, junk, good) votes by class."""

    good: float
    rates: np.ndarray  # labeller, class (0 junk, 1 good), vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each pattern; exactly the class share where every labeller abstains alike."""
        log = np.log([1 - self.good, self.good])[None, :].repeat(len(patterns), axis=0)
        for i in range(len(self.rates)):
            log += np.log(self.rates[i].T[patterns // 3**i % 3])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


#: Rates of (abstain, junk, good) that the estimation starts from: a labeller knows few kinds of junk but seldom calls good text junk.
PRIOR = np.array([[0.1, 0.3, 0.6], [0.2, 0.005, 0.795]])
#: The start counts as this many texts of each class in the estimate, whatever the number of texts.
PRIOR_ROWS = 50
#: Share of good texts that the estimation starts from.
GOOD = 0.8


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> VoteModel:
    """EM from the prior rates; they stay as a few pseudo-texts, so that no rate is 0."""
    model = VoteModel(GOOD, np.repeat(PRIOR[None], N_LABELLERS, axis=0))
    if not len(patterns):
        return model
    total = counts.sum()
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack((counts * (1 - p), counts * p))
        rates = np.empty_like(model.rates)
        for i in range(N_LABELLERS):
            vote = patterns // 3**i % 3
            rate = np.stack([np.bincount(vote, w, 3) for w in weight]) + PRIOR * PRIOR_ROWS
            rates[i] = rate / rate.sum(axis=1, keepdims=True)
        model = VoteModel(float((weight[1].sum() + GOOD * PRIOR_ROWS) / (total + PRIOR_ROWS)), rates)
    return model


@dataclass
class WeakModel:
    """The vote model and the scorer trained on its posteriors."""

    votes: VoteModel
    scorer: LinearModel


def _vote_chunks(docs: DataFrame, keep: tuple[str, ...] = (), model: VoteModel | None = None) -> DataFrame:
    """The ``keep`` columns, pattern (-1 without words), and with a model its posterior as target."""
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    more = ", target double" if model else ""

    def make():
        def run(chunk):
            out = []
            for text in chunk["text"]:
                words = encode(text).split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                out.append(pattern_of(votes(text, words, ids)) if words else -1)
            target = {"target": model.posterior(np.maximum(out, 0))} if model else {}
            return {**{c: chunk[c] for c in keep}, "pattern": out, **target}

        return run

    return map_chunks(docs, list(dict.fromkeys([*keep, "text"])), types + "pattern int" + more, make)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> WeakModel:
    """Vote rates from all rows; the scorer from at most ``train_rows`` distinct texts (the documented bound)."""
    counted = _vote_chunks(docs).filter("pattern >= 0").groupBy("pattern").count().toPandas()  # at most 3^labellers rows
    rates = estimate(counted["pattern"].to_numpy(np.int64), counted["count"].to_numpy(np.float64))
    total = max(1, int(counted["count"].sum()))
    if not len(counted):
        return WeakModel(rates, LinearModel(np.zeros(1 << 16), 1.0, 1.0))
    share = min(1.0, 1.5 * train_rows / total)  # so that copies leave enough texts, and few reach the ordering
    h = F.xxhash64(F.lit(10), "text")
    drawn = docs.select("text", h.alias("h")).filter(F.pmod("h", F.lit(1 << 24)) < share * (1 << 24))
    drawn = drawn.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(train_rows)
    drawn = _vote_chunks(drawn, ("h", "text"), rates).filter("pattern >= 0")
    return WeakModel(rates, train(drawn.withColumn("fold", F.pmod(F.xxhash64("h", F.lit(11)), F.lit(10)).cast("int")), "target"))


def score(docs: DataFrame, model: WeakModel, keep: tuple[str, ...] = ("doc_id",), min_score: float = MIN_SCORE) -> DataFrame:
    """Per row: the ``keep`` columns, score (P(good) by the linear scorer) and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model.scorer)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def make():
        scorer = Scorer(sent.value)

        def run(chunk):
            tokens, lengths = [], []
            for text in chunk["text"]:
                w = encode(text).split()
                tokens += w
                lengths.append(len(w))
            lengths = np.array(lengths, np.int64)
            p = np.where(lengths > 0, scorer(tokens, lengths)[0], 0.0)
            return {**{c: chunk[c] for c in keep}, "score_": p, "kept_": p >= min_score}

        return run

    return map_chunks(docs, list(dict.fromkeys([*keep, "text"])), types + ", score_ double, kept_ boolean", make)


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)).select("doc_id", F.col("score_").alias("score"), F.col("kept_").alias("kept"))


QUERIES = {"op10_quality_classifier": judge}
