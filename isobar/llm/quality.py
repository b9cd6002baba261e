"""Quality rules: exact base counts and a hashed logistic regression learned from labelled rows.

Defined results: null or empty texts have zero words and fail the base rule; rows with equal texts get
equal results; null labels teach nothing; a document teaches once per label it has, by the smallest of its
texts; probabilities of exactly MIN_PROBABILITY count as kept; with no usable label the probability is the constant 0.5 and the base rule decides alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, map_chunks, table
from .linear import LinearModel, Scorer, train
from .textstats import duplicate_lines, encode, repeated_words, symbols, word_chars

#: The model is fitted on at most this many labelled rows, those whose doc_id hashes lowest.
TRAIN_ROWS = 2_000
#: Fixed thresholds.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 20, 30, 0.5


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> LinearModel:
    """Learn P(quality = 1) from a bounded sample of labelled rows."""
    drawn = hashed_sample(labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality"), "doc_id", train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most train_rows short rows
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return train(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)).cast("int")), "quality")


def score(docs: DataFrame, model: LinearModel, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Base counts, base verdict, probability and final verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def run(chunk):
            raws = [encode(x) for x in chunk["text"]]
            tokens, lengths = [], []
            for r in raws:
                w = r.split()
                tokens += w
                lengths.append(len(w))
            lengths = np.array(lengths, np.int64)
            p, at = scorer(tokens, lengths)
            ends = np.cumsum(lengths)
            repeats = np.array([repeated_words(at[e - n : e]) for n, e in zip(lengths, ends, strict=True)], np.int64)
            failed = (lengths < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * lengths)
            return {
                "doc_id": chunk["doc_id"], "n_words": lengths, "word_chars": [word_chars(x or "") for x in chunk["text"]], "n_symbols": [symbols(x or "") for x in chunk["text"]],
                "n_dup_lines": [duplicate_lines(r) for r in raws], "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & (p >= min_probability), "probability": p,
            }

        return run

    return map_chunks(
        docs, ["doc_id", "text"],
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double", make,
    )


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality_rules": judge}
