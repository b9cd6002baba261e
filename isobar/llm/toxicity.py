"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on wording of toxic and one on wording of ordinary texts.
A window of text (by default one word with its blanks) is compressed with each; the share of the
ordinary length that the toxic dictionary saves is the window's distance. Calibrated distance thresholds
turn windows into hits, and a calibrated line turns a text's hits into a probability.

Defined results: null and empty texts have no window and get the score of a text without hits; null
labels teach nothing; a document teaches once per class it is labelled with, by the smallest of its
texts; scores of exactly 0.5 count as toxic; repeated rows get equal
results; without a toxic (or ordinary) training row every score is the share of toxic rows, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordRows, fold_is, hashed_sample, map_chunks, table
from .textstats import encode

#: Fitted on at most this many labelled rows of each class, those whose doc_id hashes lowest.
ROWS_PER_CLASS = 2_000
#: Size of each dictionary in bytes.
DICT_BYTES = 4_096
#: A word is toxic wording if its odds lean by MIN_RATIO and texts times log odds reach MIN_EVIDENCE.
MIN_RATIO, MIN_EVIDENCE = 4.0, 25.0
LEVEL = 7
#: Distances (hundredths) among which calibration chooses.
THRESHOLDS = (20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70)
#: Ends both dictionaries and every window: one long match on either side, so that zstandard's
#: smallest gain for a compressed block is always met and short windows are measured to the byte.
TRAILER = bytes(range(0x30, 0x5B))


@dataclass
class ToxicityModel:
    """Both dictionaries (raw content), the distance that makes a hit, and the calibrated line."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    bias: float
    slope: float


class Distance:
    """Compression distance of windows between both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=13, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)

        def coder(content: bytes):
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + TRAILER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

        self.toxic, self.ordinary = coder(toxic), coder(ordinary)

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        """Per window, in hundredths: the share of its cost under the ordinary dictionary that the toxic one saves."""
        a, b, empty = self.toxic.compress, self.ordinary.compress, len(self.ordinary.compress(TRAILER))
        toxic = np.fromiter((len(a(w + TRAILER)) for w in windows), np.int64, len(windows)) - empty
        ordinary = np.fromiter((len(b(w + TRAILER)) for w in windows), np.int64, len(windows)) - empty
        return (100 * (ordinary - toxic) // np.maximum(ordinary, 1)).reshape(-1, 1)


def windows_of(text: str | None) -> list[bytes]:
    """Lower-cased words, stripped of the punctuation around them, with a blank at each end."""
    return [b" " + w.strip(b".,;:!?\"'()[]*#$%&|<>") + b" " for w in encode(text.lower() if text else None).split()]


def _content(words: list[bytes]) -> bytes:
    """Dictionary content: the most telling wording last, where matches cost least."""
    out, size = [], 0
    for w in words:
        if size + len(w) > DICT_BYTES:
            break
        out.append(w)
        size += len(w)
    return b"".join(reversed(out))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Train both dictionaries and calibrate on a bounded sample of labelled rows (all are training rows).

    Half of the sample counts in how many texts of each class a word occurs. The toxic dictionary holds
    the words whose odds lean to toxic texts, the ordinary one the commonest of all other words. The
    other half sets the hit threshold and the line from hits to probability.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(b"", b"", 1, -30.0 if 0 in sizes or not sizes else 30.0, 0.0)
    drawn = hashed_sample(known.filter("toxic = 1"), "doc_id", rows_per_class).unionAll(hashed_sample(known.filter("toxic = 0"), "doc_id", rows_per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most 2 * rows_per_class short rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int"))

    def make_words():
        def run(chunk):
            out = {"word": [], "toxic": [], "half": [], "row": []}
            for text, y, half in zip(chunk["text"], chunk["toxic"], chunk["half"], strict=True):
                for w in set(windows_of(text)):
                    out["word"].append(w)
                    out["toxic"].append(y)
                    out["half"].append(half)
                    out["row"].append(1)
            return out

        return run

    words = map_chunks(rows, ["text", "toxic", "half"], "word binary, toxic int, half int, row int", make_words)
    counted = words.filter("half = 0").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    n = rows.filter("half = 0").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).collect()[0]
    nt, no = (n["t"] or 0) + 1, (n["o"] or 0) + 1
    lean = ((F.col("t") + 0.1) / nt) / ((F.col("o") + 0.1) / no)
    evidence = F.col("t") * F.log(lean)
    telling = (lean >= MIN_RATIO) & (evidence >= MIN_EVIDENCE)
    toxic = counted.filter(telling).orderBy(evidence.desc(), "word").limit(DICT_BYTES).collect()
    ordinary = counted.filter(~telling).orderBy((F.col("o") + F.col("t")).desc(), "word").limit(DICT_BYTES).collect()
    contents = _content([bytes(r["word"]) for r in toxic]), _content([bytes(r["word"]) for r in ordinary])

    def make_hits():
        far = Distance(*contents)

        def run(chunk):
            found = [far(windows_of(text))[:, 0] for text in chunk["text"]]
            return {"toxic": chunk["toxic"], "hits": [[int((d >= t).sum()) for t in THRESHOLDS] for d in found]}

        return run

    seen = map_chunks(rows.filter("half = 1"), ["text", "toxic"], "toxic int, hits array<int>", make_hits).collect()
    y = np.array([r["toxic"] for r in seen], np.float64)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, len(y) - y.sum()))  # back to the labelled proportions
    weight *= len(y) / max(weight.sum(), 1e-9)
    best = (np.inf, 1, -5.0, 5.0)
    for k, threshold in enumerate(THRESHOLDS):
        hits = np.array([r["hits"][k] for r in seen], np.float64)
        loss, bias, slope = _line(np.log1p(hits), y, weight)
        best = min(best, (loss, threshold, bias, slope))
    return ToxicityModel(*contents, best[1], best[2], best[3])


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic line with a light pull to zero slope; returns (loss, bias, slope)."""
    design, line = np.stack((np.ones_like(x), x), axis=1), np.array([-2.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        grad = design.T @ (weight * (p - y)) + np.array([1e-3, 0.05]) * line
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 0.05]), grad)
        line = line - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ line, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(weight * np.log(np.where(y == 1, p, 1 - p))).mean()), float(line[0]), float(max(line[1], 0.0))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, score, predicted, hits (windows nearer to toxic wording) and windows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: ToxicityModel = sent.value
        far = Distance(m.toxic, m.ordinary)
        words = WordRows(lambda new: far([w for x in new for w in windows_of(x)[:1]]), 1, np.int16)

        def run(chunk):
            tokens, lengths = [], []
            for x in chunk["text"]:
                w = x.lower().split() if x else []
                tokens += w
                lengths.append(len(w))
            at = words.lookup(tokens) if tokens else np.zeros(0, np.int64)
            hit = words.rows[at, 0] >= m.threshold
            total = np.concatenate(([0], np.cumsum(hit)))
            ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
            hits = total[ends] - total[ends - np.array(lengths, np.int64)]
            p = 1 / (1 + np.exp(-np.clip(m.bias + m.slope * np.log1p(hits), -30, 30)))
            return {"doc_id": chunk["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32), "hits": hits, "windows": lengths}

        return run

    return map_chunks(docs, ["doc_id", "text"], "doc_id long, score double, predicted int, hits long, windows long", make)


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~fold_is("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "score", "predicted", "hits")


QUERIES = {"op2_toxicity": judge}
