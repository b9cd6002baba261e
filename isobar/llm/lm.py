"""Language-model scoring: marginal document probability over all subword segmentations.

A text is its lower-cased words and one end. A word's probability is the sum over all its
segmentations into pieces of an existing vocabulary, and a text's is the product over its words, as every
segmentation of the text is one of each word. The vocabulary's own scores weight the segmentations,
mixed evenly (ADAPT) with the pieces' expected uses over the lattices of all training words, each as
often as it occurs. A word follows, or the text ends, by their shares of training tokens. Beside it goes
the add-one word unigram base.

Words are counted over all texts. The HEAD_WORDS commonest travel to the workers as a broadcast of
bounded size; every other word of a text meets its count in a join on the word.

Defined results: null texts are empty, and an empty text is one end token; repeated rows are counted
and scored each; rows with null ``doc_id`` train and are not held out; with no training rows all counts
are 0 and the base is log10(1 / 1) per token; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_is, give_back, map_batches, map_chunks, table, written
from .lattice import Lattice, UnigramScores, adapted, initial_scores, read_vocabulary
from .textstats import encode

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Size bound of the broadcast: this many words at most, of at most this many bytes each.
HEAD_WORDS, HEAD_WORD_BYTES = 300_000, 64
#: Words held by a counting task before it hands on what it has.
COUNT_MEMORY = 500_000
#: Rounds of expected uses over the training words, and their share in the pieces' probabilities.
ROUNDS, ADAPT = 2, 0.5


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words."""
    return encode(text).lower().split()


def count_words(docs: DataFrame, trains: str) -> DataFrame:
    """(word, c): training count of every word of any text; 0 for words of held-out texts only."""

    def run(batches):
        seen, other = Counter(), set()

        def rows():
            words = [*seen, *(other - seen.keys())]
            counts = [*seen.values(), *repeat(0, len(words) - len(seen))]
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(counts[i : i + 50_000], pa.int64())], ["word", "c"])

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if train:
                    seen.update(tokens(text))
                else:
                    other.update(tokens(text))
                if len(seen) + len(other) > COUNT_MEMORY:
                    yield from rows()
                    seen, other = Counter(), set()
        yield from rows()
        seen, other = Counter(), set()
        give_back()

    return map_batches(docs.select("text", trains), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _word_blocks(batches, size: int = 50_000):
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            words = [w.decode("utf-8", "surrogatepass") for w in part.column(0).to_pylist()]
            yield part, words


def fit_scores(words: DataFrame, pieces: list[str], rounds: int = ROUNDS, adapt: float = ADAPT) -> UnigramScores:
    """The vocabulary's scores, mixed with uses in all training words; the driver gets one row per piece."""
    spark = words.sparkSession
    scores = own = initial_scores(len(pieces))
    known = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(scores)

        def run(batches, now=now):
            lattice = Lattice(known.value)
            total, in_bytes = np.zeros(lattice.n), 0.0
            for part, texts in _word_blocks(batches):
                used, more = lattice.expected(texts, part.column(1).to_numpy().astype(np.float64), now.value)
                total += used
                in_bytes += more
            at = np.nonzero(total > 1e-9)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], in_bytes), pa.float64())], ["piece", "used"])
            del lattice
            give_back()

        got = map_batches(words.filter("c > 0").select("word", "c"), run, "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
        counts = np.zeros(len(pieces))
        ids, used = got["piece"].to_numpy(), got["used"].to_numpy()
        counts[ids[ids >= 0]] = used[ids >= 0]
        scores = adapted(own, counts, float(used[ids < 0].sum()), adapt)
    return scores


def add_scores(words: DataFrame, scores: UnigramScores, pieces: list[str], n_words: int, n_docs: int) -> DataFrame:
    """(word, c, lp): lp is the natural log of the probability that a word follows and is this one."""
    sent = words.sparkSession.sparkContext.broadcast((pieces, scores))
    is_word = np.log((n_words + 1) / (n_words + n_docs + 1))

    def run(batches):
        lattice = Lattice(sent.value[0])
        for part, texts in _word_blocks(batches):
            lp = is_word + lattice.log_probability(texts, sent.value[1])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lp)], ["word", "c", "lp"])
        del lattice
        give_back()

    return map_batches(words.select("word", "c"), run, "word binary, c long, lp double")


def score(docs: DataFrame, trains, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score; ``trains`` marks training rows."""
    spark = docs.sparkSession
    pieces = read_vocabulary(vocabulary)
    rows = docs.select("doc_id", "text", trains.alias("trains"))
    counts = written(count_words(rows, "trains"), "lm-words")
    n_docs = rows.filter("trains").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()[0]
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    scores = fit_scores(counts, pieces)
    words = written(add_scores(counts, scores, pieces, sums["n"], n_docs), "lm-scores")
    is_head = F.octet_length("word") <= HEAD_WORD_BYTES
    head = words.filter(is_head).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    known = {w: i for i, w in enumerate(head["word"].to_pylist())}
    c = head["c"].to_numpy()
    log_n = float(np.log10(n + v + 1))
    tables = np.stack((np.log10(c + 1.0) - log_n, head["lp"].to_numpy() / np.log(10.0), c > 0), axis=1)
    sent = spark.sparkContext.broadcast((known, tables))
    end = float(np.log10((n_docs + 1) / (n + v + 1))), float(np.log10((n_docs + 1) / (n + 1)))

    def make():
        look, tab = sent.value
        part, made = TaskContext.get().partitionId(), 0

        def run(chunk):
            nonlocal made
            out: dict[str, list] = {k: [] for k in ("row", "word", "doc_id", "tf", "n_tokens", "n_known", "base", "score")}
            for doc_id, text in zip(chunk["doc_id"], chunk["text"], strict=True):
                row, made = (part << 40) + made, made + 1
                words = tokens(text)
                at = np.fromiter(map(look.get, words, repeat(-1)), np.int64, len(words))
                got = tab[at[at >= 0]].sum(axis=0)
                # the text's own row; its key is no word, as words hold no blank
                for k, x in (("row", row), ("word", b" %d" % row), ("doc_id", doc_id), ("tf", 0), ("n_tokens", len(words) + 1), ("n_known", int(got[2]) + (n_docs > 0)), ("base", got[0] + end[0]), ("score", got[1] + end[1])):
                    out[k].append(x)
                if len(got) and (at < 0).any():
                    rare = Counter(words[i] for i in np.nonzero(at < 0)[0])
                    k = len(rare)
                    out["row"] += [row] * k
                    out["word"] += rare.keys()
                    out["doc_id"] += [None] * k
                    out["tf"] += rare.values()
                    for x in ("n_tokens", "n_known"):
                        out[x] += [0] * k
                    for x in ("base", "score"):
                        out[x] += [0.0] * k
            return out

        return run

    parts = map_chunks(docs, ["doc_id", "text"], "row long, word binary, doc_id long, tf int, n_tokens long, n_known long, base double, score double", make)
    met = parts.join(words, "word", "left")
    rare = F.col("tf") > 0
    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(rare & (F.col("c") > 0), F.col("tf")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + F.when(rare, F.col("tf") * (F.log10(F.col("c") + 1.0) - log_n)).otherwise(0.0)).alias("base_score"),
            F.sum(F.col("score") + F.when(rare, F.col("tf") * F.col("lp") / float(np.log(10.0))).otherwise(0.0)).alias("score"),
        )
        .select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those that are not held out."""
    held = fold_is("doc_id", 7, 2)
    out = score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": judge}
