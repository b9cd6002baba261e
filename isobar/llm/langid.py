"""Language identification of whole and mixed texts.

Scripts narrow the candidate languages of every word; words get per-language scores from hashed
character n-grams; a Viterbi pass with a switching penalty labels the spans of each text.

Defined results: a null text, or one without any letter, is ``und`` with score 0 and no span; words
without letters carry no evidence and take the label around them; ties go to the language whose code
sorts first; repeated rows each get their own (equal) result; rows with null ``doc_id`` are predicted
and not held out; an empty table gives an empty result; with no labelled text at all every text is
``und``. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordRows, fold_is, map_chunks, table, word_grams

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Fitted on at most about this many texts of each language, chosen by hash of doc_id.
TEXTS_PER_LANGUAGE = 2_000
#: Up to this many languages the score table has BUCKETS rows; each doubling beyond halves them, down to LEAST_BUCKETS.
WIDE_LANGUAGES, LEAST_BUCKETS = 256, 1 << 12
SWITCH_PENALTY = 16.0
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01

# First code points of script ranges and the script that starts there ("" = none).
SCRIPTS = (
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00AA, "Latin"), (0x00AB, ""),
    (0x00B5, ""), (0x00BA, "Latin"), (0x00BB, ""), (0x00C0, "Latin"), (0x00D7, ""), (0x00D8, "Latin"), (0x00F7, ""),
    (0x00F8, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"),
    (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"),
    (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB07, ""), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x30000, ""),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS} - {""})
_BITS = np.array([1 << SCRIPT_NAMES.index(n) if n else 0 for _, n in SCRIPTS], np.uint32)


def _script_bits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the scripts of its letters as bits, and how many letters it has."""
    code = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = _BITS[np.searchsorted(_STARTS, code, "right") - 1]
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)[:-1]))
    return np.bitwise_or.reduceat(bits, starts), np.add.reduceat((bits > 0).astype(np.int64), starts)


@dataclass
class LanguageModel:
    """Learned languages in sorted order, their scripts as bits, and log scores by gram bucket."""

    langs: list[str]
    scripts: np.ndarray
    scores: np.ndarray

    def rows(self, words: list[str]) -> np.ndarray:
        """Per word: a score for each language, then the number of letters."""
        bits, letters = _script_bits(words)
        out = np.zeros((len(words), len(self.langs) + 1))
        for h, starts in word_grams(words, GRAMS):
            s = self.scores[(h % len(self.scores)).astype(np.int64)]
            s[h == 0] = 0
            out[:, :-1] += np.add.reduceat(s, starts, axis=0)
        out[:, :-1] /= len(GRAMS)
        out[:, :-1] -= out[:, :-1].max(axis=1, keepdims=True)
        fits = (self.scripts[None, :] & bits[:, None]) == bits[:, None]
        out[:, :-1] = np.where(fits | ~fits.any(axis=1, keepdims=True), out[:, :-1], -50.0)
        out[letters == 0] = 0
        out[:, -1] = letters
        return out.astype(np.float32)


def fit(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of these rows (all are training rows).

    The classifier is fitted on a bounded sample: about ``texts_per_language`` texts of every label. Gram
    counts are summed on the executors; the driver receives one row per language and bucket, and the
    buckets shrink as labels grow, so their product stays bounded.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], np.zeros(0, np.uint32), np.zeros((BUCKETS, 0)))
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * len(langs) > BUCKETS * WIDE_LANGUAGES:
        buckets //= 2
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, texts_per_language / r["count"])) for r in sizes], "lang string, share double")
    drawn = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))  # a row per label

    def make():
        def count(chunk):
            out = {"lang": [], "bucket": [], "n": []}
            for lang in sorted(set(chunk["lang"])):
                words = [w for x, y in zip(chunk["text"], chunk["lang"], strict=True) if y == lang for w in x.lower().split()]
                if not words:
                    continue
                unique, times = np.unique(np.array(words, dtype=object), return_counts=True)
                unique = unique.tolist()
                bits, letters = _script_bits(unique)
                kept = letters > 0
                total = np.zeros(buckets)
                for h, starts in word_grams(unique, GRAMS):
                    weight = np.repeat(times * kept, np.diff(np.append(starts, len(h))))
                    total += np.bincount((h % buckets).astype(np.int64), weight * (h > 0), buckets)
                at = np.nonzero(total)[0]
                for i in range(len(SCRIPT_NAMES)):  # negative buckets: letters by script
                    out["lang"].append(lang)
                    out["bucket"].append(-1 - i)
                    out["n"].append(float((letters * times)[(bits >> i) & 1 == 1].sum()))
                out["lang"] += [lang] * len(at)
                out["bucket"] += at.tolist()
                out["n"] += total[at].tolist()
            return out

        return count

    counted = map_chunks(drawn, ["lang", "text"], "lang string, bucket int, n double", make).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n, letters = np.zeros((buckets, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    col = counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    bucket, value = counted["bucket"].to_numpy(), counted["n"].to_numpy()
    n[bucket[bucket >= 0], col[bucket >= 0]] = value[bucket >= 0]
    letters[-1 - bucket[bucket < 0], col[bucket < 0]] = value[bucket < 0]
    used = letters >= np.maximum(SCRIPT_SHARE * letters.sum(axis=0), 1)
    scripts = (used * (1 << np.arange(len(SCRIPT_NAMES)))[:, None]).sum(axis=0).astype(np.uint32)
    smooth = 0.5
    scores = np.log((n + smooth) / (n.sum(axis=0) + smooth * buckets))
    return LanguageModel(langs, scripts, (scores - scores.mean(axis=1, keepdims=True)).astype(np.float32))


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; sequences run in lockstep, longest first.

    A sequence whose best single label can't be beaten is settled without the recursion: if no run
    of words favours another label by more than half the penalty, k switches gain at most
    (k + 1) / 2 penalties and cost k.
    """
    path = np.zeros(len(scores), np.int16)
    hard = []
    for d, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        if not n:
            continue
        e = scores[s : s + n].astype(np.float64)
        best = int(e.sum(axis=0).argmax())
        run = np.cumsum(np.vstack((np.zeros(e.shape[1]), e - e[:, best : best + 1])), axis=0)
        if (run - np.minimum.accumulate(run, axis=0)).max() <= penalty / 2:
            path[s : s + n] = best
        else:
            hard.append(d)
    if not hard:
        return path
    hard = np.array(hard)[np.argsort(-lengths[hard], kind="stable")]
    s, n = starts[hard], lengths[hard]
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), "left")
    score, k = np.zeros((len(hard), scores.shape[1])), np.arange(len(hard))
    stay, origin = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    for t in range(longest):
        a = active[t]
        at, now = s[:a] + t, score[:a]
        top = now.argmax(axis=1)
        floor = now[k[:a], top] - penalty
        kept = now >= floor[:, None]
        stay[at], origin[at] = kept, top
        score[:a] = np.where(kept, now, floor[:, None]) + scores[at]
    state = score.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at, now = s[:a] + t, state[:a]
        path[at] = now
        state[:a] = np.where(stay[at, now], now, origin[at])
    return path


def label(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Per row: the ``keep`` columns, lang_pred, score and spans.

    ``spans`` lists (first_word, last_word, lang) over white-space-separated words; ``lang_pred`` has
    the most letters in its spans and ``score`` is its share of all letters.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def make():
        m: LanguageModel = sent.value
        words = WordRows(m.rows, len(m.langs) + 1)

        def run(chunk):
            tokens, lengths = [], []
            for x in chunk["text"]:
                w = x.lower().split() if x else []
                tokens += w
                lengths.append(len(w))
            n = len(lengths)
            lengths = np.array(lengths, np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if n else lengths
            langs, shares, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if tokens and m.langs:
                at = words.lookup(tokens)
                rows = words.rows[at]
                letters = rows[:, -1].astype(np.int64)
                path = viterbi(rows[:, :-1], starts, lengths, penalty)
                for i in range(n):
                    s, e = starts[i], starts[i] + lengths[i]
                    if s == e or not (total := letters[s:e].sum()):
                        continue
                    by = np.bincount(path[s:e], letters[s:e], len(m.langs))
                    langs[i], shares[i] = m.langs[int(by.argmax())], float(by.max() / total)
                    cut = np.concatenate(([0], np.nonzero(np.diff(path[s:e]))[0] + 1, [e - s]))
                    spans[i] = [{"first_word": int(a), "last_word": int(b) - 1, "lang": m.langs[path[s + a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return {**{c: chunk[c] for c in keep}, "lang_pred": langs, "score": shares, "spans": spans}

        return run

    columns = [*keep] if "text" in keep else [*keep, "text"]
    return map_chunks(docs, columns, types + ", lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>", make)


def identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~fold_is("doc_id", 3, 1)))
    out = label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", fold_is("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op1_language_id": identify}
