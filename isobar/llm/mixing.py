"""Mixing sources to target weights: temperature on token shares, realised as block permutations.

A source's weight is its token share to the power of an exponent between 0 (even) and 1 (as found). The
exponent is bisected to the target entropy, and raised again where a source would have to repeat more
often than allowed. Each source then gets a token budget: whole passes over all its documents, and one
last pass that is cut where the budget ends. A pass is a permutation in blocks: a keyed hash deals the
documents into blocks of about BLOCK_TOKENS tokens and orders them within. The cut is found by narrowing
the range of hashes, so at most ORDER_ROWS documents of a source are ever put in order.

Sources are rows of a table throughout, so there may be as many as there are hosts.

Defined results: a null source counts as the source ''; null texts have no tokens, and documents without
tokens go with whole passes (and with the last pass up to its cut); documents of one hash go by their
text, and rows that are alike in both by their number in the prepared table, so a budget is met to one
document; without that number they go all or none; repeated rows are mixed each; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Entropy to reach, as a share of the way from the found mixture to an even one.
TARGET = 0.5
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 16
SEED = 9
#: Rows of a source that are put in order, and hash bits that one step of the search for its cut resolves.
ORDER_ROWS, STEP_BITS = 10_000, 12
#: Exponents tried at once, and how often the range around the best is narrowed to the next two.
GRID, NARROWINGS = 64, 6
#: A table of sources travels to the rows if it has at most this many bytes; else both meet in a join.
NEAR_BYTES = 32 << 20
# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class SourcePlan:
    """A source's weight, whole passes, and where its last pass ends (hash and row of the last document)."""

    source: str
    tokens: int
    weight: float
    budget: int
    passes: int
    blocks: int
    cut_hash: int | None = None
    cut_row: int | None = None


@dataclass
class MixPlan:
    """The plan of every source, as a table of rows like SourcePlan; iterating collects it (to look at)."""

    rows: DataFrame

    def __iter__(self) -> Iterator[SourcePlan]:
        names = SourcePlan.__dataclass_fields__
        return iter([SourcePlan(*(r[n] for n in names)) for r in self.rows.orderBy("source").collect()])

    def __len__(self) -> int:
        return self.rows.count()


def entropy(weights: list[float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares to a power, normalised."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    return [r / sum(raised) for r in raised]


def _least(good: Callable[[np.ndarray], np.ndarray]) -> float:
    """The least exponent from 0 to 1 that is good, if all beyond it are; GRID are tried at a time."""
    lo, hi = 0.0, 1.0
    for _ in range(NARROWINGS):
        tried = np.linspace(lo, hi, GRID + 1)
        ok = np.flatnonzero(good(tried))
        if not len(ok):
            return hi
        if ok[0] == 0:
            return float(tried[0])
        lo, hi = float(tried[ok[0] - 1]), float(tried[ok[0]])
    return hi


def _solve(moments: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, least: float, target: float, budget_ratio: float, max_repeats: float) -> float:
    """From ``moments(exponents)``: the sums over shares s of s ** a and of s ** a * log(s).

    Entropy falls and the largest repetition (that of the least share) falls as the exponent grows.
    """
    if n < 2:
        return 1.0

    def entropies(a):
        z, slog = moments(a)
        return np.log(z) - a * slog / z

    found = float(entropies(np.ones(1))[0])
    goal = found + target * (math.log(n) - found)
    allowed = max(max_repeats, budget_ratio) * (1 + 1e-12)
    by_entropy = _least(lambda a: entropies(a) <= goal + 1e-15)
    by_repeats = _least(lambda a: budget_ratio * least ** (a - 1) / moments(a)[0] <= allowed)
    return max(by_entropy, by_repeats)


def solve_exponent(shares: list[float], target: float, budget_ratio: float, max_repeats: float) -> float:
    """The exponent whose entropy is ``target`` of the way to even, or the least that respects the repeats.

    ``budget_ratio`` is the token budget over the tokens there are.
    """
    live = np.array([s for s in shares if s > 0])

    def moments(a):
        raised = live[None, :] ** a[:, None]
        return raised.sum(axis=1), (raised * np.log(live)).sum(axis=1)

    return _solve(moments, len(live), float(live.min()) if len(live) else 1.0, target, budget_ratio, max_repeats)


def _source() -> Column:
    return F.coalesce("source", F.lit(""))


def _hash(seed: int, epoch: Column, tie: Column | None = None) -> Column:
    """63 bits, the same for a document and pass everywhere."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), *([] if tie is None else [tie])), 1)


def _unit(h: Column) -> Column:
    return h / F.lit(float(1 << 63))


def _order(rows: DataFrame, seed: int, epoch: Column) -> tuple[Column, Column]:
    """What a pass sorts by: the hash, and the row's number if the rows were prepared."""
    return _hash(seed, epoch, F.col("mix_tie") if "mix_tie" in rows.columns else None), F.col("mix_row") if "mix_row" in rows.columns else F.lit(0).cast("long")


def prepare(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns, n_tokens (words), and what tells rows of one hash apart: mix_tie and mix_row; written."""
    counted = docs.select(*keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("text").alias("mix_tie"))
    return written(counted.withColumn("mix_row", F.monotonically_increasing_id()), "mixing-rows")


def _meet(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join on mix_key; the table of sources is broadcast only behind a check of its size."""
    size = sources.agg(F.sum(F.octet_length("mix_key") + 100).alias("n")).first()["n"] or 0
    return rows.join(F.broadcast(sources) if size <= NEAR_BYTES else sources, "mix_key")


def plan(counted: DataFrame, budget: int | None = None, target: float = TARGET, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> MixPlan:
    """Weights, budgets and cuts from (doc_id, source, n_tokens); the driver gets sums only."""
    totals = written(counted.groupBy(_source().alias("mix_key")).agg(F.sum("n_tokens").alias("tokens")), "mixing-sources")
    live = F.col("tokens") > 0
    sums = totals.agg(F.sum("tokens").alias("n"), F.count_if(live).alias("k"), F.min(F.when(live, F.col("tokens"))).alias("least")).first()
    whole = sums["n"] or 0
    if not whole:
        none = totals.select(F.col("mix_key").alias("source"), F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("passes"), F.lit(1).cast("long").alias("blocks"))
        return MixPlan(none.withColumns({"cut_hash": F.lit(None).cast("long"), "cut_row": F.lit(None).cast("long")}))
    budget = whole if budget is None else budget
    share = F.col("tokens") / F.lit(float(whole))

    def moments(exponents):
        cells = [F.sum(F.pow(share, F.lit(float(a))) * x) for a in exponents for x in (F.lit(1.0), F.log(share))]
        got = np.array(totals.filter(live).agg(*cells).first(), float).reshape(-1, 2)
        return got[:, 0], got[:, 1]

    a = _solve(moments, sums["k"], sums["least"] / whole, target, budget / whole, max_repeats)
    z = float(moments(np.array([a]))[0][0])
    weight = F.when(live, F.pow(share, F.lit(a)) / z).otherwise(0.0)
    planned = totals.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
    planned = planned.withColumn("passes", F.when(live, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long"))
    planned = written(planned.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")), "mixing-planned")
    cuts = _cuts(counted, planned.filter("tokens > 0").select("mix_key", "passes", (F.col("budget") - F.col("passes") * F.col("tokens")).alias("mix_left")), seed)
    return MixPlan(written(planned.join(cuts, "mix_key", "left").withColumnRenamed("mix_key", "source"), "mixing-plan"))


def _cuts(counted: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(mix_key, cut_hash, cut_row): where the last pass of each source ends, inclusive.

    Each step counts the tokens in 2 ** STEP_BITS parts of a source's range and goes on in the part that
    holds the cut; first by hash, then, where rows share one, by row. It ends when few rows are left.
    """
    h, row = _order(counted, seed, F.col("passes"))
    rows = _meet(counted.withColumn("mix_key", _source()), sources.select("mix_key", "passes")).select("mix_key", h.alias("h"), row.alias("row"), "n_tokens")
    state = sources.select("mix_key", "mix_left", F.lit(0).cast("long").alias("c0"), F.lit(0).cast("long").alias("c1"))
    by_key = Window.partitionBy("mix_key")
    column, low = 0, 63  # the key part being narrowed, and its bits that are still open
    while True:
        within = (F.shiftright("h", low) == F.col("c0")) if column == 0 else (F.col("h") == F.col("c0")) & (F.shiftright("row", low) == F.col("c1"))
        if low == 63:  # nothing of this part is fixed yet
            within = F.lit(True) if column == 0 else F.col("h") == F.col("c0")
        inside = _meet(rows, state).filter(within)
        bits = min(STEP_BITS, low)
        digit = F.shiftright("h" if column == 0 else "row", low - bits).bitwiseAND((1 << bits) - 1)
        sums = inside.groupBy("mix_key", "mix_left", "c0", "c1", digit.alias("digit")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
        sums = sums.withColumn("upto", F.sum("n").over(by_key.orderBy("digit"))).filter("upto > mix_left")  # at most 2 ** STEP_BITS rows a source
        first = sums.groupBy("mix_key").agg(F.min(F.struct("digit", (F.col("mix_left") - F.col("upto") + F.col("n")).alias("room"), "c0", "c1", "k")).alias("x"))
        part = F.shiftleft(F.col("x.c0" if column == 0 else "x.c1"), bits) + F.col("x.digit")
        c0, c1 = (part, F.col("x.c1")) if column == 0 else (F.col("x.c0"), part)
        state = written(first.select("mix_key", F.col("x.room").alias("mix_left"), c0.alias("c0"), c1.alias("c1"), F.col("x.k").alias("k")), "mixing-cut")
        low -= bits
        most = state.agg(F.max("k").alias("k")).first()["k"] or 0
        state = state.drop("k")
        if most <= ORDER_ROWS or low == 0 and (column == 1 or "mix_row" not in counted.columns):
            break
        if low == 0:
            column, low = 1, 63
    within = (F.shiftright("h", low) == F.col("c0")) if column == 0 else (F.col("h") == F.col("c0")) & (F.shiftright("row", low) == F.col("c1"))
    upto = F.sum("n_tokens").over(by_key.orderBy("h", "row"))  # rows that are alike in both count together
    fits = _meet(rows, state).filter(within).withColumn("upto", upto).filter("upto <= mix_left")
    last = fits.groupBy("mix_key").agg(F.max(F.struct("h", "row")).alias("last"))
    if column == 0:
        before = F.shiftleft("c0", low) - 1, F.lit((1 << 63) - 1)
    else:
        before = F.col("c0"), F.shiftleft("c1", low) - 1
    return state.join(last, "mix_key", "left").select("mix_key", F.coalesce("last.h", before[0]).alias("cut_hash"), F.coalesce("last.row", before[1]).alias("cut_row"))


def realise(docs: DataFrame, plans: MixPlan, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as its source's passes take it, with a struct ``mix_``.

    ``mix_`` has epoch, block and position; sorted by position, all sources are spread evenly at their
    weights from 0 to 1. No row moves where the table of sources is small enough to travel.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("budget") / F.greatest("tokens", F.lit(1))).otherwise(1.0)
    small = plans.rows.select(F.col("source").alias("mix_key"), F.col("passes").alias("mix_passes"), F.col("blocks").alias("mix_blocks"), F.col("cut_hash").alias("mix_hash"), F.col("cut_row").alias("mix_cut"), ratio.alias("mix_ratio"))
    named = _meet(docs.withColumn("mix_key", _source()), small)
    h, row = _order(docs, seed, F.col("mix_passes"))
    taken = F.coalesce((h < F.col("mix_hash")) | ((h == F.col("mix_hash")) & (row <= F.col("mix_cut"))), F.lit(False))
    times = F.col("mix_passes") + taken.cast("long")
    out = named.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))))
    at = _unit(_order(docs, seed, F.col("mix_epoch"))[0])
    out = out.withColumn("mix_", F.struct(F.col("mix_epoch").alias("epoch"), F.floor(at * F.col("mix_blocks")).alias("block"), F.least(F.lit(1.0), (F.col("mix_epoch") + at) / F.col("mix_ratio")).alias("position")))
    return out.select(*docs.columns, "mix_")


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to a total of as many tokens as there are; a row per copy."""
    counted = prepare(table(spark, sf_dir, "documents"), ("doc_id", "source"))
    out = realise(counted, plan(counted))
    return out.select("doc_id", "source", "n_tokens", F.col("mix_.epoch").alias("epoch"), F.col("mix_.block").alias("block"), F.round("mix_.position", 9).alias("position"))


QUERIES = {"op9_mixing": judge}
