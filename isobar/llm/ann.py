"""Nearest neighbours through learned partitions.

A bounded sample is joined into a neighbour graph, and the graph is cut into balanced partitions so that
neighbours stay together; their number grows with the table. A small classifier learns the partition of a
vector, with offsets that deal the sample evenly; it deals every vector of the table into its most
probable partition and routes each query to the several most probable ones (up to a share of probability
that is set for a target recall on held-out vectors), where all vectors are compared and the best reranked
by exact distance. ``visited`` tells which share of the table the queries search.

Partitions are searched in blocks of bounded size (a block of vectors against a block of the queries
routed to the partition), so neither a crowded partition nor many queries make a large task.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; equal distances go to the smaller vec_id; repeated candidate rows each count;
of rows that repeat a query's vec_id the smallest vector asks; a query's own rows (same vec_id) are no candidates; with fewer than k candidates in the routed
partitions the query searches all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The index is fitted on this many vectors of each partition, and SAMPLE at least, those whose vec_id hashes lowest.
SAMPLE, SAMPLE_PER_PARTITION = 4_096, 16
#: A partition for so many rows; never fewer than LEAST nor more than MOST, which bound the sample and the classifier.
PARTITION_ROWS, LEAST, MOST = 2_048, 16, 512
GRAPH_NEIGHBOURS, HIDDEN = 20, 64
#: Recall that the routed share of probability is set for, on a fifth of the sample kept from the fit.
TARGET_RECALL = 0.93
BLOCK_ROWS = 4_096
K = 10


@dataclass
class Router:
    """A one-hidden-layer classifier from vectors to partitions."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0  # a query goes to its most probable partitions up to this much probability

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector: partitions, most probable first, and how many of them a query visits."""
        o = self.logits(x)
        e = np.exp(o - o.max(axis=1, keepdims=True))
        order = np.argsort(-o, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(e / e.sum(axis=1, keepdims=True), order, axis=1), axis=1)
        return order, np.minimum((reached < self.mass).sum(axis=1) + 1, o.shape[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(column: str, size: int | None = None) -> Column:
    """Non-null, non-zero, finite vectors (of this length)."""
    v = F.col(column)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good & (F.size(v) == size if size else F.lit(True)), F.lit(False))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs, by the expanded form (for choosing, not for results)."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        d = squared_distances(x[i : i + 512], x)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partitions(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Cut a neighbour graph into parts of at most ``slack`` times the mean size.

    Starts from recursive halving along the longest direction, then moves nodes to the part that holds
    most of their neighbours, best gain first, while the part has room.
    """
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        y = x[g] - x[g].mean(axis=0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = g[np.argsort(y @ axis, kind="stable")]
        groups += [order[: len(g) // 2], order[len(g) // 2 :]]
    for i, g in enumerate(groups):
        label[g] = i
    room = int(np.ceil(slack * len(x) / parts))
    edges = np.concatenate((np.stack((np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel())), np.stack((graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])))), axis=1)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (edges[0], label[edges[1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int, graph: np.ndarray, steps: int = 400, seed: int = 7) -> Router:
    """Train the classifier; a vector's target is the share of partitions among itself and its neighbours."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), graph.shape[1] / 2 if graph.shape[1] else 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    mean, scale = x.mean(axis=0), float(max(x.std(), 1e-12))
    z, d = (x - mean) / scale, x.shape[1]
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        at = rng.integers(0, len(x), min(1024, len(x)))
        h = np.maximum(z[at] @ p[0] + p[1], 0)
        o = h @ p[2] + p[3]
        e = np.exp(o - o.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - target[at]) / len(at)
        gh = (g @ p[2].T) * (h > 0)
        for i, grad in enumerate((z[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Router(mean, scale, *p)


def balance(router: Router, x: np.ndarray, rounds: int = 60) -> None:
    """Shift the classifier's offsets until these vectors fall evenly into its partitions."""
    o = router.logits(x)
    mean, step = len(x) / o.shape[1], float(o.std())
    best = (np.inf, router.b2)
    for k in range(rounds):
        size = np.bincount(o.argmax(axis=1), minlength=o.shape[1])
        if size.max() < best[0]:
            best = (size.max(), router.b2 + (shift if k else 0.0))
        by = -step / (4 + k) * np.log((size + 1) / (mean + 1))
        shift = by if not k else shift + by
        o = o + by
    router.b2 = best[1]


def fit(vectors: DataFrame, sample: int | None = None, parts: int | None = None) -> Router | None:
    """Fit on a bounded sample of usable vectors (vec_id, embedding); None without any."""
    size = vectors.filter(usable("embedding")).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return None
    good = vectors.filter(usable("embedding", size["n"]))
    parts = parts or min(MOST, max(LEAST, -(-size["count"] // PARTITION_ROWS)))
    sample = sample or max(SAMPLE, SAMPLE_PER_PARTITION * parts)
    drawn = good.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(sample).toPandas()
    x = np.array(drawn["embedding"].tolist(), np.float64)
    parts = max(1, min(parts, len(x) // 8))
    if len(x) < 2:
        return Router(np.zeros(size["n"]), 1.0, np.zeros((size["n"], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = len(x) // 5 if len(x) >= 200 else 0
    seen, unseen = x[held:], x[:held]
    graph = neighbour_graph(seen, GRAPH_NEIGHBOURS)
    router = fit_router(seen, balanced_partitions(graph, seen, parts), parts, graph)
    balance(router, x)
    if held:  # neighbours are farther apart in the sample than in the table, so this errs to more partitions
        near = np.argpartition(squared_distances(unseen, seen), K - 1, axis=1)[:, :K]
        part, order = router.routes(seen)[0][:, 0], router.routes(unseen)[0]
        place = np.argsort(order, axis=1)  # of each partition in each vector's order
        need = np.take_along_axis(place, part[near], axis=1)
        for mass in (*np.arange(0.05, 1, 0.05), 0.97, 0.98, 0.99, 0.995, 0.999, 1.0):
            router.mass = float(mass)
            if (need < router.routes(unseen)[1][:, None]).mean() >= TARGET_RECALL:
                break
    return router


def search(vectors: DataFrame, queries: Column, k: int = K, router: Router | None = None) -> DataFrame:
    """Each query row's k nearest of the routed partitions: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    router = router or fit(vectors)
    if router is None:
        return spark.createDataFrame([], schema)
    sent, size = spark.sparkContext.broadcast(router), len(router.mean)
    rows = vectors.filter(usable("embedding", size) & F.col("vec_id").isNotNull()).select("vec_id", "embedding", F.coalesce(queries, F.lit(False)).alias("is_query"))

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                order, n = sent.value.routes(np.array(pdf["embedding"].tolist(), np.float64))
                pdf["routes"] = [r[:m].astype(np.int32) for r, m in zip(order, n, strict=True)]
                yield pdf

    dealt = written(rows.mapInPandas(deal, f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, is_query boolean, routes array<int>"), "ann-dealt")
    every = range(len(router.b2))
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.col("routes")[0].alias("p")).agg(F.count("*").alias("n")).collect()}
    held = F.create_map(*[F.lit(x) for p in every for x in (p, sizes.get(p, 0))])
    reach = F.aggregate("routes", F.lit(0).cast("long"), lambda n, r: n + held[r])
    asking = dealt.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("embedding", "routes")).alias("q")).select("vec_id", "q.*")
    asking = asking.withColumn("routes", F.when(reach > k, F.col("routes")).otherwise(F.array(*map(F.lit, every))))
    asked = {r["p"]: r["n"] for r in asking.select(F.explode("routes").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    blocks = {p: (-(-sizes.get(p, 1) // BLOCK_ROWS), -(-asked.get(p, 1) // BLOCK_ROWS)) for p in every}
    known = F.create_map(*[F.lit(x) for p, (a, _) in blocks.items() for x in (p, a)]), F.create_map(*[F.lit(x) for p, (_, b) in blocks.items() for x in (p, b)])
    salt = F.xxhash64("vec_id", F.lit(1))
    part = F.col("routes")[0]
    here = dealt.select("vec_id", "embedding", part.alias("part"), F.pmod(salt, known[0][part]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), (known[1][part] - 1).cast("int"))).alias("query_block"))
    sought = asking.select("vec_id", "embedding", F.explode("routes").alias("part"))
    sought = sought.select("vec_id", "embedding", "part", F.explode(F.sequence(F.lit(0), (known[0][F.col("part")] - 1).cast("int"))).alias("block"), F.pmod(salt, known[1][F.col("part")]).cast("int").alias("query_block"))

    def nearest(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            x, y = np.array(q["embedding"].tolist(), np.float64), np.array(c["embedding"].tolist(), np.float64)
            ids = c["vec_id"].to_numpy()
            for i in range(0, len(x), 256):
                rough = squared_distances(x[i : i + 256], y)
                for row, query, vector in zip(rough, q["vec_id"].to_numpy()[i : i + 256], x[i : i + 256], strict=True):
                    row[ids == query] = np.inf
                    if len(row) > k:  # all that rounding could put among the k nearest
                        bound = np.partition(row, k - 1)[k - 1]
                        at = np.nonzero(row <= bound + 1e-9 * (1 + (vector * vector).sum() + bound))[0]
                    else:
                        at = np.nonzero(np.isfinite(row))[0]
                    exact = np.sqrt(((y[at] - vector) ** 2).sum(axis=1))
                    exact, at = exact[ids[at] != query], at[ids[at] != query]
                    best = np.lexsort((ids[at], exact))[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ["part", "block", "query_block"]
    found = sought.groupBy(key).cogroup(here.groupBy(key)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited(vectors: DataFrame, queries: Column, router: Router) -> tuple[float, float]:
    """(share of the table that a query searches on average, largest partition over the mean)."""
    sent, size = vectors.sparkSession.sparkContext.broadcast(router), len(router.mean)
    rows = vectors.filter(usable("embedding", size)).select("embedding", F.coalesce(queries, F.lit(False)).alias("is_query"))

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                order, n = sent.value.routes(np.array(pdf["embedding"].tolist(), np.float64))
                home = pd.DataFrame({"part": order[:, 0], "rows": 1, "asked": 0})
                asks = [pd.DataFrame({"part": r[:m], "rows": 0, "asked": 1}) for r, m, q in zip(order, n, pdf["is_query"], strict=True) if q]
                yield pd.concat([home, *asks]).groupby("part", as_index=False).sum()

    got = rows.mapInPandas(deal, "part int, rows long, asked long").groupBy("part").agg(F.sum("rows").alias("n"), F.sum("asked").alias("q")).toPandas()
    asked = vectors.filter(usable("embedding", size) & F.coalesce(queries, F.lit(False))).count()
    return float((got["n"] * got["q"]).sum() / (got["n"].sum() * max(1, asked))), float(got["n"].max() * len(router.b2) / got["n"].sum())


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {"op7_nearest_neighbours": judge}
