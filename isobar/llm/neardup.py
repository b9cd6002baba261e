"""Near-duplicate groups by an LSH forest over MinHash signatures, with every link confirmed on full sets.

Texts with equal shingle sets form a class first, so copies cost one row. Each class gets a signature;
every tree of the forest sorts all classes by its own order of the signature's parts (a range-partitioned
sort, so no key lands in one task). A region is a run of classes that share a tree's first DEPTH parts.
In a small region all pairs are candidates; in a large one the order itself goes deeper, and each class
meets its neighbour with the longest common prefix. Classes that share regions form a cluster, and no
link leaves its cluster.

In a cluster, the shingles that only one class has bound its similarity to every other: a pair with u and
v such shingles and at most m others in common reaches at most m / (m + u + v). Candidates that pass this
bound are confirmed exactly on full sets. Then the components of confirmed links are found, and a cluster
that still holds several is searched in full across them under the same bound, so comparing only
neighbours in large regions loses no link.

What can be lost is a pair that shares no region of any tree, or that differs in more than half of its
signature parts: at a similarity of exactly 0.8 that is (1 - 0.8 ** DEPTH) ** TREES, about 3e-6, and 1e-9.

Defined results: a text without words (null included) has an empty set, is linked with nothing and is its
own component; a text shorter than a shingle is one shingle of all its words; rows with one ``doc_id``
are one document (linked by any of its texts); rows without ``doc_id`` are one document per text: they
take their group's component, which is null if no row of the group has a ``doc_id``, and are never
``kept``; doc_ids lie below 2 ** 62; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordRows, discard, folders, give_back, map_batches, map_chunks, mix64, table, word_hashes, written
from .textstats import encode

TREES, DEPTH = 24, 4
PARTS = TREES * DEPTH
#: Regions up to this many classes have all pairs compared.
SMALL_REGION = 4
#: Signature agreement a candidate needs: seven standard errors below a similarity of 0.8.
MIN_AGREEMENT = 0.5
PERCENT = 80
#: Bytes of sets, and sets, a side of a block that is searched across components.
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 512
#: Rows of a sorted partition, and nodes of a graph's partition, that a worker holds at once.
WALK_ROWS, STAR_NODES = 20_000, 500_000
#: Links that one task joins at once, and rows of a table that travels to the rows it describes; more go other ways.
ONE_TASK, NEAR_ROWS = 200_000, 200_000
#: Keys that one node's links are dealt to.
SALTS = 1024
#: From here on a node stands for a text without doc_id.
NAMELESS = 1 << 62
_FACTORS = mix64(np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


class Shingler:
    """Distinct shingle hashes of texts; remembers word hashes. One per worker."""

    def __init__(self, size: int):
        self.size = size
        self.words = WordRows(lambda new: word_hashes(new).reshape(-1, 1), 1, np.uint64)

    def __call__(self, raw: bytes) -> np.ndarray:
        """Sorted distinct hashes; empty without words."""
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        at = self.words.lookup(words)
        h = self.words.rows[at, 0]
        k = min(self.size, len(words))
        s = np.full(len(words) - k + 1, np.uint64(k))
        for j in range(k):
            s = mix64(s * _STEP + h[j : len(words) - k + 1 + j])
        return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PARTS minima, each folded to 16 bits."""
    low = np.full(PARTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _FACTORS[None, :]).min(axis=0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(">u2")


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set (null if empty), signature."""

    def make():
        shingler = Shingler(size)
        import xxhash

        def run(chunk):
            out = {"doc_id": chunk["doc_id"], "n_shingles": [], "digest": [], "signature": []}
            for text in chunk["text"]:
                s = shingler(encode(text))
                out["n_shingles"].append(len(s))
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out["signature"].append(signature(s).tobytes() if len(s) else None)
            return out

        return run

    return map_chunks(docs, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, signature binary", make)


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row per class and tree: the region key, and the signature's bytes from the tree's first part on."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("id", "n_shingles", "signature", "codes", tree)
    at = F.col("tree") * DEPTH
    return rows.select(
        "tree",
        F.substring("signature", at * 2 + 1, F.lit(2 * DEPTH)).alias("key"),
        F.concat(F.substring("codes", at + 1, F.lit(PARTS)), F.substring("codes", F.lit(1), at)).alias("order"),
        "id",
        "n_shingles",
    )


def _agree(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Pairs that can reach the similarity: enough equal parts, and sizes not too far apart."""
    return ((a == b).sum(axis=1) >= MIN_AGREEMENT * PARTS) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))


def walk_forest(rows: DataFrame) -> DataFrame:
    """(a, b, candidate) from sorted partitions: pairs to confirm, and ties that only hold a region together.

    The first and last rows of each partition also come as (a, tree, key) with b null, so a region cut by
    a partition is tied together again.
    """

    def keys(held):
        tree, key = held["tree"].to_numpy(), np.array(held["key"].to_pylist(), dtype="S8")
        return tree, key, np.nonzero((tree[1:] != tree[:-1]) | (key[1:] != key[:-1]))[0] + 1

    def run(batches):
        parts, n, first, cut = [], 0, True, True  # cut: the first run held may have begun before
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n < WALK_ROWS:
                continue
            held = pa.Table.from_batches(parts)
            tree, key, breaks = keys(held)
            # the last run may go on: it waits, or is handed on as part of a large one, but for its last row
            stop, rest = (int(breaks[-1]),) * 2 if len(breaks) else (n, n - 1)
            yield emit(held.slice(0, stop), tree[:stop], key[:stop], first, False, cut, stop > rest)
            first, cut, parts, n = False, stop > rest, held.slice(rest).to_batches(), n - rest
        if n:
            held = pa.Table.from_batches(parts)
            tree, key, _ = keys(held)
            yield emit(held, tree, key, first, True, cut, True)
        give_back()

    def emit(rows, tree, key, first, last, cut, goes_on):
        n = len(rows)
        codes = np.frombuffer(b"".join(rows["order"].to_pylist()), np.uint8).reshape(n, PARTS)
        ids, size = rows["id"].to_numpy(), rows["n_shingles"].to_numpy()
        begins = np.concatenate(([True], (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])))
        run_of = np.cumsum(begins) - 1
        small = np.bincount(run_of) <= SMALL_REGION
        small[0] &= not cut  # regions that partitions or pieces cut count as large
        small[-1] &= not goes_on
        full = small[run_of]
        found = []
        for step in range(1, min(SMALL_REGION, n)):
            ok = run_of[step:] == run_of[:-step]
            if step > 1:
                ok &= full[step:]
            at = np.nonzero(ok)[0]
            near = _agree(codes[at], codes[at + step], size[at], size[at + step])
            tie = near | (~full[at] & (step == 1))
            found.append(np.stack((np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step]), near), axis=1)[tie])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        edge = sorted(({0} if first else set()) | ({n - 1} if last else set()))
        a = np.concatenate((pairs[:, 0], ids[edge]))
        none = [None] * len(pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array([*pairs[:, 1].tolist(), *[None] * len(edge)], pa.int64()), pa.array([*(pairs[:, 2] > 0).tolist(), *[False] * len(edge)]), pa.array([*none, *tree[edge].tolist()], pa.int32()), pa.array([*none, *key[edge].tolist()], pa.binary())],
            ["a", "b", "candidate", "tree", "key"],
        )

    dealt = rows.repartitionByRange("tree", "key", "order", "id").sortWithinPartitions("tree", "key", "order", "id")
    return map_batches(dealt, run, "a long, b long, candidate boolean, tree int, key binary")


def cut_ties(walked: DataFrame) -> DataFrame:
    """Ties (a, b) between the ends of partitions that lie in one region (two rows a partition at most)."""
    ends = walked.filter("b is null").select("a", "tree", "key")
    least = ends.groupBy("tree", "key").agg(F.min("a").alias("b"))
    return ends.join(least, ["tree", "key"]).filter("a <> b").select("a", "b")


def shared_sets(docs: DataFrame, clusters: DataFrame, size: int) -> DataFrame:
    """(id, cluster, shingles) of the classes in clusters; only their texts are read into sets."""

    def make():
        shingler = Shingler(size)
        return lambda chunk: {"id": chunk["doc_id"], "cluster": chunk["cluster"], "shingles": [shingler(encode(x)).tobytes() for x in chunk["text"]]}

    rows = docs.select("doc_id", "text").join(clusters.select(F.col("id").alias("doc_id"), "cluster").hint("merge"), "doc_id")
    return map_chunks(rows, ["doc_id", "cluster", "text"], "id long, cluster long, shingles binary", make)


def unshared(sets: DataFrame) -> DataFrame:
    """(id, u): how many of a class's shingles no other class of its cluster has.

    A hash that stands for two shingles can only lower the count, which keeps the bound safe.
    """

    def run(batches):
        for batch in batches:
            for id_, cluster, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = mix64(np.frombuffer(raw.as_buffer(), np.uint64) ^ mix64(np.array([cluster], np.int64).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), id_))], ["h", "id"])

    each = map_batches(sets.select("id", "cluster", "shingles"), run, "h long, id long")
    once = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other")
    return once.groupBy("id").agg(F.count("*").alias("u"))


def _may_reach(na, ua, nb, ub):
    """Column: the bound on the similarity of a pair reaches the threshold."""
    m = F.least(na - ua, nb - ub)
    return 100 * m >= PERCENT * (m + ua + ub)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "sa", "sb")
    return map_batches(met, run, "a long, b long").distinct()


def _local_stars(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) replaced by stars around the least id of their local components."""

    def stars(up, top):
        found = [(x, m) for x in up if (m := top(x)) != x]
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([m for _, m in part], pa.int64())], ["u", "v"])

    def run(batches):
        up: dict[int, int] = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > STAR_NODES:
                yield from stars(up, top)
                up.clear()
        yield from stars(up, top)
        del up
        give_back()

    return map_batches(edges.select("u", "v"), run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Links are rows (a, b).

    Up to ONE_TASK edges, counted first, are joined in one task. More go in rounds: edges run from the larger id u to the smaller v. Partitions shrink their own edges to stars;
    large-star and small-star steps join those, until every id hangs on one root that hangs on nothing.
    Each step is written. A root with many edges has them dealt to SALTS keys, each of which meets one row
    with the root's own least neighbour; an id has no more edges than there are partitions, as each makes
    stars. So no node's edges are ever gathered in one place.
    """
    spark, before = links.sparkSession, folders()
    edges = written(_local_stars(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    if edges.count() <= ONE_TASK:
        whole = written(_local_stars(edges.coalesce(1)), "links")
        return whole.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        ids = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("m")).first()
        roots = edges.select(F.col("v").alias("u")).distinct()
        if ids["n"] == ids["m"] and edges.select("u").join(roots, "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        old = [x for x in folders() if x not in before and "/links-" in x]
        dealt = edges.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        goal = dealt.select("v", "salt").distinct().join(least, "v", "left").select("v", "salt", F.coalesce("m", "v").alias("m"))
        large = written(_local_stars(dealt.join(goal, ["v", "salt"]).select("u", F.col("m").alias("v"))), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = written(_local_stars(small.distinct()), "links")
        discard(spark, [*old, folders()[-2]])  # nothing reads the earlier steps any more


def _intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b, through blocks of 0/1 columns."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, sets in ((fa, a), (fb, b)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        col = np.searchsorted(both, flat)
        hit = (col < len(both)) & (both[np.minimum(col, max(len(both) - 1, 0))] == flat) if len(both) else np.zeros(len(flat), bool)
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order], len(sets)))
    for start in range(0, len(both), width):
        parts = []
        for row, col, n in sides:
            lo, hi = np.searchsorted(col, [start, start + width])
            m = np.zeros((n, min(width, len(both) - start)), np.float32)
            m[row[lo:hi], col[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _near(df: DataFrame) -> DataFrame:
    """Written, and broadcast behind a count."""
    df = written(df, "neardup-near")
    return F.broadcast(df) if df.count() <= NEAR_ROWS else df


def across(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between different components of one cluster.

    In each cluster the component with most members is the main one; the members of others meet every
    member outside their own component whose set is of like size (bands of set sizes, each 1 / 0.8 times
    the one before: a linked pair lies in one band or in two that touch). A band is searched in blocks of
    about BLOCK_BYTES and BLOCK_SETS a side, and only links leave a block (one for each two components that it joins).
    Clusters of one component drop out, and so do classes that are too different from all others.
    """
    rows = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = rows.filter(_may_reach(F.col("n_shingles"), F.col("u"), F.col("n_shingles"), F.lit(0)))
    rows = rows.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / PERCENT) + 1e-9).cast("int"))
    per = rows.groupBy("cluster", "component").count()
    best = F.max(F.struct("count", "component"))
    main = per.groupBy("cluster").agg(best.getField("component").alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("cluster", "main")
    open_ = written(rows.join(_near(main), "cluster").select("id", "cluster", "component", "band", "n_shingles", (F.col("component") != F.col("main")).alias("is_rest")), "neardup-open")
    size, key = F.greatest(F.ceil(F.sum(8 * F.col("n_shingles")) / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int"), ["cluster", "band"]
    others = open_.filter("is_rest").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    blocks = _near(open_.groupBy(*key).agg(size.alias("bn")).join(others.groupBy(*key).agg(size.alias("rn")), key))
    salt, held = F.xxhash64("id", F.lit(3)), sets.select("id", "shingles")
    every = open_.join(blocks, key).join(held, "id").select(*key, F.pmod(salt, "bn").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("rn") - 1)).alias("rest_block"), "id", "component", "shingles")
    rest = others.join(blocks, key).join(held, "id").select(*key, F.explode(F.sequence(F.lit(0), F.col("bn") - 1)).alias("block"), F.pmod(salt, "rn").cast("int").alias("rest_block"), "id", "component", "shingles")
    rest = rest.select(*[F.col(c).alias(c) for c in rest.columns])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        p, q = ([np.frombuffer(v, np.uint64) for v in side["shingles"]] for side in (x, y))
        np_, nq = (np.array([len(v) for v in side]) for side in (p, q))
        same = _intersections(p, q)
        linked = 100 * same >= PERCENT * (np_[:, None] + nq[None, :] - same)
        i, j = np.nonzero(linked & (x["component"].to_numpy()[:, None] != y["component"].to_numpy()[None, :]))
        out = pd.DataFrame({"a": x["id"].to_numpy()[i], "b": y["id"].to_numpy()[j], "ca": x["component"].to_numpy()[i], "cb": y["component"].to_numpy()[j]})
        return out.drop_duplicates(["ca", "cb"])[["a", "b"]]

    key = [*key, "block", "rest_block"]
    return every.groupBy(*key).cogroup(rest.groupBy(*key)).applyInPandas(compare, "a long, b long")


def node_of() -> Column:
    """A row's node: its doc_id, or a number from NAMELESS on that stands for its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(NAMELESS))


def shared_texts(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from a doc_id that has several texts to the class of each."""
    several = sketches.filter("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
    rows = sketches.filter("digest is not null").join(several, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
    return rows.filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()


def groups(docs: DataFrame, size: int) -> DataFrame:
    """Per row: node (node_of), n_shingles, and component, the smallest node that its node reaches."""
    docs = docs.select(node_of().alias("doc_id"), "text")
    sketches = written(sketch(docs, size), "neardup-sketches")
    codes = F.concat(*[F.substring("signature", 2 * i + 2, 1) for i in range(PARTS)])
    classes = sketches.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("codes", codes), "neardup-classes")
    walked = written(walk_forest(forest_rows(classes)), "neardup-walk")
    ties = walked.filter("b is not null").select("a", "b").unionAll(cut_ties(walked))
    grouped = components(ties).withColumnRenamed("component", "cluster")
    clusters = written(grouped.unionAll(grouped.select(F.col("cluster").alias("id"), "cluster").distinct()), "neardup-clusters")
    sets = written(shared_sets(docs, clusters, size), "neardup-sets")
    u = unshared(sets)
    sizes = sets.groupBy("id").agg(F.max("cluster").alias("cluster"), F.max(F.expr("octet_length(shingles) div 8")).alias("n_shingles"), F.count("*").alias("texts"))
    # a doc_id with several texts has no one set: its largest stands for all, and nothing counts as its own
    members = written(sizes.join(u, "id", "left").select("id", "cluster", "n_shingles", F.when(F.col("texts") > 1, 0).otherwise(F.coalesce("u", F.lit(0))).cast("long").alias("u")), "neardup-members")
    a, b = (members.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("u").alias(f"u{c}")) for c in ("a", "b"))
    pairs = walked.filter("candidate").select("a", "b").distinct().join(a, "a").join(b, "b").filter(_may_reach(F.col("na"), F.col("ua"), F.col("nb"), F.col("ub"))).select("a", "b")
    labels = components(confirm(pairs, sets).unionAll(shared_texts(sketches, classes)))
    more = written(across(members, labels, sets), "neardup-across")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    own = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sketches.select(F.col("doc_id").alias("node"), "n_shingles", "digest").join(own, "digest", "left")
    return out.select("node", "n_shingles", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    out = groups(docs, size).select(named("node").alias("doc_id"), "n_shingles", named("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their word pairs."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2)


QUERIES = {"op3_near_duplicates": judge}
