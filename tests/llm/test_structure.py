"""Near-duplicates, WARC, neighbours, encoding, mixing, and the pipeline on small tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import ann, mergedropout, mixing, neardup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows, size):
    """Components of exact links, by comparing all pairs."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset() if not w else frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def near_copies(seed, n, groups):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(12, 60)))]
        for _ in range(n):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 400)}"
            rows.append(" ".join(w))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_groups_against_all_pairs(spark, size):
    rows = [*near_copies(1, 12, 12), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "\x0bone\ttwo ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("kept", F.lit(0)).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size).collect()}
    want = brute_groups(rows, size)
    assert got == want
    assert got[900] == (0, 900) and got[903][1] == 902 and got[905][1] == 904


def test_one_large_group_spread_over_partitions(spark):
    rows = near_copies(5, 150, 1) + [(500 + i, t) for i, t in near_copies(6, 3, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 2).items()}


def test_null_keys_repeats_and_no_rows(spark):
    docs = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (7, "x y z")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 2).collect())
    assert got == Counter({(2, 1, False): 2, (1, 1, True): 1, (None, 1, False): 1, (7, 7, True): 1})
    assert neardup.near_duplicates(docs.limit(0), 2).count() == 0


def test_one_doc_id_with_two_texts_joins_their_groups(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "p q r s"), (3, "a b c d"), (9, "p q r s"), (7, "x y")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 2).collect()}
    assert got == {(5, 3, False), (3, 3, True), (9, 3, False), (7, 7, True)}


def test_rows_without_doc_id_are_linked_by_their_texts(spark):
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:-1], "other"])
    rows = [(4, " ".join(words)), (None, near), (None, near), (None, "only nameless text here"), (None, "only nameless text here"), (None, None), (1, None)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == Counter({(4, 39, 4, True): 1, (None, 39, 4, False): 2, (None, 3, None, False): 2, (None, 0, None, False): 1, (1, 0, 1, True): 1})


@pytest.mark.parametrize("at_once", [0, 200_000])
def test_components_of_hubs(spark, monkeypatch, at_once):
    monkeypatch.setattr(neardup, "ONE_TASK", at_once)
    links = [(0, i) for i in range(1, 3000)] + [(10_000, i) for i in range(2990, 3010)] + [(20_000, 20_000 + i) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert len(got) == 2999 + 10 + 1 + 49 and {c for i, c in got.items() if i < 20_000} == {0} and got[20_049] == 20_000


def test_large_regions_cut_into_pieces_stay_tied(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WALK_ROWS", 7)
    rows = near_copies(8, 60, 2)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_groups(rows, 2).items()}


def test_no_link_is_lost_on_the_table(spark):
    """Against an exact join through the rarest fifth of each set, on sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        if w:
            sets[r["doc_id"]] = frozenset(tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1)))
    times = Counter(x for s in sets.values() for x in s)
    classes, index, links = {}, {}, []
    for i, s in sorted(sets.items()):
        if s in classes:
            links.append((classes[s], i))
            continue
        classes[s] = i
        rare = sorted(s, key=lambda x: (times[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for x in rare for j in index.get(x, ())}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                links.append((j, i))
        for x in rare:
            index.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 2).collect()}
    assert sum(got[a] != got[b] for a, b in links) == 0 and len(links) > 50
    assert all(got[i] == top(i) for i in sets)


@pytest.mark.parametrize("at_once", [0, 200_000])
def test_components_of_a_long_chain(spark, monkeypatch, at_once):
    monkeypatch.setattr(neardup, "ONE_TASK", at_once)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_chunks_and_segments_round_trip():
    for n in (0, 1, 4095, 4096, 4097, 50_000):
        data = bytes(range(256)) * (n // 256) + bytes(n % 256)
        assert warc.dechunked(warc.chunked(data)) == data
        records = warc.page_records(5, "http://a", data, None, "u", segment=1000)
        file = b"".join(r + b"\r\n\r\n" for r in records)
        parsed = list(warc.parse(file))
        assert len(parsed) == len(records)
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None


def test_reassembly_orders_and_verifies():
    records = list(warc.parse(b"".join(r + b"\r\n\r\n" for r in warc.page_records(5, "http://a", b"x" * 9000, None, "u", segment=1000))))
    parts = [{"number": int(f["warc-segment-number"]), "total": int(f.get("warc-segment-total-length", 0)) or None, "head": "\n".join(f"{k}: {v}" for k, v in f.items()) if f["warc-segment-number"] == "1" else None, "block": b} for f, b in records]
    done = warc.assemble(parts[::-1])
    assert done["payload"] == b"x" * 9000 and done["intact"] and done["page_id"] == 5
    assert not warc.assemble(parts[:-1])["intact"] and not warc.assemble(parts[1:])["intact"]


def test_archives_of_odd_pages(spark, tmp_path):
    trick = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n é" * 3
    rows = [(1, "u", None), (2, "u", ""), (3, None, trick), (4, "u\r\nX: y", trick), (5, "u", "ü" * 40_000), (5, "u", "ü" * 40_000), (None, "u", trick), (9, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("last", F.lit(0)).withColumn("sha1", F.lit(0))
    warc.write_archives(pages, str(tmp_path / "w"), segment=777)
    got = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    raw = trick.encode()
    assert by[1][0]["record_type"] == "revisit" and by[1][0]["refers_to"] == 2 and by[1][0]["payload_bytes"] == 0
    assert by[3][0]["refers_to"] == 4 and by[3][0]["payload_bytes"] == len(raw) and by[4][0]["payload"] == raw
    assert by[None][0]["record_type"] == "revisit" and [r["record_type"] for r in by[5]] == ["response"] * 2
    assert by[4][0]["payload_digest"] == warc.base32_sha1(raw) == by[3][0]["payload_digest"]
    assert len(warc.base32_sha1(b"")) == 32 and hashlib.sha1(raw).digest()
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_foreign_and_broken_records_do_not_stop_the_reading(spark, tmp_path):
    good = warc.page_records(5, "http://a", b"x" * 3000, None, "u", segment=1000)
    foreign = [
        warc.record("revisit", "urn:pages:6:u", [("WARC-Payload-Digest", "sha1:A")], b"HTTP/1.1 200 OK\r\n\r\n"),
        warc.record("response", "urn:pages:7:u", [("WARC-Segment-Number", "one")], b"x"),
        warc.record("continuation", "urn:pages:8:u:2", [("WARC-Segment-Origin-ID", "<urn:pages:8:u>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Total-Length", "many")], b"x"),
        b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx",
        warc.record("warcinfo", "urn:info", [], b"software"),
        warc.record("response", "no colon", [], b"not http"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [*foreign, *good]))
    got = {(r["page_id"], r["record_type"], r["intact"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {(5, "response", True), (6, "revisit", False), (None, "response", False)}


def brute_neighbours(rows, k, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            d = sorted((math.sqrt(((q - v) ** 2).sum()), j) for j, v in good if j != i)
            out[i] = [(j, s) for s, j in d[:k]]
    return out


def test_neighbour_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (12, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(0, 1, 16))]) for i in range(3000)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    want = brute_neighbours(rows, 10)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(want)
    hits = sum(len({v for v, _ in found[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = {q: dict(want_) for q, want_ in brute_neighbours(rows, 3000).items()}
    assert all(abs(exact[q][v] - s) < 1e-12 for q, f in found.items() for v, s in f.values())
    assert all(sorted(f) == list(range(1, 11)) for f in found.values())


def test_recall_and_balance_on_the_table(spark):
    """Directions of these vectors are spread evenly, so routing can spare little of the table; recall must hold."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    router = ann.fit(vectors)
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, router=router).collect()
    want = {q: {j for j, _ in near} for q, near in brute_neighbours([(r["vec_id"], r["embedding"]) for r in vectors.collect()], 10, 20).items()}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 10 * len(want)
    share, largest = ann.visited(vectors, F.col("vec_id") % 20 == 0, router)
    print("visited", share, "largest partition over the mean", largest)
    assert share < 1 and largest < 2


def test_clustered_vectors_are_searched_in_part(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 3, (40, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] + rng.normal(0, 1, 16))]) for i in range(8000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    router = ann.fit(vectors)
    share, largest = ann.visited(vectors, F.col("vec_id") % 100 == 0, router)
    got = ann.search(vectors, F.col("vec_id") % 100 == 0, router=router).collect()
    want = {q: {j for j, _ in near} for q, near in brute_neighbours(rows, 10).items()}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= 0.9 * 10 * len(want)
    assert share < 0.2 and largest < 2.5, (share, largest)


def test_neighbours_with_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (7, None), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [None, 1.0]), (12, [1.0]), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("part", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 0.0), (0, 2, 5, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 5, 0.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_encoding_without_dropout_equals_the_library():
    import sentencepiece

    vocab = mergedropout.MergeVocabulary.read(mergedropout.VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=mergedropout.VOCABULARY)
    e = mergedropout.Encoder(vocab, 1, 0.0)
    for t in ("Hello  world\n foo\tbar é", "  a", "日本語 🎉x", "x" * 300, "The quick brown fox.", "a\x00b", "\n\n \t"):
        assert e.text(t).tolist() == sp.encode(t)


def one_agenda(vocab, encoder, unit, stream):
    """The agenda of one unit, plainly: best rank first, leftmost on ties, skipped for good by the same hash."""
    import xxhash

    from isobar.llm.common import mix64

    ids = {p: i for i, p in enumerate(vocab.pieces) if p}
    sym = [(s, k) for k, s in enumerate(encoder._symbols(unit))]
    n = len(sym)
    salt = np.uint64(xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"), encoder.seed * 0x10001 + stream & 0xFFFFFFFFFFFFFFFF))
    while True:
        best = None
        for k in range(len(sym) - 1):
            piece = ids.get(vocab.pieces[sym[k][0]] + vocab.pieces[sym[k + 1][0]]) if vocab.pieces[sym[k][0]] and vocab.pieces[sym[k + 1][0]] else None
            if piece is None:
                continue
            end = sym[k + 2][1] if k + 2 < len(sym) else n
            key = np.array([(sym[k][1] << 40) ^ (end << 20) ^ piece], np.uint64)
            if mix64(salt ^ mix64(key))[0] >= encoder.limit and (best is None or vocab.ranks[piece] < best[0]):
                best = (vocab.ranks[piece], k, piece)
        if best is None:
            return [s for s, _ in sym]
        _, k, piece = best
        sym[k : k + 2] = [(piece, sym[k][1])]


def test_lockstep_agenda_equals_one_at_a_time():
    vocab = mergedropout.MergeVocabulary.read(mergedropout.VOCABULARY)
    e = mergedropout.Encoder(vocab, 7, 0.3)
    for unit in (" international", " something", "xx", " Straße", " 12345", "  a", " electroencephalography"):
        for stream in (0, 1):
            assert e.units(stream, [unit])[0].tolist() == one_agenda(vocab, e, unit, stream)


def test_occurrences_equal_the_agenda_under_their_salt():
    vocab = mergedropout.MergeVocabulary.read(mergedropout.VOCABULARY)
    e = mergedropout.Encoder(vocab, 7, 0.3)
    words = [" international", " something", " Straße", "  a", "xx", " 日本語🎉", " electroencephalographically", " understanding"]
    for part in (3, 40, 40):  # met once, and again with what is remembered
        units = [w for w in words for _ in range(part)]
        streams = list(range(len(units)))
        salts = [e_salt(e, u, k) for u, k in zip(units, streams, strict=True)]
        flat, n = e.occurrences(units, np.array(salts, np.uint64))
        got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == [one_agenda(vocab, e, u, k) for u, k in zip(units, streams, strict=True)]


def test_long_units_on_a_heap_equal_the_lockstep_agenda(monkeypatch):
    import time

    vocab = mergedropout.MergeVocabulary.read(mergedropout.VOCABULARY)
    rng = np.random.default_rng(3)
    units = [" " + "".join(rng.choice(list("abehinorst日é🎉"), int(n))) for n in (1, 2, 30, 200, 500, 900)] + [" internationalisation" * 30, "x" * 700]
    salt = rng.integers(0, 2**63, len(units)).astype(np.uint64)
    for dropout in (0.0, 0.3):
        monkeypatch.setattr(mergedropout, "HEAP", 10**9)
        flat, n = mergedropout.Encoder(vocab, 7, dropout).occurrences(units, salt)
        monkeypatch.setattr(mergedropout, "HEAP", 0)
        e = mergedropout.Encoder(vocab, 7, dropout)
        got = [e._on_heap(u, int(s)).tolist() for u, s in zip(units, salt, strict=True)]
        assert got == [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    long = "".join(rng.choice(list("ABCDEFabcdef0123456789+/"), 1 << 20))
    monkeypatch.setattr(mergedropout, "HEAP", 512)
    began, e = time.time(), mergedropout.Encoder(vocab, 7, 0.1)
    flat, n = e.occurrences(["_" + long], np.array([5], np.uint64))
    assert time.time() - began < 60
    assert mergedropout.Decoder(vocab).text(flat.tolist()) == long


def e_salt(encoder, unit, stream):
    import xxhash

    return xxhash.xxh3_64_intdigest(unit.encode(), encoder.seed * 0x10001 + stream & 0xFFFFFFFFFFFFFFFF)


def test_dropout_cuts_every_occurrence_and_copy_on_its_own(spark):
    rows = [(d, c, "an international understanding " * 20) for d in range(30) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, epoch long, text string")
    got = mergedropout.encode(docs, check=True, copy="epoch").collect()
    assert all(r["lossless"] for r in got) and len({tuple(r["ids"]) for r in got}) == 90
    vocab = mergedropout.MergeVocabulary.read(mergedropout.VOCABULARY)
    cuts = Counter()
    for r in got:
        text = "".join(("|" if vocab.pieces[i][:1] == "▁" else ".") + vocab.pieces[i] for i in r["ids"])
        cuts.update(text.split("|"))
    assert len([c for c in cuts if c.replace(".", "") == "▁international"]) > 5
    assert len({tuple(r["ids"]) for r in mergedropout.encode(docs).collect()}) == 30
    mixed = corpus_pipeline.encode_pieces(spark, docs, SF).groupBy("doc_id").agg(F.countDistinct("ids_digest").alias("n"))
    assert [r["n"] for r in mixed.collect()] == [3] * 30


def test_dropout_varies_and_decodes(spark):
    rows = [(1, None), (2, ""), (3, "▁x ▁ lossless ▁▁"), (4, "something international " * 2000), (5, " \n\t "), (6, "same text here"), (6, "same text here"), (None, "same text here"), (8, "a\u0000 🎉 日本語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("lossless", F.lit("x"))
    enc = mergedropout.encode(docs, check=True)
    got = enc.collect()
    assert [r["lossless"] for r in got if r["doc_id"] != 1] == [True] * 8 and [r for r in got if r["doc_id"] == 1][0]["ids"] is None
    back = Counter((r["doc_id"], r["text"]) for r in mergedropout.decode(enc).collect())
    assert back == Counter(rows)
    other = {r["doc_id"]: r["ids"] for r in mergedropout.encode(docs, seed=99).collect()}
    assert any(other[r["doc_id"]] != r["ids"] for r in got if r["doc_id"] in (3, 4, 6))
    again = mergedropout.encode(docs.repartition(3), check=True)
    assert Counter((r["doc_id"], tuple(r["ids"] or ())) for r in again.collect()) == Counter((r["doc_id"], tuple(r["ids"] or ())) for r in got)
    assert mergedropout.encode(docs.limit(0)).count() == 0


def test_exponent_meets_entropy_or_repeats():
    shares = [0.7, 0.2, 0.1]
    a = mixing.solve_exponent(shares, 0.5, 1.0, 100.0)
    goal = mixing.entropy(shares) + 0.5 * (math.log(3) - mixing.entropy(shares))
    assert mixing.entropy(mixing.tempered(shares, a)) == pytest.approx(goal, abs=1e-9)
    b = mixing.solve_exponent([0.98, 0.02], 1.0, 1.0, 4.0)
    w = mixing.tempered([0.98, 0.02], b)
    assert w[1] / 0.02 == pytest.approx(4.0, rel=1e-6)
    assert mixing.solve_exponent([1.0], 0.5, 1.0, 4.0) == 1.0


def test_mixture_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["big", "mid", "tiny", None][min(3, int(rng.exponential(0.8)))], int(rng.integers(0, 300))) for i in range(600)] + [(5, "big", 10), (5, "big", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("block", F.lit("x")).withColumn("key", F.lit("x"))
    plans = mixing.plan(df, max_repeats=6.0)
    got = mixing.realise(df, plans).collect()
    times = Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in got)
    whole = sum(r[2] for r in rows)
    assert abs(sum(p.budget for p in plans) - whole) <= len(plans) and sum(p.weight for p in plans) == pytest.approx(1)
    h = {(r["doc_id"], r["k"]): r["h"] for r in df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("doc_id", "k", mixing._hash(mixing.SEED, F.col("k").cast("long")).alias("h")).collect()}
    for p in plans:
        mine = [r for r in rows if (r[1] or "") == p.source]
        left, order = p.budget - p.passes * p.tokens, sorted(mine, key=lambda r: (h[r[0], p.passes], r[0], r[2]))
        taken, upto = Counter(), 0
        for r in order:
            upto += r[2]
            if upto > left:
                break
            taken[r] += 1
        want = Counter({r: 0 for r in mine})
        for r in mine:
            want[r] += p.passes
        ids = {r[0] for r in mine if list(r[:1]) == [5]}
        for r, n in (want + taken).items():
            if r[0] not in ids:
                assert times[r[0], r[1], r[2]] == n, (p, r)
        spent = sum(r["n_tokens"] for r in got if (r["source"] or "") == p.source)
        assert p.budget - 320 <= spent <= p.budget + 20
    for r in got:
        assert 0 <= r["mix_"]["position"] <= 1
    assert mixing.realise(df.limit(0), mixing.plan(df.limit(0))).count() == 0


def test_budgets_hold_without_doc_ids_and_with_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDER_ROWS", 20)
    rows = [(None, "a", f"word {i} " * 4) for i in range(300)] + [(None, "b", "the same row " * 3)] * 200 + [(i, "c", "one two three four") for i in range(900)] + [(7, "d", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("h", F.lit("x")).withColumn("row", F.lit("x"))
    counted = mixing.prepare(docs, ("doc_id", "source", "h", "row"))
    plans = mixing.plan(counted, budget=5000)
    out = mixing.realise(counted, plans)
    spent = {r["source"]: (r["n"], r["most"]) for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()}
    for p in plans:
        assert p.budget - spent[p.source][1] < spent[p.source][0] <= p.budget, p
    assert sum(p.budget for p in plans) == pytest.approx(5000, abs=4)


def test_pipeline_stages_hold(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, "12 34 !!", "en", "s", 8), (None, docs.first()["text"], "en", "s", 3)], DOCS)
    now = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("kept_", F.lit("x"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert now.columns == list(corpus_pipeline.COLUMNS), name
        if k == 0:
            assert now.filter("doc_id >= 1000000").count() == 0
        if k == 2:
            nameless = {}  # rows without doc_id are one document per text
            rows = [(nameless.setdefault(r["text"], 10**9 + len(nameless)) if r["doc_id"] is None else r["doc_id"], r["text"]) for r in before.collect()]
            keep = Counter(i if i < 10**9 else None for i, (_, c) in brute_groups(rows, 5).items() if i == c)
            assert Counter(r["doc_id"] for r in now.collect()) == keep
    assert now.filter("lossless").count() == now.count() > 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
