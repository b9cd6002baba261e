"""Language, toxicity, language-model, quality and weak-label operators on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import langid, lattice, lm, quality, textstats, toxicity, weaklabel
from isobar.llm.common import fold_is

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows(spark, *extra):
    """Null, empty, blank, letterless, very long and repeated texts, and a null key."""
    rows = [(1, None, "en", "s", 1), (2, "", None, None, None), (3, " \n\t", "en", "s", 1), (4, "123 456 !!", "en", "s", 1), (5, "the of and " * 40_000, "en", "s", 1), (6, "the of and to", "en", "s", 1), (6, "the of and to", "en", "s", 1), (None, "the of and to", "en", "s", 1), *extra]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("spans", F.lit(0))


def test_language_accuracy_on_held_out_texts(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in langid.identify(spark, SF).collect()}
    rows = [r for r in docs.filter(fold_is("doc_id", 3, 1)).collect() if r["text"] and len(r["text"]) > 40]
    assert len(got) == docs.count() and len(rows) > 20
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_spans_scripts_and_odd_rows(spark):
    train = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("the cat and the dog were here", "en"), ("der hund und die katze sind hier", "de"), ("кошка и собака были здесь", "ru")] * 5)], DOCS)
    model = langid.fit(train)
    assert model.langs == ["de", "en", "ru"]
    mixed = spark.createDataFrame([(1, "the dog and the cat were here the dog and the cat were here кошка и собака были здесь кошка и собака были", None, None, 1)], DOCS)
    row = langid.label(mixed, model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "ru"]
    got = langid.label(odd_rows(spark), model).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (1, 2, 3, 4):
        assert by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0
    assert len(by[6]) == 2 and by[6][0] == by[6][1] and by[None][0]["lang_pred"] == by[6][0]["lang_pred"]
    assert langid.label(train.limit(0), langid.fit(train.limit(0))).count() == 0
    assert langid.label(mixed, langid.fit(train.limit(0))).first()["lang_pred"] == "und"


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(5)
    names = [f"l{i:03}" for i in range(300)]
    own = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(own[n]), n, "s", 1) for i, n in enumerate(names)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert model.langs == names and len(model.scores) == langid.BUCKETS // 2
    got = langid.label(spark.createDataFrame(rows, DOCS).select("doc_id", "text"), model).collect()
    assert np.mean([r["lang_pred"] == names[r["doc_id"]] for r in got]) >= 0.99


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, k = int(rng.integers(1, 7)), 3
        e, pen = rng.normal(0, 3, (n, k)), float(rng.uniform(0, 4))
        got = langid.viterbi(e, np.array([0]), np.array([n]), pen)

        def value(p, e=e, pen=pen):
            return sum(e[i, x] for i, x in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:], strict=False))

        best = max(value(p) for p in np.ndindex(*[k] * n))
        assert value(tuple(got)) == pytest.approx(best)


def test_toxic_wording_is_found_and_clean_texts_left_alone(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 60))
        if bad := i % 5 == 0:
            for at in rng.integers(0, 60, 4):
                w[at] = str(rng.choice(["scoundrel", "blockhead", "nitwit"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab.filter("doc_id % 4 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if i % 4 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) >= 0.97
    far = toxicity.Distance(model.toxic, model.ordinary)
    for i, text, *_ in rows[:40]:  # one window at a time, without the workers' memory
        hits = sum(int(far([w])[0, 0]) >= model.threshold for w in toxicity.windows_of(text))
        assert (got[i]["hits"], got[i]["windows"]) == (hits, 60)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(model.bias + model.slope * math.log1p(hits)))))
    long = spark.createDataFrame([(1, " ".join(r[1] for r in rows if r[0] % 5) * 3, "en", "s", 1)], DOCS)
    assert toxicity.score(long, model).first()["predicted"] == 0
    odd = toxicity.score(odd_rows(spark), model).collect()
    assert len(odd) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, lab.limit(0))).collect()} == {0}


def brute_lattice(word, pieces):
    """Sum over all segmentations by plain recursion."""
    w = lattice.MARK + word

    def total(i):
        return 1.0 if i == len(w) else sum(pieces[w[i:j]] * total(j) for j in range(i + 1, len(w) + 1) if w[i:j] in pieces)

    return total(0)


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    p = {x: (i + 1) / 50 for i, x in enumerate(pieces)}
    scores = lattice.UnigramScores(np.log(np.array(list(p.values()))), math.log(1e-3))
    words = ["a", "ab", "abab", "babba", "b" * 30]
    got = lattice.Lattice(pieces).log_probability(words, scores)
    assert np.exp(got) == pytest.approx([brute_lattice(w, p) for w in words])
    used, in_bytes = lattice.Lattice(pieces).expected(["ab"], np.ones(1), scores)
    seg = {("▁", "a", "b"): 0, ("▁", "ab"): 0, ("▁a", "b"): 0, ("▁ab",): 0}
    seg = {s: math.prod(p[x] for x in s) for s in seg}
    for i, x in enumerate(pieces):
        assert used[i] == pytest.approx(sum(v * s.count(x) for s, v in seg.items()) / sum(seg.values()))
    assert in_bytes == 0
    assert lattice.Lattice(pieces).log_probability(["é"], scores)[0] == pytest.approx(math.log(p["▁"]) + 2 * (math.log(1e-3) - math.log(256)))


def test_lm_scores_against_all_segmentations(spark, monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    monkeypatch.setattr(lm, "read_vocabulary", lambda path: pieces)
    rows = [(i, t) for i, t in enumerate(["ab AB bab", "a b abba", "bb", "", None, "ab ab", "é a"])]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 4).collect()}
    own = lattice.initial_scores(len(pieces))
    p, byte = dict(zip(pieces, np.exp(own.pieces), strict=True)), math.exp(own.byte)
    train = Counter(w for _, t in rows[:4] for w in t.lower().split())

    def ways(w):  # every segmentation of a word over these letters
        w = lattice.MARK + w
        def cut(i):
            return [[]] if i == len(w) else [[w[i:j], *rest] for j in range(i + 1, len(w) + 1) if w[i:j] in p for rest in cut(j)]
        return cut(0)

    for _ in range(lm.ROUNDS):
        used = Counter()
        for w, c in train.items():
            weights = [math.prod(q[x] for x in s) for s in ways(w)] if (q := p) else []
            for s, v in zip(ways(w), weights, strict=True):
                for x in s:
                    used[x] += c * v / sum(weights)
        p = {x: (1 - lm.ADAPT) * math.exp(v) + lm.ADAPT * used[x] / sum(used.values()) for x, v in zip(pieces, own.pieces, strict=True)}
    byte = (1 - lm.ADAPT) * byte
    n, docs = sum(train.values()), 4
    for i, t in rows:
        want = math.log10((docs + 1) / (n + docs + 1))
        for w in (t or "").lower().split():
            whole = p["▁"] * (byte / 256) ** 2 if w == "é" else sum(math.prod(p[x] for x in s) for s in ways(w))
            want += math.log10((n + 1) / (n + docs + 1)) + math.log10(whole)
        assert got[i] == pytest.approx(want), i


def brute_base(rows):
    train = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2 if i is not None else True:
            train.update(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, text in rows:
        t = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]
        out.append((i, len(t), sum(train[x] > 0 for x in t), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in t)))
    return out


def test_lm_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 50)  # so that most words take the join
    docs = documents(spark).limit(60).unionByName(odd_rows(spark).select(*documents(spark).columns))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("c", F.lit("x"))
    got = lm.score(docs, ~fold_is("doc_id", 7, 2)).collect()
    key = lambda r: (str(r[0]), r[1], r[4])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
        assert a[5] < 0 and math.isfinite(a[5])
    assert lm.score(docs.limit(0), ~fold_is("doc_id", 7, 2)).count() == 0


def test_lm_prefers_texts_like_its_training(spark):
    docs = documents(spark).select("doc_id", "text").limit(150).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000_002, "zq xj qv wzk jjx qqz vvx")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 10_000_000).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in rows}  # per byte: a lattice charges a long word for every piece
    rate = {r["doc_id"]: r["score"] / size[r["doc_id"]] for r in got}
    assert rate[10_000_002] < min(v for k, v in rate.items() if k < 10_000_000)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_counts_against_brute_force(spark):
    docs = documents(spark).unionByName(odd_rows(spark, (7, "a b\na b\n\n \na b", "en", "s", 1), (8, "x " * 30, "en", "s", 1), (9, "# * $ é€ <|>", "en", "s", 1)).select(*documents(spark).columns))
    rows = Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.select("doc_id", "text").collect())
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = quality.score(docs, model).collect()
    assert Counter(tuple(r)[:6] for r in got) == rows
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality.score(docs, none).collect())


def test_quality_model_on_rows_it_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r["probability"] >= 0.5) == (r["quality"] == 1) for r in rows]) >= 0.9


def test_repeated_words_matches_brute_force_on_random_texts():
    rng = np.random.default_rng(7)
    for _ in range(200):
        ids = rng.integers(0, 2, int(rng.integers(0, 40)))
        assert textstats.repeated_words(ids) == brute_counts(" ".join(map(str, ids)))[4]


def test_em_finds_labeller_accuracies():
    rng = np.random.default_rng(3)
    good = rng.uniform(size=4000) < 0.85
    right = rng.uniform(size=(4000, weaklabel.N_LABELLERS)) < np.where(good, 0.99, 0.6)[:, None]
    votes = np.where(right == good[:, None], 1, 0)
    patterns, counts = np.unique([weaklabel.pattern_of(v) for v in votes.tolist()], return_counts=True)
    model = weaklabel.estimate(patterns, counts.astype(float))
    p = dict(zip(patterns.tolist(), model.posterior(patterns), strict=True))
    said = np.array([p[weaklabel.pattern_of(v)] for v in votes.tolist()]) > 0.5
    assert (said == good).mean() > 0.97


def test_em_rates_follow_the_votes_and_not_the_start():
    """Labellers with rates far from the start: the estimates come out as they were drawn."""
    rng = np.random.default_rng(8)
    n = 20_000
    good = rng.uniform(size=n) < 0.7
    hit = rng.uniform(0.5, 0.9, weaklabel.N_LABELLERS)
    alarm = rng.uniform(0.01, 0.2, weaklabel.N_LABELLERS)
    junk = rng.uniform(size=(n, len(hit))) < np.where(good[:, None], alarm, hit)
    patterns, counts = np.unique([weaklabel.pattern_of(v) for v in (1 - junk).tolist()], return_counts=True)
    model = weaklabel.estimate(patterns, counts.astype(float))
    assert np.abs(model.rates[:, 0, 1] - hit).max() < 0.03 and np.abs(model.rates[:, 1, 1] - alarm).max() < 0.03
    assert abs(model.good - 0.7) < 0.02


def test_sample_of_copies_without_doc_id_stays_bounded(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(weaklabel, "train", lambda sample, target: drawn.append(sample.collect()))
    texts = ["the same text again"] * 500 + [f"a text of number {i}" for i in range(400)]
    weaklabel.fit(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"), 100)
    assert 30 < len(drawn[0]) <= 100 and len({r["text"] for r in drawn[0]}) == len(drawn[0])


def test_weak_labels_agree_with_quality_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = weaklabel.score(docs, weaklabel.fit(docs)).join(labels, "doc_id").collect()
    assert np.mean([r["kept_"] for r in got if r["quality"] == 1]) >= 0.98
    assert np.mean([not r["kept_"] for r in got if r["quality"] == 0]) >= 0.6
    odd = odd_rows(spark)
    out = weaklabel.score(odd, weaklabel.fit(odd)).collect()
    assert len(out) == 8 and all(not r["kept_"] and r["score_"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert weaklabel.score(docs.limit(0), weaklabel.fit(docs.limit(0))).count() == 0
