"""The training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import brown, decontaminate, licences, near_sets, outliers, packing, quality, simhash, toxicity, urls, warc
from tidewatch.llm._shared import Workspace, held_out
from tidewatch.llm.components import components
from tidewatch.llm.hashed_terms import WORDS as WORD_TERMS
from tidewatch.llm.hashed_terms import Lookup
from tidewatch.llm.queries import RULES, tokenizer_path

WORDS = [a + b for a in ("ba", "de", "lo", "mi", "ru", "ta", "ne", "so") for b in ("ka", "lan", "mor", "nis", "per", "to", "vu", "x")]
DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "one", "One,  two", "x" * 50_000, "é ß   ж", "a b c d e f g h " * 40, "<|endoftext|> a"]


def test_crc_folds(spark):
    got = spark.createDataFrame([(i,) for i in (0, 7, 12345, None)], "doc_id long").select("doc_id", held_out(F.col("doc_id"), 5).alias("h")).collect()
    for r in got:
        assert r.h == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 400)] + [(5, 5), (900, 901), (901, 902), (902, 900)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {x: top(x) for x in up}
    got = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t"))
    rows = got.collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == {k: v for k, v in want.items() if k != 5}
    hubs = components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t"), hub=8)
    assert {r.node: r.component for r in hubs.collect()} == {k: v for k, v in want.items() if k != 5}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (30, 60, 120, 200)]
    texts = list(ODD)
    for b in base:
        texts += [b, b.upper()]
        for _ in range(6):
            w = b.split()
            w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w))
    fp = [brute_fingerprint(t) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        return x if up[x] == x else top(up[x])

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    got = simhash.near_duplicates(table(spark, texts).withColumn("fp", F.lit(1)), tile=4).collect()
    assert {r.id: (r.fp.hex(), r.component_id) for r in got} == {i: (f"{fp[i]:016x}", top(i)) for i in range(len(fp))}
    assert simhash.near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_wide_fingerprints_tell_similar_pairs():
    rng = random.Random(14)
    radius, lead = simhash.radius_for(0.8, 1024, 2), (4, simhash.radius_for(0.8, 256, 3))
    near, far, n_near, n_far, spread = 0, 0, 0, 0, []
    for _ in range(300):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(60, 400))]
        v = list(w)
        for _ in range(rng.randrange(0, 1 + len(w) // 12)):
            v[rng.randrange(len(v))] = "zzz"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (w, v))
        like = len(a & b) / len(a | b)
        x, y = (np.frombuffer(simhash.fingerprint(simhash.shingle_hashes(" ".join(t).encode(), 5, 42), 16), ">u8").astype(np.uint64)[None] for t in (w, v))
        hit = any(len(r) for r, _ in simhash.near_pairs(x, y, radius, lead))
        bits = int(np.bitwise_count(x ^ y).sum())
        spread.append((bits - simhash.radius_for(like, 1024, 0)) / 11.5)
        assert not hit or bits <= radius
        near, n_near = near + (hit and like >= 0.8), n_near + (like >= 0.8)
        far, n_far = far + (hit and like < 0.68), n_far + (like < 0.68)
    assert n_near > 50 and near >= 0.97 * n_near
    assert n_far > 50 and far <= 0.03 * n_far
    assert np.std(spread) < 1.5


def test_near_pairs_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(15)
    base = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    x = np.repeat(base, 10, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64))
    want = {(i, j) for i in range(400) for j in range(400) if int(np.bitwise_count(x[i] ^ x[j]).sum()) <= 3}
    got = [(a, b) for r, c in simhash.near_pairs(x, x, 3, block=64) for a, b in zip(r.tolist(), c.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    led = [(a, b) for r, c in simhash.near_pairs(x, x, 3, (1, 3), block=64) for a, b in zip(r.tolist(), c.tolist(), strict=True)]
    assert len(led) == len(set(led)) and set(led) == want


def test_deduplicate_keeps_the_least_of_each_group(spark):
    rng = random.Random(4)
    a, b = prose(rng, 300), prose(rng, 300)
    w = a.split()
    w[10], w[200] = "zzz", "yyy"
    got = simhash.deduplicate(table(spark, [b, a, a, " ".join(w), prose(rng, 300), None])).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 4, 5]


def test_near_groups_are_those_of_the_exact_similarity(spark):
    rng = random.Random(8)
    texts = [*ODD]
    for n in [8, 9, 16, 24, 40, 60, 120, 300] * 6:
        w = prose(rng, n).split()
        texts.append(" ".join(w))
        for _ in range(3):  # cut or edited, to similarities about 0.8
            v = w[: n - rng.randint(0, n // 4)]
            for _ in range(rng.randint(0, 1 + n // 60)):
                v[rng.randrange(len(v))] = "zz"
            texts.append(" ".join(v))
    block = prose(rng, 200)
    texts += [prose(rng, 30) + " " + block for _ in range(12)] + [block, block + " " + block]
    w = prose(rng, 9).split()
    texts += [" ".join(w), " ".join(w[:8])]  # five shingles against four: 0.8
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5, 42).tolist()) for t in texts]
    up, close = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            close.append(both / max(1, either))
            if 5 * both >= 4 * either:
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert sum(0.7 < s < 0.8 for s in close) > 10 and sum(0.8 <= s < 0.85 for s in close) > 10
    for options in ({}, {"tile_sets": 3}):
        got = {r.id: r.component_id for r in near_sets.near_groups(table(spark, texts), **options).collect()}
        assert got == dict(enumerate(up))
    kept = {r.doc_id for r in simhash.deduplicate(table(spark, texts)).collect()}
    assert kept == set(up)
    assert near_sets.near_groups(table(spark, texts).limit(0)).count() == 0


def test_toxicity_learns_a_pair_and_scores_odd_texts(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        kind = i % 4
        extra = [[], ["grumble"], ["folk"], ["grumble", "folk"]][kind]
        rows.append((i, " ".join(rng.sample(WORDS, 15) + extra)))
        labels.append((i, int(kind == 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"), rounds=8)
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 5 = 0"), model).collect()}
    assert np.mean([(s >= 0.5) == bool(labels[i][1]) for i, s in got.items()]) > 0.95
    odd = toxicity.score(table(spark, ODD).withColumn("score", F.lit(9)), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    for r in odd:
        ids = Lookup(WORD_TERMS, model.chosen)((ODD[r.doc_id] or "").encode())[0]
        z = model.w0 + sum(model.w[a] for a in ids) + sum(float(model.v[a] @ model.v[b]) for i, a in enumerate(ids) for b in ids[:i])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert toxicity.score(table(spark, ODD).limit(0), model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(np.empty(0, np.int64)) < 0.5


def test_toxicity_learns_a_pair_of_terms_that_are_neutral_alone(spark):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(1600):
        # Each term stands in half of the texts of either class; toxic texts have both or neither.
        kind, toxic = i % 4, i % 2
        extra = [["grumble"], [], ["folk"], ["grumble", "folk"]][kind]
        rows.append((i, " ".join(rng.sample(WORDS, 15) + extra)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, train, rounds=12)
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id % 5 = 0"), model).collect()}
    both = [s for i, s in got.items() if i % 4 == 3]
    one = [s for i, s in got.items() if i % 4 in (0, 2)]
    assert np.mean([s >= 0.5 for s in both]) > 0.95 and np.mean([s < 0.5 for s in one]) > 0.95
    # The same rows in other partitions and another order: the same model.
    again = toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(7), train.repartition(3), rounds=12)
    assert again.w0 == model.w0 and np.array_equal(again.w, model.w) and np.array_equal(again.v, model.v)


def test_quality_orders_three_grades(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        g = i % 3
        text = [" ".join(w.upper() + "!!" for w in rng.sample(WORDS, 20)), " ".join(w + "%%" if k % 2 else w for k, w in enumerate(rng.sample(WORDS, 20))), " ".join(rng.sample(WORDS, 20))][g]
        rows.append((i, text))
        labels.append((i, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), grades=3)
    assert model.theta[0] < model.theta[1]
    got = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    mean = [np.mean([got[i].expected_grade for i in range(g, 900, 3)]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.6 < mean[2]
    assert len(quality.keep_good(table(spark, ODD), model).collect()) <= len(ODD)


def test_class_model_is_a_distribution_and_base_is_exact(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(5, 60)) for _ in range(120)] + ["", None, "unseen-word never", "A a A"]
    docs = table(spark, texts)
    train = docs.where(~held_out(F.col("doc_id"), 10))
    few = {"exchange_words": 20, "known_words": 30, "classes": 4, "rare": 3, "rounds": 6}
    got = {r.doc_id: r for r in brown.score(docs.withColumn("row", F.lit(1)), ~held_out(F.col("doc_id"), 10), **few).collect()}
    apart = {r.doc_id: r for r in brown.score(docs.withColumn("doc_id", F.col("doc_id").cast("smallint")), train, **few).collect()}
    assert all(apart[i].score == pytest.approx(r.score) and apart[i].n_known == r.n_known for i, r in got.items())
    counts, n = {}, 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(w in counts for w in tokens(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in tokens(t)))
        assert r.score < 0
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    # Every class is a distribution over its words, seen and unseen, and every row of steps over classes.
    work = Workspace(spark, "b")
    words = brown.vocabulary(train, work, known_words=30)
    coded = work.save(brown.encode(train, "doc_id", "text", 10, F.lit(True), *words.lookup(), 3), "coded").where("word is null")
    model = brown.fit(coded, words, exchange_words=20, classes=4, rare=3, rounds=6)
    step, last = 10**model.step, len(model.step) - 1
    assert np.allclose(step.sum(axis=1), 1) and len(model.klass) == len(words.hashes) <= 30
    mass, rank = np.zeros(len(step)), {h: i for i, h in enumerate(words.hashes.tolist())}
    place = {}
    for w, c in counts.items():
        i = rank.get(xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (xxhash.xxh64_intdigest(w, 42) >> 63))
        if w and i is not None:
            assert words.count[i] == c
            place[w] = model.klass[i], model.emit[i]
        elif w:
            k = brown.rare_class(w, 3)
            place[w] = 4 + k, math.log10((c - model.discount) / model.rare_total[k])
        if w:
            mass[place[w][0]] += 10 ** place[w][1]
    for k in range(3):
        mass[4 + k] += 10 ** model.unseen[k]
    used = np.bincount(model.klass, minlength=4) > 0
    assert np.allclose(mass[:4][used], 1) and np.allclose(mass[4:last], 1)
    # The score of every text, word by word.
    for i, t in enumerate(texts):
        before, total = last, 0.0
        for w in tokens(t):
            k, e = (last, 0.0) if not w else place.get(w) or (4 + brown.rare_class(w, 3), model.unseen[brown.rare_class(w, 3)])
            total, before = total + model.step[before, k] + e, k
        assert got[i].score == pytest.approx(total)
    assert brown.score(docs.limit(0), ~held_out(F.col("doc_id"), 10)).count() == 0
    bare = brown.score(docs, docs.limit(0)).collect()
    assert len(bare) == len(texts) and all(r.train_tokens == 0 and r.n_known == 0 for r in bare)


def test_exchange_never_lowers_the_likelihood_and_finds_hidden_classes(spark):
    rng = random.Random(17)
    kinds = [[f"{k}w{i}" for i in range(12)] for k in "abc"]
    texts = [" ".join(rng.choice(kinds[i % 3]) for i in range(rng.randrange(6, 30))) for _ in range(300)]
    docs = table(spark, texts)
    work = Workspace(spark, "b")
    words = brown.vocabulary(docs, work)
    coded = work.save(brown.encode(docs, "doc_id", "text", 10, F.lit(True), *words.lookup(), 3), "coded").where("word is null")
    n = len(words.hashes)
    pairs = work.save(brown.bigrams(coded, lambda ids: ids, n + 2), "pairs")
    klass, table_, history = brown.exchange_classes(pairs, n, 3, 30)
    assert all(b >= a for a, b in zip(history, history[1:], strict=False)) and history[-1] > history[0]
    name = {h: w for k in kinds for w in k for h in [xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (xxhash.xxh64_intdigest(w, 42) >> 63)]}
    kind = [name[h][0] for h in words.hashes.tolist()]
    assert np.mean([max(np.bincount(klass[:n][[x == k for x in kind]])) / kind.count(k) for k in "abc"]) > 0.9
    # Words that join later go where those of their kind are.
    fitted = brown.fit(coded, words, exchange_words=24, classes=3, rare=3, rounds=30)
    assert np.mean([max(np.bincount(fitted.klass[[x == k for x in kind]])) / kind.count(k) for k in "abc"]) > 0.9


def test_joining_gain_is_exact():
    rng = np.random.default_rng(3)
    table_ = rng.integers(1, 30, (5, 5)).astype(float)
    table_[3], table_[:, 3] = 200.0, 200.0  # other words, of which the word is one
    for _ in range(40):
        codes = rng.choice(10, 4, replace=False)
        n = rng.integers(1, 5, 4)
        scores = []
        for c in range(3):
            moved = table_.copy()
            for code, x in zip(codes, n, strict=True):
                old, new = ((3, code), (c, code)) if code < 5 else ((code - 5, 3), (code - 5, c))
                moved[old] -= x
                moved[new] += x
            scores.append(brown.likelihood(moved))
        assert brown.joining_classes([(codes, n)], table_, 3)[0] == int(np.argmax(scores))


def test_exchange_gain_is_exact():
    rng = np.random.default_rng(0)
    n, k = 8, 3
    pairs = rng.integers(0, 9, (n, n)).astype(float)
    home = np.arange(n) % k

    def likelihood(kl):
        t = np.zeros((k, k))
        np.add.at(t, (kl[:, None].repeat(n, 1), kl[None, :].repeat(n, 0)), pairs)
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    right, left, table_ = np.zeros((n, k)), np.zeros((n, k)), np.zeros((k, k))
    for a in range(n):
        for b in range(n):
            right[a, home[b]] += pairs[a, b]
            left[b, home[a]] += pairs[a, b]
            table_[home[a], home[b]] += pairs[a, b]
    to, gain = brown.best_moves(right, left, np.diag(pairs).copy(), home, table_, k)
    for w in range(n):
        scores = []
        for c in range(k):
            moved = home.copy()
            moved[w] = c
            scores.append(likelihood(moved) - likelihood(home))
        assert gain[w] == pytest.approx(max(scores), abs=1e-8)
        assert scores[to[w]] == pytest.approx(max(scores), abs=1e-8)


def test_licences_by_variant(spark):
    mit = dict(licences.KNOWN_TEXTS[::-1])["MIT"]
    text = licences._MIT
    variant = "Copyright (c) 2019 Some Body\nAll rights reserved.\n\n" + text.replace("Software", "SOFTWARE").replace(",", " , ")
    got = licences.scan(table(spark, [variant, text + " more", "intro\nLicensed under CC BY 4.0.\nend", None, "", text.replace("sublicense", "sublicence")]).withColumn("notices", F.lit(1)), licences.known_table(spark)).orderBy("doc_id").collect()
    text_of = dict(licences.KNOWN_TEXTS[::-1])
    gate = licences.gate_words(licences.KNOWN_TEXTS)
    assert gate and all(any(g in t.lower() for g in gate) for _, t in licences.KNOWN_TEXTS)
    more = [
        "// Copyright (c) Jane Doe\n" + text,  # no year, behind a comment mark
        text.replace('"', "\u201c").replace("-", "\u2014"),
        text.replace("sublicense", "sublicence").replace("license", "licence"),
        "before\n" + " ".join(text.split()) + "\nafter",  # the whole licence on a line, far over 400 characters
        "x\n" + " ".join(licences._ZLIB.split()).upper() + "\n",
        "Licence licence licence",
        "license license license",
        "z " * 60_000,
    ]
    both = [licences.scan(table(spark, more), licences.known_table(spark), gate=g).orderBy("doc_id").collect() for g in (gate, ())]
    assert both[0] == both[1]
    assert [(r.license_id, r.notices) for r in both[0]] == [("MIT", None)] * 3 + [(None, "MIT"), (None, "Zlib"), (None, None), (None, None), (None, None)]
    assert both[0][5].digest == both[0][6].digest
    assert licences.scan(table(spark, more).limit(0), licences.known_table(spark)).count() == 0
    assert licences.scan(table(spark, [text_of["BSL-1.0"], text_of["MPL-2.0"]]), licences.known_table(spark)).where("license_id is null").count() == 0
    assert mit and [r.license_id for r in got] == ["MIT", None, None, None, None, "MIT"]
    assert got[2].notices == "CC-BY-4.0" and got[3].digest == got[4].digest


def test_url_rules_and_model(spark):
    model = urls.fit(urls.labelled_table(spark))
    cases = {
        "https://a.b.COM/en/x?q": ("a.b.com", "/en/x", "com/", "allow"),
        "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.com?/en/": ("x.com", "", None, None),
        "http://casino-bets.example.org/win": ("casino-bets.example.org", "/win", None, "block"),
        "http://library.example.org/en/3": ("library.example.org", "/en/3", None, "allow"),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    for r in urls.judge(pages, RULES, model).collect():
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_warc_round_trip_in_small_chunks(spark):
    big = "é" * 5000
    bodies = {1: big, 2: "tiny", 3: big, 4: "tiny", 5: None, 6: "a\r\n\r\nWARC/1.1\r\n" * 90, 9: big}
    pages = spark.createDataFrame([(i, f"http://x/{i}\n", b) for i, b in bodies.items()] + [(None, "u", "b")], "page_id long, url string, html string")
    chunks = Workspace(spark, "w").save(warc.write_chunks(pages, chunk=700), "chunks")
    assert chunks.agg(F.max(F.length("data"))).first()[0] < 1300
    for r in warc.read(chunks).collect():
        body = (bodies[r.record_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if r.record_id in (1, 3) else ("response", None))
    assert warc.read(chunks).count() == len(bodies)
    with pytest.raises(Exception, match="out of order|no last chunk"):
        warc.read(chunks.where("not (record_id = 6 and chunk = 1)")).collect()


def test_warc_long_urls_and_repeated_pages(spark):
    big, far = "b" * 3000, "http://x/" + "u" * 100_000
    given = [(1, far, "a" * 1500), (2, "u", big), (2, "u", big), (3, "u", big), (3, "u", big), (3, "v", "c" * 2500), (4, "w", None), (4, "w", None)]
    chunks = Workspace(spark, "w").save(warc.write_chunks(spark.createDataFrame(given, "page_id long, url string, html string"), chunk=700), "chunks")
    got = sorted((r.record_id, r.url, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read(chunks).collect())
    assert got == sorted((i, u, hashlib.sha1((b or "").encode()).hexdigest(), *(("revisit", 3) if i == 2 else ("response", 0))) for i, u, b in given)


def test_fast_ids_equal_the_tokenizer_files(tmp_path):
    import json

    from tokenizers import Tokenizer

    rng = random.Random(13)
    tok, tokens = Tokenizer.from_file(tokenizer_path()), packing.Tokens(tokenizer_path())
    assert tokens.fast is not None
    signs = ["a", "B", "é", "ß", "ж", "日", "1", "²", "'s", "'LL", " ", "  ", "\n", "\t", "\u00a0", "\u180e", "\u2003", "\u200b", "!", "<|endoftext|>", "😀", "\x00", "़"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)] + [chr(c) * 3 + " " + chr(c) for c in range(1, 0x3000)] + [" " * 6000 + "a", "x" * 20_000]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert tokens(t) == np.array(e.ids, "<u4").tobytes()
    # A file that isn't plain byte-level BPE is run as it is.
    spec = json.loads(tok.to_str())
    spec["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "t.json"
    other.write_text(json.dumps(spec))
    lower = packing.Tokens(str(other))
    assert lower.fast is None and lower("ABC d") == tokens("abc d")


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.choice([3, 40, 900, 4000])) + rng.choice(["", "\n", "  x", "\ty"]) for _ in range(60)]
    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(table(spark, texts).repartition(5), tokenizer_path(), open_windows=4, fan_in=2).collect()
    by = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        parts = sorted(by[i], key=lambda r: r.start)
        assert b"".join(p.ids for p in parts) == ids and {p.doc_tokens for p in parts} == {len(ids) // 4}
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        n = sum(r.length for r in s)
        assert 0 < n <= 2048
        padded += 0 if n & (n - 1) == 0 else 2048 - n
    assert padded < 0.01 * sum(r.length for r in rows)
    assert packing.pack(table(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_text_statistics_equal_brute_force(spark):
    rng = random.Random(9)
    texts = ODD + [prose(rng, 30) + "\n" + "a b c d e f g h i\n" * k + "# $ <x>\n \n" for k in range(4)] + [prose(rng, 25) for _ in range(30)]
    got = {r.doc_id: r for r in outliers.verdicts(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + j for k, x in enumerate(win) if win.count(x) > 1 for j in range(8)} if len(win) < 2000 else None
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(hit)
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_outliers_reject_far_texts_of_their_group(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(40, 90)) for _ in range(300)] + [" ".join(w + "$#$" for w in prose(rng, 60).split()) for _ in range(8)]
    got = {r.doc_id: r for r in outliers.verdicts(table(spark, texts)).collect()}
    assert sum(got[i].kept for i in range(300)) >= 298 and not any(got[i].kept for i in range(300, 308))
    assert outliers.verdicts(table(spark, texts).limit(0)).count() == 0
    # Small groups are judged too, by their language or by all texts.
    small = spark.createDataFrame([(i, t, "en" if i % 20 else "fr", f"s{i % 30}") for i, t in enumerate(texts)] + [(900, None, None, None)], DOCS)
    kept = {r.doc_id: r.kept for r in outliers.verdicts(small.withColumn("d2", F.lit(1)).withColumn("group", F.lit("g"))).collect()}
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[i] for i in [*range(300, 308), 900])
    few = outliers.verdicts(small.where("doc_id < 5 or doc_id > 305")).collect()
    assert all(r.base_failed or r.d2 is not None for r in few)


def test_estimates_have_the_determinant_of_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(0, 1, (5, 5)) + 3 * np.eye(5)
    rows = []
    for g, n in (("a", 400), ("b", 60)):
        x = rng.normal(0, 1, (n, 5)) @ mix
        x[: n // 6] = rng.normal(0, 0.3, (n // 6, 5)) + 40  # a tight cluster far away
        rows += [(g, i, *map(float, v)) for i, v in enumerate(x)]
    fit = spark.createDataFrame(rows, "group string, doc_id long, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r["group"]: r for r in outliers.estimates(fit, Workspace(spark, "o")).collect()}
    for g in ("a", "b"):
        x = np.array([r[2:] for r in rows if r[0] == g])
        best = None
        for _ in range(60):  # concentration from random starts, exact subsets
            at = rng.choice(len(x), 8, replace=False)
            for _ in range(30):
                c, m = np.cov(x[at].T, bias=True) + 1e-9 * np.eye(5), x[at].mean(axis=0)
                at = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[: -(-3 * len(x) // 4)]
            det = np.linalg.det(np.cov(x[at].T, bias=True) * outliers.consistency(0.75, 5))
            if best is None or det < best[0]:
                best = det, x[at].mean(axis=0)
        assert got[g].det == pytest.approx(best[0], rel=0.25)
        assert np.allclose([got[g][f"m{i}"] for i in range(5)], best[1], atol=1.0)
    # Closest shares of normal vectors, corrected, have the variance of all.
    x = rng.normal(0, 1, (200_000, 5))
    near = x[np.argsort((x * x).sum(axis=1))[:150_000]]
    assert outliers.consistency(0.75, 5) * near.var() == pytest.approx(1, rel=0.01)


def test_edit_distance_of_stretches():
    rng = random.Random(11)
    for _ in range(60):
        item, text = [rng.randrange(4) for _ in range(6)], [rng.randrange(4) for _ in range(rng.randrange(0, 12))]

        def dist(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            return row[-1]

        best = min(dist(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        got = decontaminate.edit_within(np.array(item), np.array(text, int), 3)
        assert (got[0] if got else None) == (best if best <= 3 else None)
        if got:
            assert dist(item, text[got[1] : got[2]]) == got[0]


def test_decontamination_recall_on_edited_passages(spark):
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(20, 50))) for k in range(30)]
    rows, want = [], set()
    for i in range(150):
        k, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randrange(0, int(0.15 * len(w)) + 1)):
            at, op = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [["zzz"], [], [w[at], "yyy"]][op]
        rows.append(prose(rng, rng.randrange(0, 80)) + " " + " ".join(w).upper() + ". " + prose(rng, 30))
        want.add((i, k))
    clean = [prose(rng, 200) for _ in range(50)]
    docs = table(spark, rows + clean + ODD)
    bench = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    # Passages with as many edits as are allowed, against brute force.
    index, at_limit, hit = decontaminate.build(items), 0, 0
    for k, text in items * 10:
        w = text.encode().split()
        for _ in range(int(0.15 * len(w))):
            at, op = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 1] = [[b"zzz"], [], [w[at], b"yyy"]][op]
        whole = prose(rng, 30).encode().split() + w + prose(rng, 30).encode().split()
        ids = np.array([index.vocabulary.get(x, 1) for x in whole])
        sure = {i for (i, n), e in zip(index.items, index.edits, strict=True) if decontaminate.edit_within(n, ids, int(e))}
        found = {m[0] for m in index.matches(whole)}
        assert k in sure and found <= sure
        at_limit, hit = at_limit + len(sure), hit + len(found)
    assert hit >= 0.98 * at_limit
    few = decontaminate.build([(1, "lone"), (2, "two words"), (3, None), (4, " . ")])
    assert [m[0] for m in few.matches(b"a lone one , two words".split())] == [1, 2] and not few.matches(b"two".split())
    assert decontaminate.build([]).matches(b"two".split()) == []
    long = prose(rng, 3000)
    cut = long.split()
    cut[100:150], cut[2000:2000] = [], ["zzz"] * 60
    assert [m[0] for m in decontaminate.build([(5, long), *items]).matches(" ".join(cut).encode().split())] == [5]
    kept = {r.doc_id for r in decontaminate.keep_clean(docs.withColumn("item_id", F.lit(1)), bench).collect()}
    assert kept == set(range(len(rows) + len(clean) + len(ODD))) - {i for i, _ in got}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0


def changed(rng, w, edits, bunched):
    """``w`` with so many changes of one word each, spread over it or within its first 64 words."""
    w, places = list(w), range(min(64, len(w))) if bunched else range(len(w))
    for at in sorted(rng.sample(places, edits), reverse=True):
        w[at : at + 1] = [[b"zzz"], [], [w[at], b"yyy"]][rng.randrange(3)]
    return w


@pytest.mark.parametrize("bunched", [False, True], ids=["spread", "bunched"])
@pytest.mark.parametrize("n", [20, 64, 96, 97, 100, 127, 128, 191, 500, 3000])
def test_items_of_any_length_are_found_at_the_limit_of_edits(n, bunched):
    rng = random.Random(n + bunched)
    tries, hit = (120 if n < 200 else 40 if n == 500 else 10), 0
    for _ in range(tries):
        item = [f"w{rng.randrange(4000)}".encode() for _ in range(n)]
        index = decontaminate.build([(7, b" ".join(item).decode())])
        edits = min(index.edits[0], 60)
        around = [[f"w{rng.randrange(4000)}".encode() for _ in range(rng.randrange(0, 90))] for _ in range(2)]
        hit += [m[0] for m in index.matches(around[0] + changed(rng, item, edits, bunched) + around[1])] == [7]
    assert hit >= 0.98 * tries, (n, hit, tries)


def test_pieces_cover_their_item_and_share_its_edits():
    rng = random.Random(5)
    for n in (*range(1, 140), 191, 500, 3000):
        index = decontaminate.build([(1, " ".join(f"w{k}" for k in range(n)))])
        assert np.concatenate([w for *_, w in index.units]).tolist() == index.items[0][1].tolist()
        assert max(index.lengths) - min(index.lengths) <= 1 and max(index.lengths) <= 96
        # However the edits fall, one piece has no more than its limit.
        ends, e = np.cumsum(index.lengths), index.edits[0]
        for _ in range(5):
            fell = np.bincount(np.searchsorted(ends, rng.choices(range(n), k=e), side="right"), minlength=len(ends)) if e else np.zeros(len(ends))
            assert (fell <= index.unit_edits).any()


def test_groups_of_few_good_texts_are_judged_by_a_wider_one(spark):
    rng = random.Random(14)
    usual = [(i, prose(rng, rng.randrange(40, 90)), "en", "web") for i in range(200)]
    short = [(1000 + i, "too short", "en", "rare") for i in range(60)]
    odd = [(2000, " ".join(w + "$#$" for w in prose(rng, 60).split()), "en", "rare"), (2001, prose(rng, 60), "en", "rare")]
    got = {r.doc_id: r for r in outliers.verdicts(spark.createDataFrame(usual + short + odd, DOCS)).collect()}
    assert not got[2000].kept and got[2000].d2 > 36 and got[2001].kept
    assert not any(got[1000 + i].kept for i in range(60))


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "date", "double", "binary"])
def test_packing_takes_ids_of_any_type(spark, kind):
    rng = random.Random(15)
    column = F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")) if kind == "date" else F.col("doc_id").cast("string").cast("binary") if kind == "binary" else F.col("doc_id").cast(kind)
    docs = table(spark, [prose(rng, 30) for _ in range(20)] + [None, "same", "same"]).withColumn("doc_id", column)
    pieces = packing.pack(docs, tokenizer_path())
    assert pieces.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert pieces.select("doc_id").distinct().exceptAll(docs.select("doc_id")).count() == 0 and pieces.select("doc_id").distinct().count() == 23


def test_url_model_on_hosts_that_it_has_not_seen(spark):
    model = urls.fit(urls.labelled_table(spark))
    hosts = {urls.split_url(u)[0].split(".example")[0].split(".")[-1] for u, _ in urls.LABELLED_URLS}
    bad = "casino-royal bets-online cheap-viagra-pills win-money-fast ads-server click-ads spam-site pills-shop adult-cams poker-bonus free-slots loans-payday seo-links-farm jackpot-casino tracker-pixel".split()
    good = "orchid harp notebook lighthouse physics astronomy beekeeping carpentry juniper marble pelican sonnet walnut zephyr brook thicket drizzle parchment quill saddle zorblat qwuvip plimnek vastorin".split()
    assert not hosts & {*bad, *good}
    tail = ["/en/12", "/fr/7.html", "/de/3"]
    got = {h: model.score(f"{pre}{h}.example.{end}", tail[k % 3]) >= 0.5 for k, h in enumerate(bad + good) for pre, end in (("", "org"),)}
    assert sum(got[h] for h in bad) >= 0.85 * len(bad) and sum(got[h] for h in good) <= 0.05 * len(good), got
    # Far more hosts of invented syllables, none of which means anything.
    rng = random.Random(3)
    made = ["".join(rng.choice("bdfklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    assert sum(model.score(f"www.{h}.example.net", "/en/5") >= 0.5 for h in made) <= 0.03 * len(made)


def test_fingerprints_find_pairs_right_at_the_similarity_whatever_their_size():
    rng, like = np.random.default_rng(21), Fraction(4, 5)
    rate = simhash.flip_rate(like)
    assert rate == 0.1875  # four hashes against those and a fifth: the four tie, and the fifth decides
    radius, lead = simhash.radius_within(rate, 1024, near_sets.LOST), simhash.radius_within(rate, 256, near_sets.LOST)
    for bits, r in ((1024, radius), (256, lead)):
        tails = [sum(math.comb(bits, k) * Fraction(3, 16) ** k * Fraction(13, 16) ** (bits - k) for k in range(least, bits + 1)) for least in (r + 1, r)]
        assert tails[0] <= near_sets.LOST < tails[1]
    for a, b, both in ((4, 5, 4), (8, 10, 8), (9, 9, 8), (12, 15, 12), (20, 25, 20), (40, 41, 36), (200, 250, 200)):
        assert Fraction(both, a + b - both) == like
        for _ in range(200):
            h = rng.integers(0, 2**64, a + b - both, dtype=np.uint64)
            x, y = (np.frombuffer(simhash.fingerprint(part, near_sets.WORDS), ">u8").astype(np.uint64)[None] for part in (h[:a], h[a - both :]))
            assert any(len(r) for r, _ in simhash.near_pairs(x, y, radius, (near_sets.LEAD, lead)))
    assert simhash.flip_rate(Fraction(1)) == 0 and simhash.radius_within(0, 1024, 1e-12) == 0


def test_near_copies_are_searched_by_fingerprints_and_confirmed_exactly(spark, monkeypatch):
    rng, seen = random.Random(22), []
    a, b = prose(rng, 60).split(), prose(rng, 60).split()
    texts = [" ".join(a), " ".join([*a[:58], "zz", "yy"]), " ".join([*a[:52], *"klmnopqr"]), " ".join(b), " ".join(a)]
    docs, links = table(spark, texts), simhash.links

    def spy(classes, work, radius, words, **options):
        found = links(classes, work, radius, words, **options)
        seen.append(({r.rep: bytes(r.fp) for r in classes.collect()}, {x for r in found.collect() for x in (r.a, r.b)}))
        return found

    monkeypatch.setattr(near_sets, "links", spy)
    assert {r.id: r.component_id for r in near_sets.near_groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}
    (prints, candidates), sets = seen[0], [np.unique(simhash.shingle_hashes(t.encode(), 5, 42)) for t in texts]
    assert prints and all(fp == simhash.fingerprint(sets[i], 16) for i, fp in prints.items())
    assert 2 in candidates  # of similarity 48 / 64: a link of fingerprints that the sets don't confirm
    monkeypatch.setattr(near_sets, "links", lambda *x, **y: spark.createDataFrame([], "a long, b long"))
    assert {r.id: r.component_id for r in near_sets.near_groups(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_links_of_dense_groups_connect_what_their_pairs_connect(spark):
    rng = np.random.default_rng(23)
    base, rows = rng.integers(0, 256, (3, 128), dtype=np.uint8), []
    for i in range(600):
        bits = np.unpackbits(base[0 if i < 400 else i % 3])
        bits[rng.choice(1024, 40, replace=False)] ^= 1
        rows.append((i, np.packbits(bits).tobytes(), 100 if i % 7 else 200))
    x, n = np.frombuffer(b"".join(fp for _, fp, _ in rows), ">u8").astype(np.uint64).reshape(-1, 16), np.array([r[2] for r in rows])
    up = list(range(600))
    near = (np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=np.int64) <= 80) & (n[:, None] == n[None])
    for i in range(600):
        for j in np.flatnonzero(near[i, :i]).tolist():
            if up[i] != up[j]:
                a, b = sorted((up[i], up[j]))
                up = [a if t == b else t for t in up]
    assert len(set(up)) == 6
    for tile in (4096, 50):
        work = Workspace(spark, "dense")
        found = work.save(simhash.links(spark.createDataFrame(rows, "rep long, fp binary, n long"), work, 80, 16, parts=0, ratio=1.25, tile=tile), "links")
        got = {r.node: r.component for r in components(found, work).collect()}
        assert [got.get(i, i) for i in range(600)] == up


def _rows_out(df, name):
    """Rows that each node of the plan of that name gave, once ``df`` has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == name:
            found.append(node.metrics().apply("numOutputRows").value())
        kids = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        todo += kids
    return found


def test_tiles_are_copied_by_the_root_of_their_number(spark):
    rng = np.random.default_rng(24)
    rows = [(i, rng.integers(0, 256, 8, dtype=np.uint8).tobytes(), 100) for i in range(640)]
    work = Workspace(spark, "root")
    found = simhash.links(spark.createDataFrame(rows, "rep long, fp binary, n long"), work, 2, 1, parts=0, ratio=1.25, tile=10)
    found.collect()
    # 64 tiles, each taken two steps of size, of which one has a cell, and to its 8 blocks.
    assert sorted(_rows_out(found, "Generate")) == [64 * 2, 64 * 8]


def test_shared_hashes_are_those_of_brute_force(spark):
    rng = np.random.default_rng(25)
    sets = {}
    for d in range(-40, 40):
        h = rng.integers(-(2**63), 2**63, 30) if d % 3 else np.concatenate((sets[d - 1][:20], rng.integers(-(2**63), 2**63, 5)))
        sets[d] = np.unique(np.concatenate((h, [7 << 40])))  # and one that all have
    sets[99] = np.empty(0, np.int64)
    owners = Counter(x for h in sets.values() for x in h.tolist())
    rows = [(d, h.tolist()) for d, h in sets.items()] + [(d, sets[d].tolist()) for d in (-40, 5, 5, 39)]  # copies, in chunks of their own
    docs = spark.createDataFrame(rows, "d long, some array<long>").repartition(3)
    for most in (1 << 19, 200, 8):
        got = {r.d: r.shared for r in near_sets.shared_hashes(docs, sum(owners.values()), most).collect()}
        assert got == {d: sum(owners[x] > 1 for x in h.tolist()) for d, h in sets.items() if len(h)}
    assert near_sets.shared_hashes(docs.limit(0), 0).count() == 0


def _rows_from_python(df, name):
    """Rows that the Python functions of all nodes of that name gave, once ``df`` has run."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == name:
            found += node.metrics().apply("pythonNumRowsReceived").value()
        todo += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_rows_of_shared_hashes_grow_with_the_sets_and_not_with_the_buckets(spark):
    rng = np.random.default_rng(27)
    pool = rng.integers(-(2**63), 2**63, (251, 40))  # each set in two halves, which the sets before and after it hold
    rows = [(d, sorted({*pool[d // 2, :20].tolist(), *pool[(d + 1) // 2, 20:].tolist()})) for d in range(500)]
    for n in (100, 500):
        docs = spark.createDataFrame(rows[:n], "d long, some array<long>").coalesce(1)
        got = near_sets.shared_hashes(docs, 40 * n, 2000)
        assert {r.d for r in got.collect()} == set(range(n))
        assert n <= _rows_from_python(got, "FlatMapGroupsInArrow") <= 2 * n


def test_shared_hashes_of_more_sets_than_a_chunk_has_places(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "PLACES", 7)
    h = np.random.default_rng(28).integers(-(2**63), 2**63, 100).tolist()
    rows = [(d, [h[d // 2], h[50 + d]]) for d in range(50)] + [(3, [h[1], h[53]])] * 9
    got = near_sets.shared_hashes(spark.createDataFrame(rows, "d long, some array<long>"), 100).collect()
    assert sorted((r.d, r.shared) for r in got) == [(d, 1) for d in range(50)]


def test_the_id_filter_keeps_all_wanted_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).select("id", F.col("id").cast("string").cast("binary").alias("text"))
    wanted = spark.range(-20_000, 20_000, 10).select(F.col("id").alias("rep"))
    got = {r.id: bytes(r.text) for r in near_sets.maybe_among(rows, wanted, "rep").collect()}
    assert set(range(-20_000, 20_000, 10)) <= set(got) and len(got) < 4_000 + 0.1 * 36_000
    assert all(v == str(k).encode() for k, v in got.items())
    assert near_sets.maybe_among(rows, wanted.limit(0), "rep").count() == 0


def test_near_groups_shuffle_and_keep_only_what_they_need(spark, monkeypatch):
    rng, made = random.Random(26), []
    a = prose(rng, 80)
    texts = [a, a + " zz", *(prose(rng, 80) for _ in range(60))]

    class Kept(Workspace):
        def __init__(self, *x):
            super().__init__(*x)
            made.append(self.root)

    monkeypatch.setattr(near_sets, "Workspace", Kept)
    assert {r.id: r.component_id for r in near_sets.near_groups(table(spark, texts)).collect()} == {i: max(0, i - (i == 1)) for i in range(62)}
    left = {name for root in made if os.path.isdir(root) for name in os.listdir(root)}
    assert {"named", "classes", "merged"} <= left and not left & {"sets", "wide", "members", "tiles", "rooted"}
