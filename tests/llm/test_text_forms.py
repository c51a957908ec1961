"""Periodic runs, fill-in-middle and token planes against brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import infilling, periodic, token_planes
from tidewatch.llm._shared import Workspace
from tidewatch.llm.queries import INFILLING_SQL, repeated_stretches, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "one", "a a a a a a", "b " * 9, " a\x0bb a b a b a b\x85a ", "x" * 40_000, "é ß é ß é ß é ß", "1<P>2", "<S>", "<", "P>", "<P", ">", "tail <", "  ab-c 𝕏"]


def runs_by_hand(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(6, 4 * q) and all(any(s[k] != s[k + p] for k in range(len(s) - p)) for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    w = []
    for _ in range(rng.randrange(0, 7)):
        letters = rng.choice([1, 2, 3, 50])
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 120)] if rng.random() < 0.6 else unit
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 5))]
        ids, of = np.array([x for w in texts for x in w], np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        want, at = [], 0
        for w in texts:
            want += [(at + a, n, q) for a, n, q in runs_by_hand(w)]
            at += len(w)
        assert [tuple(r) for r in periodic.runs_of(ids, of).tolist()] == want


def test_splitting_keeps_every_run_and_spares_prose():
    rng = np.random.default_rng(1)
    prose, stretch = rng.integers(0, 400, 3000), np.tile(rng.integers(0, 400, 37), 5)
    ids = np.concatenate((prose, stretch, prose))
    kept = periodic.split_segments(ids, np.zeros(len(ids), np.int64))
    assert [len(s) for s in kept if 3000 in s] and sum(map(len, kept)) < 400
    # Words that go one after another: splitting stops, and the scan still finds the run.
    peel = np.concatenate((np.repeat(np.arange(500), 3), np.full(7, 999)))
    assert periodic.runs_of(peel, np.zeros(len(peel), np.int64)).tolist() == [[1500, 7, 1]]
    assert periodic.runs_of(np.zeros(200_000, np.int64), np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def check_runs(rows, words):
    for r in rows:
        w = words(r)
        want = runs_by_hand(w)
        assert r.n_words == len(w) and [(x.start, x.length, x.period) for x in r.runs] == want
        drop = {i for a, n, q in want for i in range(a + q, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_of_odd_texts_and_repeated_stretches(spark):
    texts = [*ODD, *(" \n".join(f"w{x}" for x in periodic_text(random.Random(k))) for k in range(120))]
    docs = spark.createDataFrame([(None if i == 3 else i % 90, t, "clash", []) for i, t in enumerate(texts)], "doc_id short, text string, runs string, key array<int>")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    plain = periodic.find_runs(docs.withColumn("doc_id", F.monotonically_increasing_id()), slice_bytes=5_000)
    at = {r.doc_id: r.text for r in docs.withColumn("doc_id", F.monotonically_increasing_id()).collect()}
    check_runs(plain.collect(), lambda r: split(at[r.doc_id]))

    def moved(r, text):
        w, h = split(text), zlib.crc32(b"" if r is None else str(r).encode())
        g, n = h // 10, len(w)
        if h % 10 or not n:
            return w
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]

    rows = periodic.find_runs(docs, rewrite=repeated_stretches).select("doc_id", "n_words", "runs", "collapsed", periodic.longest().alias("best"), periodic.as_lines().alias("lines")).collect()
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        assert r.doc_id == (None if i == 3 else i % 90)
        check_runs([r], lambda r, t=t: moved(r.doc_id, t))
    for r in rows:
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.lines == "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        assert r.best is None if not runs else (r.best.start, r.best.length, r.best.period) == min(runs, key=lambda x: (-x[1], x[0], x[2]))
    assert periodic.find_runs(docs.limit(0)).collect() == []


def infilled(doc_id, text, salt="1"):
    d = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infilling_equals_brute_force_and_restores(spark):
    rng = random.Random(2)
    texts = [*ODD, *("".join(rng.choice("ab é<>PSM-\n𝕏z") for _ in range(rng.randrange(0, 60))) for _ in range(300))]
    docs = spark.createDataFrame([(None if i == 5 else i % 250, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, form string")
    for size in (64, 4 << 20):
        rows = infilling.restore(infilling.fill_in_middle(docs, slice_bytes=size), slice_bytes=size).collect()
        want = [(None if i == 5 else i % 250, *infilled(None if i == 5 else i % 250, t or ""), t or "") for i, t in enumerate(texts)]
        assert [tuple(r) for r in rows] == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs.limit(0)).collect() == []


def test_displacements_in_small_blocks():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 9, 60)
    starts, order = np.cumsum(sizes) - sizes, rng.permutation(60)
    targets = np.empty(60, np.int64)
    targets[order] = np.cumsum(sizes[order]) - sizes[order]
    for room in (1, 7, 10_000):
        got = np.concatenate([to for _, to in infilling.shifts(starts, sizes, targets, room)])
        assert got.tolist() == [int(t) + k for t, n in zip(targets, sizes, strict=True) for k in range(n)]


@pytest.mark.parametrize("output, form", [("<P>a<S>b", "psm"), ("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("<P><P><S><M>", "psm"), ("a", "other")])
def test_outputs_that_do_not_fit_their_form_are_errors(spark, output, form):
    with pytest.raises(Exception, match="mark|no such form"):
        infilling.restore(spark.createDataFrame([(output, form)], "output string, form string")).collect()


def test_infilling_equals_sql(spark):
    import duckdb

    from tidewatch.llm.queries import op12_infilling

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, op12_infilling(spark, SF).select(*cols).collect())) == sorted(con.execute(INFILLING_SQL).fetchall())


@pytest.mark.parametrize("form", ["byte", "bit"])
def test_planes_of_ids(form):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        planes = token_planes.to_planes(ids, form)
        assert len(planes) == token_planes.PLANES[form] and np.array_equal(token_planes.from_planes(planes, n, form), ids)


@pytest.mark.parametrize("form, chunk", [("byte", 1 << 16), ("bit", 50), ("byte", 7)])
def test_token_files_hold_every_id_in_order(spark, tmp_path, form, chunk):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "word " * 500, "<|endoftext|> a"]
    rows = [(None if i == 4 else f"k{i % 15:03d}", t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, start int").repartition(5)
    path = Workspace(spark, "planes-test").root
    token_planes.write(docs, path, tokenizer_path(), chunk=chunk, form=form)
    got = token_planes.read(spark, path, "string", ids=True).collect()
    got.sort(key=lambda r: r.start)
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    assert [r.doc_id or "" for r in got] == sorted(r.doc_id or "" for r in got)
    at = 0
    for r in got:
        assert r.start == at and r.ids in ids[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    # One file of a shard, and stretches of it by its index.
    shard = token_planes.read_chunks(spark, path, "string").where("shard = 0").orderBy("chunk").collect()
    token_planes.to_file(shard, str(tmp_path / "shard"))
    file = token_planes.TokenFile(str(tmp_path / "shard"))
    every = [x for r in got for x in r.ids][: int(file.starts[-1])]
    assert file.ids(0, len(every)).tolist() == every and file.docs[0][1] == 0
    assert file.ids(len(every) // 3, 5).tolist() == every[len(every) // 3 :][:5] and file.ids(3, 0).tolist() == []
    with pytest.raises(IndexError):
        file.ids(len(every), 1)


def test_changed_and_missing_chunks_are_errors(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(30)], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast("decimal(10,0)"))
    path = Workspace(spark, "planes-test").root
    token_planes.write(docs, path, tokenizer_path(), chunk=64)
    good = token_planes.read(spark, path, "decimal(10,0)")
    assert good.count() == 30
    rows = token_planes.read_chunks(spark, path, "decimal(10,0)")
    index = spark.read.parquet(f"{path}/index")
    assert rows.count() == index.count() and index.agg(F.sum("n_ids")).first()[0] == good.agg(F.sum("n_tokens")).first()[0]
    for name, bad in (("other ids", rows.withColumn("crc", F.when(F.col("chunk") == 1, F.col("crc") + 1).otherwise(F.col("crc")))), ("missing", rows.where("chunk <> 1"))):
        there = Workspace(spark, "planes-test").root
        bad.write.parquet(f"{there}/chunks")
        index.write.parquet(f"{there}/index")
        with pytest.raises(Exception, match=name):
            token_planes.read(spark, there, "decimal(10,0)").collect()
    assert token_planes.round_trip(docs.limit(0), tokenizer_path()).collect() == []


def runs_by_lag(words):
    """All runs by comparing the whole text with itself at every lag."""
    w, out = np.unique(words, return_inverse=True)[1], []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], (w[:-q] == w[q:]).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for a, z in edges[np.diff(edges, axis=1)[:, 0] >= max(6, 4 * q) - q].tolist():
            s = w[a : z + q]
            if all((s[:-p] != s[p:]).any() for p in range(1, q) if q % p == 0):
                out.append((a, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_query_equals_brute_force(spark):
    from tidewatch.llm.queries import op11_periodic

    got = {r.doc_id: r for r in op11_periodic(spark, SF).collect()}
    docs, repeated = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(got) == len(docs)
    for d in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = runs_by_lag(w)
        repeated += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        drop = {i for a, n, q in runs for i in range(a + q, a + n)}
        r, sha = got[d.doc_id], lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)) and r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in drop))
    assert repeated > 5


def test_token_query_equals_brute_force(spark):
    from tokenizers import Tokenizer

    from tidewatch.llm.queries import op13_token_planes

    tok, at = Tokenizer.from_file(tokenizer_path()), 0
    got = {r.doc_id: r for r in op13_token_planes(spark, SF).collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
