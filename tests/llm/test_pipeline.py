"""The stages of the corpus pipeline against brute force, and every operator on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import brown, decontaminate, infilling, licences, outliers, packing, periodic, quality, simhash, token_planes, toxicity, urls, warc
from tidewatch.llm.hashed_terms import WORDS as WORD_TERMS
from tidewatch.llm.hashed_terms import Lookup
from tidewatch.llm.queries import RULES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
LONG = "word " * 40_000
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9004, "one"), (9005, LONG), (9006, "é ß   ж"), (None, "no id at all"), (None, None)]
#: Names that operators use for columns of their own.
CLASH = ["id", "d", "n", "h", "rep", "component", "score", "grade", "words", "tail", "record_id", "sequence_id", "fp", "item_id", "part", "salt"]


def odd(docs):
    """``docs`` and odd rows, with columns of clashing names."""
    more = docs.sparkSession.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    return docs.unionByName(more).withColumns({c: F.lit(1) for c in CLASH})


def nearest(item, text):
    """The least edit distance of ``item`` to any stretch of ``text``, both arrays of word numbers."""
    row, steps = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (text != w))))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def near_components(texts):
    """The place of the first text of each text's group of near copies, by comparing all pairs."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5, 42).tolist()) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return up


def test_stages_decide_as_brute_force_does(spark, tmp_path):
    docs = odd(spark.read.parquet(f"{SMALL}/documents.parquet"))
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    odd_ids = {i for i, _ in ODD}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in docs.collect()}
        assert after <= {r.doc_id for r in before}
        if name in ("toxicity", "quality"):
            if name == "toxicity":
                model = toxicity.fit(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))
                look = Lookup(WORD_TERMS, model.chosen)
                good = lambda t: model.score(look(t)[0]) < 0.5
            else:
                model = quality.fit(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))
                look = Lookup(quality.STYLE, model.chosen)
                good = lambda t: model.tails(np.array([model.latent(*look(t))]))[0, 0] >= 0.5
            kept = docs.collect()
            assert len(kept) == sum(bool(good((r.text or "").encode())) for r in before) and all(good((r.text or "").encode()) for r in kept)
        elif name == "near_copies":
            rows = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
            first = near_components([r.text for r in rows])
            assert after - {None} == {rows[i].doc_id for i in first}
            assert sum(r.doc_id is None for r in docs.collect()) == sum(r.doc_id is None for r in before)
        else:
            number, want = {}, set()
            code = [np.array([number.setdefault(w, len(number)) for w in item]) for item in items]
            for r in before:
                text = np.array([number.get(w, -1) for w in decontaminate.words_of((r.text or "").encode())], int)
                if all(nearest(c, text) > int(0.15 * len(c)) for c in code):
                    want.add(r.doc_id)
            assert want <= after and len(after - want) <= 0.02 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    whole = pieces.groupby("doc_id", dropna=False).agg(n=("length", "sum"), tokens=("doc_tokens", "first"))
    assert set(pieces.doc_id.dropna()) == {r.doc_id for r in docs.collect()} - {None}
    unique = whole[~whole.index.isna() & ~whole.index.isin(odd_ids)]
    assert len(unique) and (unique.n == unique.tokens).all()
    for _, held in pieces.sort_values("offset").groupby("sequence_id"):
        assert held.length.sum() <= 2048 and (held.offset.to_numpy() == np.concatenate(([0], held.length.cumsum()[:-1]))).all()


def test_learnt_stages_tell_the_labels_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").collect()
    for stage, is_bad in ((corpus_pipeline.drop_toxic, lambda r: r.toxic == 1), (corpus_pipeline.drop_poor, lambda r: r.quality == 0)):
        kept = {r.doc_id for r in stage(spark, docs, folder).select("doc_id").collect()}
        bad, good = [r.doc_id for r in labels if is_bad(r)], [r.doc_id for r in labels if not is_bad(r)]
        caught, stays = sum(i not in kept for i in bad) / len(bad), sum(i in kept for i in good) / len(good)
        assert caught >= 0.75 and stays >= 0.95, (stage.__name__, caught, stays)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert stage(spark, docs, SMALL).count() == 0


#: Each operator over (docs or pages, labels, items); rows that it returns for each row given, None: any number.
OPERATORS = {
    "toxicity": (lambda s, d, labels, items: toxicity.score(d, toxicity.fit(d, labels)), 1),
    "brown": (lambda s, d, labels, items: brown.score(d, F.col("doc_id") % 10 != 0), 1),
    "licences": (lambda s, d, labels, items: licences.scan(d, licences.known_table(s)), 1),
    "quality": (lambda s, d, labels, items: quality.grade(d, quality.fit(d, labels)), 1),
    "urls": (lambda s, d, labels, items: urls.judge(d.withColumn("url", F.concat(F.lit("http://A.com/"), "text")), RULES, urls.fit(urls.labelled_table(s)), id_col="doc_id"), 1),
    "warc": (lambda s, d, labels, items: warc.read(warc.write_chunks(d, id_col="doc_id", url_col="lang", body_col="text")), 1),
    "packing": (lambda s, d, labels, items: packing.pack(d, tokenizer_path()).select("doc_id", "start", "doc_tokens"), None),
    "outliers": (lambda s, d, labels, items: outliers.verdicts(d), 1),
    "simhash": (lambda s, d, labels, items: simhash.near_duplicates(d), None),
    "decontaminate": (lambda s, d, labels, items: decontaminate.find(d, items), None),
    "periodic": (lambda s, d, labels, items: periodic.find_runs(d), 1),
    "infilling": (lambda s, d, labels, items: infilling.restore(infilling.fill_in_middle(d)), 1),
    "token_planes": (lambda s, d, labels, items: token_planes.round_trip(d, tokenizer_path()), 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_odd_and_empty_tables(spark, name):
    run, each = OPERATORS[name]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    table = odd(docs.where("doc_id < 60"))
    rows = run(spark, table, labels, items).collect()
    if each:  # archives have no record of a row without an id
        assert len(rows) == table.where("doc_id is not null" if name == "warc" else "true").count()
    none = table.limit(0)
    assert run(spark, none, labels, items).count() == 0


def test_toxicity_ranks_labels_that_it_has_not_seen(spark):
    from tidewatch.llm.queries import op1_toxicity

    folder = "/root/testdata/sf0.1"
    scored = op1_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    assert len(y) > 400 and 0.02 < y.mean() < 0.5
    order = np.argsort(-s, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ahead = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    found = {"average_precision": float((precision * y[order]).sum() / y.sum()), "roc": float(ahead), "caught": float((s[y == 1] >= 0.5).mean()), "clean": float((s[y == 0] < 0.5).mean())}
    assert found["average_precision"] > 3 * y.mean() and found["roc"] > 0.85 and found["clean"] > 0.97, found
    print(found)


def test_class_model_beats_the_base_on_held_out_texts_of_known_words(spark):
    from tidewatch.llm.queries import op2_brown

    rows = op2_brown(spark, "/root/testdata/sf0.01").where("held_out and n_known = n_tokens and n_tokens > 1").collect()
    tokens = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(r[c] for r in rows) / tokens) for c in ("score", "base_score"))
    assert len(rows) >= 5 and model < base, (len(rows), model, base)
    print(len(rows), model, base)
