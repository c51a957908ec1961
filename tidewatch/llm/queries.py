"""The queries opN_<name> and, where SQL can say them, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, decontaminate, infilling, licences, outliers, packing, periodic, quality, simhash, token_planes, toxicity, urls, warc
from ._shared import Workspace, held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 5)))
    scored = toxicity.score(docs, model, keep={"held_out": held_out(F.col("doc_id"), 5)})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return brown.score(docs, ~held_out(F.col("doc_id"), 10), folds=10)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"), licences.known_table(spark), gate=licences.gate_words(licences.KNOWN_TEXTS))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    graded = quality.grade(docs, model)
    return graded.select("doc_id", "expected_grade", F.col("tail")[0].alias("p_good"), (F.col("tail")[0] >= 0.5).alias("kept"))


# The rules that the query applies, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_table(spark))
    return urls.judge(_table(spark, sf_dir, "pages"), RULES, model)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    archive = work.save(warc.write_chunks(_table(spark, sf_dir, "pages")), "archive")
    found = warc.read(archive)
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, seed=42, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repeated_stretches(keys: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first repeated word, period, 0 for none) of texts of ``n`` words, by CRC-32 of their ids."""
    h = np.array([zlib.crc32(k.encode()) for k in keys], np.int64)
    g = h // 10
    a = g % np.maximum(n, 1)
    return a, np.where((h % 10 == 0) & (n > 0), 1 + (n - a) // (3 + g % 8), 0)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_table(spark, sf_dir, "documents"), times=4, least=6, rewrite=repeated_stretches)
    best = periodic.longest()
    most = [best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *most, F.sha2(periodic.as_lines(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.restore(infilling.fill_in_middle(_table(spark, sf_dir, "documents"), rate=90, turned=20, salt="1"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_brown": op2_brown, "op3_licenses": op3_licenses, "op4_quality": op4_quality, "op5_urls": op5_urls, "op6_warc": op6_warc, "op7_packing": op7_packing, "op8_outliers": op8_outliers, "op9_simhash": op9_simhash, "op10_decontaminate": op10_decontaminate, "op11_periodic": op11_periodic, "op12_infilling": op12_infilling, "op13_token_planes": op13_token_planes}


WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest as d, max(page_id) as first from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
case when first <> page_id then first end as refers_to
from p left join g on p.payload_digest = g.d and p.payload_bytes >= 1000"""


INFILLING_SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from t),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as one, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as two,
case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:one], '') as prefix, array_to_string(units[one + 1:two], '') as middle, array_to_string(units[two + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
sha256(text) as restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licences.scan_sql(), "op6_warc": WARC_SQL, "op12_infilling": INFILLING_SQL}
