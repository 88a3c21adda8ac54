"""The registered queries of the operators: ``opN_<name>(spark, sf_dir)`` and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontam, exact_dedup, langid, licenses, lm, near_dedup, periodic, secrets, sharding, toxicity, warc, whitening

QUERIES = {}
ORACLE = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query()
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes (DuckDB has no CRC-32, so no SQL)."""
    return sharding.shard(_documents(spark, sf_dir), shards=16, law="bytes")


_WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@_query(f"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
     k AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, k, w[s:s + k - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM k)),
     ks AS (SELECT DISTINCT k FROM win),
     dw AS (SELECT doc_id, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS p, w FROM w, ks WHERE len(w) >= ks.k),
     hit AS (SELECT dw.doc_id, dw.p, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.w[dw.p:dw.p + dw.k - 1] = win.g),
     n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
     i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
           FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256,
       coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in the whole documents table."""
    return decontam.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query()
def decontam_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the whole documents table where four fifths of a benchmark item's words or more stand in order and distance."""
    return decontam.near_matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


@_query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
     g AS (SELECT n, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.n) AS text_sha256
FROM d JOIN g USING (n)""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole documents table: the row that stays for each."""
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query()
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the whole documents table: 3-word shingles, similarity 0.85 or more."""
    found = near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every whole text."""
    return licenses.license_scan(_documents(spark, sf_dir)).drop("spans")


@_query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secrets.secret_scan(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _fold(mod: int):
    """crc32(doc_id as text) mod ``mod``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


@_query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from the documents of four folds."""
    docs = _documents(spark, sf_dir)
    found = langid.train_and_identify(docs, docs.where(_fold(5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


@_query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from the labels of two folds."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(_fold(3) != 1))
    return toxicity.score(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


@_query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a model of nine folds."""
    docs = _documents(spark, sf_dir)
    found = lm.score(docs, lm.train(docs.where(_fold(10) != 0)))
    return found.select("doc_id", (_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@_query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
     b AS (SELECT h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
                      (strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
                      + strpos('0123456789abcdef', substr(x, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS digest
           FROM (SELECT DISTINCT h, x FROM d))
SELECT d.page_id, strlen(d.h) AS payload_bytes, b.digest AS payload_digest, CASE WHEN d.page_id = d.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> d.first THEN d.first END AS refers_to, true AS valid
FROM d JOIN b USING (h)""")
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC archives into WARC archives and back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)


@_query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along the four leading components (eigenvectors are no SQL)."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)


def _op12_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order that the contract gives every tenth document: repeated from word a on with period p."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


@_query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text (a maximal run is no SQL on texts of this length)."""
    return periodic.collapse_runs(_documents(spark, sf_dir), least_length=6, least_exponent=4, order=_op12_order)
