"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import near_duplicate_vectors
from .fingerprints import fingerprint_documents
from .licences import licences_sql, scan_licences
from .mixing import mix_sources, mixing_sql
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .repeats import GRAM, MIN_WORDS, repeated_passages
from .secret_scan import scan_secrets
from .simhash import near_duplicates
from .toxicity import fit, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


REPEATS_SQL = f"""
    WITH w AS (
        SELECT DISTINCT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+') AS words, text
        FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
    r AS (SELECT doc_id, text, unnest(range(len(words) - {MIN_WORDS} + 1)) AS i, words FROM w WHERE len(words) >= {MIN_WORDS}),
    h AS (SELECT doc_id, text, i, hash(array_to_string(words[i + 1 : i + {MIN_WORDS}], ' ')) AS h FROM r),
    s AS (SELECT h, count(DISTINCT doc_id) AS n FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
    f AS (SELECT doc_id, text, i, n, i <= coalesce(max(i) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {MIN_WORDS}, -1) AS joined
          FROM h JOIN s USING (h)),
    g AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, text ORDER BY i) AS k FROM f)
    SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + {MIN_WORDS} AS INTEGER) AS "end",
           CAST(max(i) + {MIN_WORDS} - min(i) AS INTEGER) AS words, CAST(max(n) AS INTEGER) AS documents
    FROM g GROUP BY doc_id, text, k
"""

#: Groups by brute force: all pairs, then the least id that is reached.
EMBEDDINGS_SQL = """
    WITH RECURSIVE e AS (SELECT vec_id, embedding FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON list_cosine_similarity(a.embedding, b.embedding) >= 0.9),
    c(v, r) AS (SELECT a, b FROM p UNION SELECT c.v, p.b FROM c JOIN p ON c.r = p.a)
    SELECT v AS vec_id, min(r) AS group_id FROM c GROUP BY v
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_fingerprints, op3_packing, op4_licences, op5_secrets, op6_toxicity, op7_simhash, op8_repeats, op9_quality, op10_embeddings)
}

ORACLES: dict[str, str] = {"op1_mixing": mixing_sql(), "op4_licences": licences_sql(), "op8_repeats": REPEATS_SQL, "op10_embeddings": EMBEDDINGS_SQL}
