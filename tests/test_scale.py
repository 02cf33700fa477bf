"""Costs that must not grow faster than their input, and kernels that give the exact result by a shorter way."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vector import normalize
from millrace.operators import vectors as module
from millrace.operators.matrix import nearest
from millrace.operators.vectors import _Best, knn_exact, search_clusters
from millrace.plans.index import build_index
from millrace.streaming.incremental import append


def vectors_of(spark, x, name="doc_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def test_normalize_takes_time_by_the_length_of_a_vector(spark):
    def seconds(d):
        rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: (i + F.col("id")).cast("double")).alias("v")).localCheckpoint()
        best = []
        for _ in range(2):
            began = time.time()
            total = rows.select(F.aggregate(normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.sum("n")).first()[0]
            best.append(time.time() - began)
        assert total == pytest.approx(400)
        return min(best)

    small, large = seconds(250), seconds(4000)
    assert large < 48 * max(small, 0.1)  # 16 times the numbers; by the square it would be 256 times


def test_normalize_nulls_and_zeros(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [])], "i int, v array<double>")
    assert [r[0] for r in rows.orderBy("i").select(normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e20])
def test_nearest_is_exact(scale):
    r = np.random.default_rng(5)
    x = np.abs(r.normal(1, 0.01, size=(3000, 26)))  # almost alike: single precision alone can't tell
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[:400].copy()
    c[7], c[300] = c[3], c[3]  # of equal ones the first counts
    c[11] = c[12] + 1e-14
    value, at = nearest(x * scale, c * scale, 12)
    want = np.round((x * scale) @ (c * scale).T, 12)
    if scale == 1:
        assert np.array_equal(at, np.argmax(want, axis=1)) and not np.isin([7, 300], at).any()
    assert np.allclose(value, want.max(axis=1), rtol=1e-12, atol=1e-11)
    assert len(nearest(x[:0], c, 12)[0]) == 0


def found_by(rows):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rows.collect())


def test_many_queries_do_not_pass_the_driver(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8))
    x[50:60] = x[3]  # equal scores go by the least id
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors, queries = vectors_of(spark, x), vectors_of(spark, x[:300], "query_id")
    cents = x[::80]
    clusters = vectors.join(spark.createDataFrame([(i, int(np.argmax(np.round(v @ cents.T, 12)))) for i, v in enumerate(x)], "doc_id long, cluster_id int"), "doc_id")
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cents)], "cluster_id int, centroid array<double>")
    few = found_by(knn_exact(vectors, queries, 4)), found_by(search_clusters(clusters, centroids, queries, 4, 2))
    score = np.round(x[:300] @ x.T, 9)
    want = np.argsort(-score, axis=1, kind="stable")[:, :4]
    assert few[0] == sorted((i, n + 1, int(d), score[i, d]) for i in range(300) for n, d in enumerate(want[i]))
    seen, plain = [], DataFrame.toArrow

    def counted(self):
        out = plain(self)
        seen.append(out.num_rows)
        return out

    monkeypatch.setattr(DataFrame, "toArrow", counted)
    monkeypatch.setattr(module, "QUERY_BYTES", 2000)
    many = knn_exact(vectors, queries, 4), search_clusters(clusters, centroids, queries, 4, 2)
    assert max(seen, default=0) <= len(cents)  # centroids only; before, all queries and the numbers of their clusters
    assert (found_by(many[0]), found_by(many[1])) == few


def test_best_is_exact_and_quicker_than_all_products():
    r = np.random.default_rng(7)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:180] = x[5]  # more equal ones than are kept
    q, docs = x[:1500], r.permutation(len(x))
    began = time.time()
    found = _Best(len(q), 10)
    for s in range(0, len(x), 2500):
        found.add(np.arange(len(q)), q, x[s : s + 2500], docs[s : s + 2500])
    short = time.time() - began
    began = time.time()
    key = np.round(q @ x.T, 9)
    order = np.lexsort((np.broadcast_to(docs, key.shape), -key), axis=1)[:, :10]
    assert short < time.time() - began
    assert np.array_equal(found.doc, docs[order]) and np.array_equal(found.key, np.take_along_axis(key, order, 1))
    assert np.allclose(found.product, found.key, atol=1e-9)


def test_best_beyond_single_precision():
    q = np.array([[1e35, 0.0], [np.nan, 1.0]])
    found = _Best(2, 2)
    found.add(np.arange(2), q, np.array([[1.0, 0.0], [2.0, 1.0], [0.0, 0.0]]), np.arange(3))
    assert found.doc[0].tolist() == [1, 0] and found.batch(np.arange(2)).column(0).to_pylist() == [0, 0]


@pytest.mark.parametrize("n", [200, 1600])
def test_a_task_holds_a_bounded_part_of_the_queries(spark, monkeypatch, n):
    monkeypatch.setattr(module, "QUERY_BYTES", 0)
    monkeypatch.setattr(module, "HELD_BYTES", 32 * 8 * 4)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 16)
    try:
        x = np.random.default_rng(8).normal(size=(n, 4))

        def held(ids, q):
            at = np.full(len(ids), len(ids))
            return pa.record_batch([pa.array(ids), pa.array(at), pa.array(q[:, 0]), pa.array(q[:, 0])], names=["query_id", "doc_id", "key", "score"])

        rows = module._dealt(vectors_of(spark, x, "query_id"), 8 * x.size, held).collect()
        assert sorted(y.query_id for y in rows) == list(range(n))
        assert max(y.doc_id for y in rows) <= 32 + 16  # of so many queries at a time; before, of all up to 64 MB in every task
    finally:
        spark.conf.set(size, before)


def test_products_of_clusters_are_formed_in_blocks():
    # as a task of a probed search does: many queries of one large cluster
    r = np.random.default_rng(9)
    q, x = r.normal(size=(3000, 16)), r.normal(size=(4000, 16))
    found = _Best(len(q), 5)
    tracemalloc.start()
    found.add(np.arange(len(q)), q, x, np.arange(len(x)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20  # all products take 96 MB, a block of PRODUCT with its copies as much
    assert np.array_equal(found.doc[:, 0], np.argmax(q @ x.T, axis=1))


def test_an_append_embeds_each_chunk_once(spark, tmp_path):
    embedded = spark.sparkContext.accumulator(0)

    def embed(rows):
        def run(batches):
            for batch in batches:
                embedded.add(batch.num_rows)
                v = [[1.0, float(len(t))] for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(v, pa.list_(pa.float64()))], names=["id", "vector"])

        return rows.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, vector array<double>")

    def corpus(first):
        return spark.createDataFrame([(f"f{i}", "word " * (10 + i)) for i in range(first, first + 40)], "uri string, content string").repartition(3)

    path = f"file://{tmp_path}/index"
    build_index(corpus(0), path, embed, 3, 1)
    embedded.value = 0
    assert append(path, corpus(100), embed) == 40
    assert embedded.value == 40  # before, 80
