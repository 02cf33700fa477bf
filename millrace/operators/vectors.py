"""Exact and probed nearest neighbours, for one query or many at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import shared_folder
from ..schema import SIGNALS
from ..sources.files import where
from .matrix import SCREEN, Slices, products, rows_of, slack, unit


#: Bytes of queries up to which they are sent to the tasks that hold the vectors. More are dealt out to tasks, which read the vectors from files.
QUERY_BYTES = 4 << 20
#: Bytes of queries that such a task holds at a time.
HELD_BYTES = 8 << 20
#: Places at which products are ranked, so that the order of summation can't decide between equal ones.
PLACES = 9
FOUND = "query_id long, doc_id long, key double, score double"


class Stored:
    """Vectors as files in the shared folder, which tasks read from end to end in batches; none of them goes by way of the driver."""

    def __init__(self, rows: DataFrame, label: str = "vectors"):
        path = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(path)
        self.place = where(path)
        cut = len(self.place.path)
        self.paths = sorted(x.path for x in self.place.files() if x.path.endswith(".parquet") and not any(part[:1] in "._" for part in x.path[cut:].strip("/").split("/")))

    def batches(self) -> Iterator[pa.RecordBatch]:
        system, _ = self.place.open()
        for path in self.paths:
            with system.open_input_file(path) as file:
                yield from pq.ParquetFile(file).iter_batches(8192, use_threads=False)


def stored_clusters(clusters: DataFrame) -> Stored:
    """``clusters(doc_id, vector, cluster_id)`` as files in which a cluster's vectors lie together."""
    rows = clusters.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>"), F.col("cluster_id").cast("int"))
    return Stored(rows.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id"), "clusters")


def _rows(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))


def _bytes(queries: DataFrame) -> int:
    return 8 * queries.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()[0]


def _few(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of QUERY_BYTES at most."""
    rows = _rows(queries).toArrow()
    return rows.column("query_id").to_numpy(), unit(rows_of(rows.column("vector")))


def _dealt(queries: DataFrame, size: int, search: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``search`` of ids and unit vectors, of HELD_BYTES or a batch more at a time, in tasks that have their own queries each."""
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-size // HELD_BYTES))
    most = HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            return search(rows.column(0).to_numpy(), unit(rows_of(rows.column(1))))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= most:
                yield found()
        if held:
            yield found()

    return _rows(queries).repartition(tasks, "query_id").mapInArrow(run, FOUND)


def knn_exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by brute force over ``vectors(doc_id, vector)`` and a stated set of ``queries(query_id,
    vector)``; equal scores go by doc_id.

    A few queries are sent to the tasks that hold the vectors, each of which keeps its own best k of every query. Many are dealt out
    to tasks, each of which reads all vectors from files and keeps the best k of its own queries; what it holds is bounded.
    """
    k, size = max(k, 1), _bytes(queries)
    if size <= QUERY_BYTES:
        ids, q = _few(queries)
        return best(_scored(vectors, q, ids, k) if len(ids) else vectors.sparkSession.createDataFrame([], FOUND), k)
    stored = Stored(vectors.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")))

    def search(ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        found, rows = _Best(len(q), k), np.arange(len(q))
        for batch in stored.batches():
            if batch.num_rows:
                found.add(rows, q, unit(rows_of(batch.column(1))), batch.column(0).to_numpy())
        return found.batch(ids)

    return best(_dealt(queries, size, search), k)


knn_batch = knn_exact


def best(scored: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "doc_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).drop("key")


class _Best:
    """The best k of each query over the batches of a task, by the rounded products; these are kept as they are too, for
    callers that round them otherwise."""

    def __init__(self, n: int, k: int):
        self.k, self.key, self.doc, self.product = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def add(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, docs: np.ndarray) -> None:
        """Takes in the products of ``q``, the vectors of the queries ``rows``, with ``x``, those of ``docs``.

        They are formed in single precision; only those within its error of a query's best k are multiplied in double precision.
        """
        margin = 2 * slack(q, x) + 2 * 10.0**-PLACES
        single = np.isfinite(margin)
        wide = min(len(x), 4096)
        step = max(1, SCREEN // max(1, wide))
        kind = np.float32 if single else np.float64
        for j in range(0, len(x), max(1, wide)):
            part = x[j : j + wide]
            y = np.ascontiguousarray(part.T, kind)
            for i in range(0, len(q), step):
                p = q[i : i + step].astype(kind, copy=False) @ y
                if not single:
                    p[np.isnan(p)] = -np.inf
                self._merge(rows[i : i + step], q[i : i + step], part, p, docs[j : j + wide], margin if single else 2 * 10.0**-PLACES, single)

    def _merge(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, p: np.ndarray, docs: np.ndarray, margin: float, single: bool) -> None:
        last, n = self.key[rows, -1], p.shape[1]
        floor = last
        if n > self.k and (last == -np.inf).any():
            floor = np.maximum(last, np.partition(p, n - self.k, axis=1)[:, n - self.k])
        i, j = np.nonzero(p >= (floor - margin).astype(p.dtype)[:, None])
        product = products(q, i, x, j) if single else p[i, j]
        key, doc = np.round(product, PLACES), docs[j]
        own = (key > last[i]) | ((key == last[i]) & (doc < self.doc[rows, -1][i]))
        if not own.any():
            return
        row, at = np.unique(i[own], return_inverse=True)
        to, k = rows[row], self.k
        row = np.concatenate((np.repeat(np.arange(len(to)), k), at))
        key, doc, product = (np.concatenate((old[to].ravel(), new[own])) for old, new in ((self.key, key), (self.doc, doc), (self.product, product)))
        order = np.lexsort((doc, -key, row))
        first = np.concatenate(([0], np.cumsum(k + np.bincount(at))[:-1]))
        take = order[first[:, None] + np.arange(k)]
        self.key[to], self.doc[to], self.product[to] = key[take], doc[take], product[take]

    def batch(self, ids: np.ndarray, exact: bool = False) -> pa.RecordBatch:
        at = np.nonzero(self.key > -np.inf)
        return pa.record_batch([pa.array(ids[at[0]]), pa.array(self.doc[at]), pa.array(self.key[at]), pa.array((self.product if exact else self.key)[at])], names=["query_id", "doc_id", "key", "score"])


def _scored(vectors: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = held.value
        found = _Best(len(q), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, doc = unit(rows_of(batch.column(1))), batch.column(0).to_numpy()
            found.add(np.arange(len(q)), q, x, doc)
        yield found.batch(names)

    return vectors.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, FOUND)


def _probed(q: np.ndarray, centroids: Slices, names: np.ndarray, probe: int) -> _Best:
    found = _Best(len(q), probe)
    for start, c in centroids:
        found.add(np.arange(len(q)), q, c, names[start : start + len(c)])
    return found


def _lists(cluster: np.ndarray, row: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that probe each cluster."""
    by = np.argsort(cluster, kind="stable")
    wanted, first = np.unique(cluster[by], return_index=True)
    return dict(zip(wanted.tolist(), np.split(row[by], first[1:]))) if len(by) else {}


def probe_clusters(queries: DataFrame, centroids: DataFrame, probe: int) -> DataFrame:
    """(query_id, q, cluster_id): the ``probe`` clusters whose centroids are nearest, at least one.

    A product of each batch of queries with the centroids, of which only the best ``probe`` leave the task: no shuffle.
    """
    table = centroids.select(F.col("cluster_id").cast("long"), F.col("centroid").cast("array<double>")).toArrow()  # k rows
    names = table.column(0).to_numpy()
    held = Slices(queries.sparkSession, rows_of(table.column(1)))
    probe = min(max(probe, 1), max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            q = unit(rows_of(batch.column(1)))
            found = _probed(q, held, names, probe)
            at = np.repeat(np.arange(len(q)), probe)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at)), pa.array(q.tolist(), pa.list_(pa.float64())).take(pa.array(at)), pa.array(found.doc.ravel().astype(np.int32))], names=["query_id", "q", "cluster_id"]
            )

    return queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "query_id long, q array<double>, cluster_id int")


#: Clusters that are named one by one to the scan, so that it skips all others.
PRUNED = 2000


def search_clusters(clusters: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probe: int = 8, exact: bool = False, stored: Stored | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) from the probed clusters only; these are pruned at the scan where ``clusters`` is
    partitioned by cluster_id or has statistics of it. An empty cluster gives no rows. Scores are rounded at PLACES, or with
    ``exact`` the products as they are; ranks don't depend on it.

    A few queries and the numbers of their clusters are sent to where the clusters lie, each task keeps the best k of every query, and only those are
    shuffled. Many are dealt out to tasks, which find their clusters and read these from files; callers that search the same clusters again and again
    pass these files, ``stored_clusters(clusters)``.
    """
    k, size = max(k, 1), _bytes(queries)
    spark = clusters.sparkSession
    if size > QUERY_BYTES:
        return best(_dealt(queries, size, _own_clusters(stored or stored_clusters(clusters), centroids, k, probe, exact)), k)
    ids, q = _few(queries)
    if not len(ids):
        return best(spark.createDataFrame([], FOUND), k)
    chosen = probe_clusters(queries, centroids, probe).select("query_id", "cluster_id").toArrow()
    order = np.argsort(ids, kind="stable")
    lists = _lists(chosen.column("cluster_id").to_numpy(), order[np.searchsorted(ids, chosen.column("query_id").to_numpy(), sorter=order)])
    pruned = clusters.where(F.col("cluster_id").isin(list(lists))) if len(lists) <= PRUNED else clusters
    return best(_in_clusters(pruned, q, ids, lists, k, exact), k)


def _add_clusters(found: _Best, q: np.ndarray, lists: dict[int, np.ndarray], batch: pa.RecordBatch) -> None:
    """Takes in a batch (doc_id, vector, cluster_id) for the queries that probe its clusters."""
    cluster = batch.column(2).to_numpy()
    for c in np.unique(cluster).tolist():
        if c in lists:
            own = np.flatnonzero(cluster == c)
            found.add(lists[c], q[lists[c]], rows_of(batch.column(1).take(pa.array(own))), batch.column(0).to_numpy()[own])


def _own_clusters(stored: Stored, centroids: DataFrame, k: int, probe: int, exact: bool) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
    table = centroids.select(F.col("cluster_id").cast("long"), F.col("centroid").cast("array<double>")).toArrow()  # k rows
    names = table.column(0).to_numpy()
    held = Slices(centroids.sparkSession, rows_of(table.column(1)))
    probe = min(max(probe, 1), max(1, len(names)))

    def search(ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        lists = _lists(_probed(q, held, names, probe).doc.ravel(), np.repeat(np.arange(len(q)), probe))
        found = _Best(len(q), k)
        for batch in stored.batches():
            _add_clusters(found, q, lists, batch)
        return found.batch(ids, exact)

    return search


def _in_clusters(clusters: DataFrame, queries: np.ndarray, ids: np.ndarray, lists: dict[int, np.ndarray], k: int, exact: bool) -> DataFrame:
    held = clusters.sparkSession.sparkContext.broadcast((queries, ids, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, rows_by = held.value
        found = _Best(len(q), k)
        for batch in batches:
            _add_clusters(found, q, rows_by, batch)
        yield found.batch(names, exact)

    return clusters.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>"), F.col("cluster_id").cast("int")).mapInArrow(run, FOUND)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): the mean share of each query's true neighbours that were found."""
    hits = truth.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    every = truth.select("query_id").distinct().join(hits, "query_id", "left")
    return every.agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(mrr, ndcg, recall) at k for ``ranked(query_id, uri, rank)`` and one gold uri a query."""
    hit = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "uri"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    every = gold.select("query_id").distinct().join(hit, "query_id", "left")
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return every.agg(zero(1.0 / F.col("r")).alias("mrr"), zero(1.0 / F.log2(F.col("r") + 1)).alias("ndcg"), F.avg(F.col("r").isNotNull().cast("double")).alias("recall"))


def percentiles(millis: list[float]) -> dict[str, float]:
    """Mean and nearest-rank percentiles of latencies; nothing of an empty list."""
    x = sorted(millis)
    return {"mean": sum(x) / len(x), **{f"p{p}": x[int(p / 100 * (len(x) - 1) + 0.5)] for p in (50, 95, 99)}} if x else {}


def hit_spans(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Vector hits as block spans, with ``query_id`` and ``rank``; hits without metadata go."""
    rows = hits.join(docs, "doc_id")
    return rows.select(
        "query_id", "rank", "uri", F.struct(F.col("byte_range")[0].alias("start"), F.col("byte_range")[1].alias("end")).alias("byte_range"), F.array(F.lit(1), F.lit(1)).alias("line_range"),
        F.lit(None).cast("string").alias("symbol"), F.lit("block").alias("kind"), "snippet", "score",
        F.struct(F.col("score").cast("float").alias("cosine"), F.lit(None).cast("float").alias("literal_match"), F.lit(None).cast("int").alias("term_overlap")).cast(SIGNALS).alias("rank_signals"),
        F.lit("vector").alias("source_stage"), F.lit(None).cast("string").alias("content_hash"), F.lit(False).alias("truncated"),
    )
