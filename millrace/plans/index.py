"""Clustered vector indexes: built, written, opened and searched."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import written
from ..errors import IndexError_
from ..functions.text import chunks
from ..functions.vector import normalize
from ..operators import kmeans
from ..operators.vectors import search_clusters
from ..sources.store import Store, join_uri, text_files

Embedder = Callable[[DataFrame], DataFrame]
DIM = 384
SNIPPET = 280


def hashed_embedder(dim: int = DIM) -> Embedder:
    """The embedder that needs no model: terms hashed to signed buckets, at unit length.

    Any function from (id, text) to (id, vector) can take its place, such as an Arrow UDF around a model.
    """

    def embed(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for words in batch.column(1).to_pylist():
                    v = np.zeros(dim)
                    for w in words or ():
                        h = zlib.crc32(w.encode())
                        v[h % dim] += 1.0 if h & 0x80000000 else -1.0
                    out.append(v / max(1e-12, float(np.sqrt((v * v).sum()))))
                yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "vector"])

        words = F.filter(F.split(F.lower("text"), r"[^\p{IsAlphabetic}\p{N}_-]+"), lambda x: F.octet_length(x) >= 3)
        return rows.select(F.col("id").cast("long"), words.alias("w")).mapInArrow(run, "id long, vector array<double>")

    return embed


def default_k(n: int) -> int:
    return min(max(1, math.isqrt(n)), n)


def build_index(corpus: DataFrame, path: str, embedder: Embedder | None = None, k: int | None = None, iters: int = 8, size: int = 1200, overlap: int = 200, align_start: bool = False) -> dict:
    """Chunks, embeds and clusters a corpus, and writes clusters, centroids, chunk metadata and, last, the manifest."""
    cut = written(chunks(corpus, size, overlap, align_start), "chunks")
    placed = kmeans.positions(cut.select(F.struct("uri", "start").alias("doc_id"), F.struct("end", "text").alias("vector")))
    docs = placed.select(F.col("pos").alias("doc_id"), F.col("doc_id.uri").alias("uri"), F.array("doc_id.start", "vector.end").alias("byte_range"), F.col("vector.text").alias("text"))
    vectors = (embedder or hashed_embedder())(docs.select(F.col("doc_id").alias("id"), "text"))
    vectors = written(vectors.select(F.col("id").alias("doc_id"), normalize(F.col("vector")).alias("vector")), "vectors")
    return build_from_vectors(vectors, docs.select("doc_id", "uri", "byte_range", F.left("text", F.lit(SNIPPET)).alias("snippet")), path, k, iters, size, overlap)


def build_from_vectors(vectors: DataFrame, docs: DataFrame, path: str, k: int | None = None, iters: int = 8, size: int = 1200, overlap: int = 200) -> dict:
    """Clusters ``vectors(doc_id, vector)`` at unit length and writes an index; ``docs(doc_id, uri, byte_range, snippet)`` says what they stand for."""
    n = vectors.count()
    if not n:
        raise IndexError_("nothing to index")
    k = default_k(n) if k is None else min(k, n)
    centroids, assigned = kmeans.train(vectors, k, iters)
    write_index(vectors.sparkSession, path, centroids, assigned, docs)
    return write_index_manifest(vectors.sparkSession, path, {"dim": int(centroids.shape[1]), "k": len(centroids), "chunk_chars": size, "chunk_overlap": overlap})


def index(store: Store, prefix: str = "", namespace: str = "default", pattern: str = "**/*.md", max_file_bytes: int = 4 << 20, k: int | None = None, embedder: Embedder | None = None, iters: int = 8) -> dict:
    """The index verb: the text files of a prefix that match a glob and aren't too large, indexed under a namespace beside them."""
    if not namespace or "/" in namespace or namespace.startswith("."):
        raise IndexError_(f"bad namespace {namespace!r}")
    corpus = text_files(store.corpus(prefix, pattern, max_file_bytes), pattern, max_file_bytes)
    return build_index(corpus, index_path(store, namespace), embedder, k, iters)


def index_path(store: Store, namespace: str = "default") -> str:
    return join_uri(store.root, f"_index/{namespace}")


def write_clusters(rows: DataFrame, path: str, batch: int) -> None:
    """Assigned vectors in files that hold ranges of clusters in order, so that a scan skips what it needn't read; a batch that is
    written again takes the place of its former self."""
    # written first: a partitioning by ranges computes its rows twice, once for the bounds
    rows = written(rows.select("doc_id", F.col("vector").cast("array<float>").alias("vector"), "cluster_id"), "assigned")
    rows.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/clusters/batch={batch}")


def write_index(spark: SparkSession, path: str, centroids: np.ndarray, assigned: DataFrame, docs: DataFrame) -> None:
    """Writes a new index. The manifest of an older one goes first: as long as there is none, there is no index."""
    for part in ("manifest", "clusters", "docs"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    write_clusters(assigned, path, 0)
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch=0")
    table = pa.table({"cluster_id": pa.array(np.arange(len(centroids), dtype=np.int32)), "centroid": pa.array(centroids.tolist(), pa.list_(pa.float64()))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/centroids")


def write_index_manifest(spark: SparkSession, path: str, fixed: dict) -> dict:
    """Counts what is there and commits it."""
    sizes = dict(spark.read.parquet(f"{path}/clusters").groupBy("cluster_id").count().collect())  # a row a cluster
    out = {"version": 1, **fixed, "num_docs": sum(sizes.values()), "cluster_sizes": [sizes.get(i, 0) for i in range(fixed["k"])]}
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return out


class VectorIndex:
    """An index as it was written; it is whole if its manifest is there."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            self.manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        except Exception as error:
            raise IndexError_(f"no index at {path}") from error
        self.spark, self.path = spark, path
        self.clusters, self.centroids, self.docs = (spark.read.parquet(f"{path}/{x}") for x in ("clusters", "centroids", "docs"))
        # of a file that was indexed again, the chunks of its last batch count
        newest = self.docs.groupBy("uri").agg(F.max("batch").alias("batch"))
        if not self.docs.where("batch > 0").isEmpty():
            self.docs = self.docs.join(newest, ["uri", "batch"], "left_semi")
            self.clusters = self.clusters.join(self.docs.select("doc_id"), "doc_id", "left_semi")

    def search(self, queries: DataFrame, k: int, probe: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank) for ``queries(query_id, vector)``; callers that round scores themselves ask for ``exact`` ones."""
        wrong = queries.where(F.size("vector") != self.manifest["dim"]).limit(1)
        if not wrong.isEmpty():
            raise IndexError_("a query's length differs from the index's")
        return search_clusters(self.clusters, self.centroids, queries, k, probe, exact)

    def search_text(self, queries: DataFrame, k: int, probe: int = 8, embedder: Embedder | None = None) -> DataFrame:
        """The same for ``queries(query_id, text)``."""
        rows = (embedder or hashed_embedder(self.manifest["dim"]))(queries.select(F.col("query_id").alias("id"), "text"))
        return self.search(rows.select(F.col("id").alias("query_id"), "vector"), k, probe)


__all__ = ["VectorIndex", "build_from_vectors", "build_index", "default_k", "hashed_embedder", "index", "index_path", "write_clusters", "write_index", "write_index_manifest"]
