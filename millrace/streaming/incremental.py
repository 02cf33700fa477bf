"""Keeping an index up to date: by fingerprints in batches, and by a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoint import written
from ..functions.text import chunks
from ..functions.vector import normalize
from ..operators.kmeans import assign, positions
from ..operators.matrix import rows_of
from ..plans.index import SNIPPET, Embedder, VectorIndex, hashed_embedder, write_clusters, write_index_manifest

FINGERPRINT = ("size", "etag", "last_modified")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of a listing that are new or whose size, etag or time differ from the earlier listing."""
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in FINGERPRINT]
    return now.alias("a").join(before.alias("b"), (F.col("a.key") == F.col("b.key")) & same[0] & same[1] & same[2], "left_anti")


def removed(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.join(now.select("key"), "key", "left_anti")


def append(index_path: str, corpus: DataFrame, embedder: Embedder | None = None, batch: int | None = None) -> int:
    """Adds the chunks of a corpus to an index, whose centroids stay; returns their number.

    A batch that is added again, as a stream does after a failure, takes the place of its former self. Chunks of a file that was indexed before give way to
    those of the batch with the greater number. Without a number the batch follows the last one. The manifest is written anew, last.
    """
    spark = corpus.sparkSession
    index = VectorIndex(spark, index_path)
    every = spark.read.parquet(f"{index_path}/docs")
    if batch is None:
        batch = every.agg(F.max("batch")).first()[0] + 1
    start = (every.where(F.col("batch") < batch).agg(F.max("doc_id")).first()[0] or 0) + 1
    size, overlap = index.manifest["chunk_chars"], index.manifest["chunk_overlap"]
    cut = written(chunks(corpus, size, overlap), "chunks")
    placed = positions(cut.select(F.struct("uri", "start").alias("doc_id"), F.struct("end", "text").alias("vector")))
    docs = placed.select((F.col("pos") + start).alias("doc_id"), F.col("doc_id.uri").alias("uri"), F.array("doc_id.start", "vector.end").alias("byte_range"), F.col("vector.text").alias("text"))
    if docs.isEmpty():
        return 0
    centroids = rows_of(index.centroids.select("cluster_id", "centroid").toArrow().sort_by("cluster_id").column("centroid"))
    vectors = (embedder or hashed_embedder(index.manifest["dim"]))(docs.select(F.col("doc_id").alias("id"), "text"))
    write_clusters(assign(vectors.select(F.col("id").alias("doc_id"), normalize(F.col("vector")).alias("vector")), centroids), index_path, batch)
    docs.select("doc_id", "uri", "byte_range", F.left("text", F.lit(SNIPPET)).alias("snippet")).write.mode("overwrite").parquet(f"{index_path}/docs/batch={batch}")
    write_index_manifest(spark, index_path, {x: index.manifest[x] for x in ("dim", "k", "chunk_chars", "chunk_overlap")})
    return docs.count()


def follow(spark: SparkSession, folder: str, index_path: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """A stream that adds files to an index as they appear in a folder; it takes what there is and ends. Each batch is added once, also after a failure."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    corpus = files.select(F.col("path").alias("uri"), "content")

    def add(batch: DataFrame, number: int) -> None:
        append(index_path, batch, embedder, number + 1)

    return corpus.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
