"""Fixed-stride binary vectors, for exchange with other tools; the index itself is Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexError_
from ..operators.matrix import rows_of
from .files import where


def _record(dim: int) -> np.dtype:
    return np.dtype([("doc_id", "<u4"), ("vector", "<f4", (dim,))])


def encode_cluster(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    out = np.zeros(len(ids), _record(np.shape(vectors)[1] if len(ids) else 1))
    if len(ids):
        out["doc_id"], out["vector"] = ids, vectors
    return out.tobytes()


def decode_cluster(raw: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) % (4 + 4 * dim):
        raise IndexError_("the size of a cluster is no multiple of a record")
    rows = np.frombuffer(raw, _record(dim))
    return rows["doc_id"].astype(np.int64), rows["vector"].reshape(-1, dim).copy()


def encode_centroids(centroids: np.ndarray) -> bytes:
    return np.asarray(centroids, "<f4").tobytes()


def decode_centroids(raw: bytes, dim: int, k: int) -> np.ndarray:
    if len(raw) != 4 * dim * k:
        raise IndexError_("the size of the centroids is wrong")
    return np.frombuffer(raw, "<f4").reshape(k, dim).copy()


def encode_clusters(assigned: DataFrame) -> DataFrame:
    """(cluster_id, content): the records of each cluster of ``assigned(doc_id, vector, cluster_id)``, by doc_id."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        raw = encode_cluster(rows.column("doc_id").to_numpy(), rows_of(rows.column("vector")))
        return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int32()), "content": pa.array([raw], pa.binary())})

    return assigned.select("cluster_id", F.col("doc_id").cast("long"), "vector").groupBy("cluster_id").applyInArrow(run, "cluster_id int, content binary")


def decode_clusters(files: DataFrame, dim: int) -> DataFrame:
    """(cluster_id, doc_id, vector) of ``files(cluster_id, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = decode_cluster(raw, dim)
                yield pa.record_batch([pa.array([cluster] * len(ids), pa.int32()), pa.array(ids), _lists(vectors)], names=["cluster_id", "doc_id", "vector"])

    return files.select("cluster_id", "content").mapInArrow(run, "cluster_id int, doc_id long, vector array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def write_vecs(vectors: DataFrame, path: str, kind: str = "float") -> None:
    """``vectors(pos, vector)`` as fvecs or ivecs files in a folder, in the order of pos over the names of the files."""
    element, at = "<f4" if kind == "float" else "<i4", where(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = at.open()
        out = None
        for batch in batches:
            x = rows_of(batch.column(1)).astype(element)
            if not len(x):
                continue
            if out is None:
                out = system.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():06}.{kind[0]}vecs")
            rows = np.empty((len(x), x.shape[1] + 1), element)
            rows[:, 0] = np.array([x.shape[1]], "<i4").view(element)[0]
            rows[:, 1:] = x
            out.write(rows.tobytes())
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array([0], pa.int64())], names=["done"])

    at.make()
    vectors.select("pos", "vector").repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(run, "done long").agg(F.count("*")).collect()


def read_vecs(spark: SparkSession, path: str, kind: str = "float", rows: int = 1 << 16) -> DataFrame:
    """(pos, vector) of an fvecs (float) or ivecs (int) file or a folder of them: each row is its length, then its values.

    Rows of one file have one length, which its first four bytes say; each task then reads ranges of ``rows`` rows.
    """
    at = where(path)
    system, folder = at.open()
    plan, pos = [], 0
    for name, size in sorted((f.path, f.size) for f in at.files() if f.size):
        with system.open_input_file(name) as file:
            dim = int(np.frombuffer(file.read(4), "<i4")[0])
        stride = 4 + 4 * dim
        if dim <= 0 or size % stride:
            raise IndexError_(f"{name} has no rows of one length")
        for first in range(0, size // stride, rows):
            n = min(rows, size // stride - first)
            plan.append((name, first * stride, n, dim, pos))
            pos += n
    element = "<f4" if kind == "float" else "<i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = at.open()
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["name"]) as file:
                    file.seek(r["start"])
                    x = np.frombuffer(file.read(r["n"] * (4 + 4 * r["dim"])), element).reshape(r["n"], -1)[:, 1:]
                yield pa.record_batch([pa.array(r["pos"] + np.arange(r["n"])), _lists(x)], names=["pos", "vector"])

    ranges = spark.createDataFrame(plan, "name string, start long, n long, dim int, pos long")
    return ranges.repartition(max(1, len(plan)), "pos").mapInArrow(run, f"pos long, vector array<{kind}>")
