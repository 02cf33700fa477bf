"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of text that one vectorised step holds at a time.
BLOCK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder serves, which is allowed on a
    local master only; on a cluster the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """``materialise`` with rows in buckets by a column, so that joins on it don't shuffle the table again. ``df`` should be
    partitioned by the column, in as many partitions as a shuffle has, for few files."""
    spark = df.sparkSession
    name = f"millrace_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/millrace/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._millrace_path, out._millrace_table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialise`` or ``bucketed`` wrote and that nothing reads any more."""
    for df in tables:
        if hasattr(df, "_millrace_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._millrace_table}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column name that is taken as it is, dots included."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns of a row as one struct, whatever their names; those named in ``without`` are left out."""
    names = {w.lower() for w in without}
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns if c.lower() not in names])


def release() -> None:
    """Gives freed memory of a Python worker back to the system; a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_of(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def blocks(lengths: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``limit``; a longer row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets.astype(np.int64) - (offsets[0] if len(offsets) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: uint64 in, uint64 out, every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class SegmentHash:
    """64-bit hashes of any segments of a byte array, from prefix sums of a polynomial.

    With an odd base b modulo 2**64, (S[e] - S[s]) * b**-s depends on the bytes of
    [s, e) alone; the finaliser mixes it with the length.
    """

    BASE = 0x5851F42D4C957F2D
    _powers: dict[str, np.ndarray] = {}

    @classmethod
    def _table(cls, kind: str, n: int) -> np.ndarray:
        have = cls._powers.get(kind)
        if have is None or len(have) < n:
            base = cls.BASE if kind == "up" else pow(cls.BASE, -1, 1 << 64)
            size = max(n, BLOCK_BYTES + 1)
            with np.errstate(over="ignore"):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                have = cls._powers[kind] = np.multiply.accumulate(steps)
        return have

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._table("up", n + 1)[:n], out=self.sums[1:])
        self.down = self._table("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.down[start]
            return mix64(raw ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def segments(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``member[byte]`` holds."""
    inside = member[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, full: int = 200_000) -> Iterator[pa.Table]:
    """From batches sorted by ``key``, tables that hold whole groups only.

    Groups are never cut: a table ends where a key ends, and a group that is larger
    than ``full`` rows comes whole.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < full:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
        full = max(full, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """At most ``most`` labelled texts with their label, chosen by the hash of the id.

    This is the bounded sample on which classifiers are fitted; nothing else uses it.
    Rows with a null id, label or text don't count; an id labelled twice counts once
    if its labels agree and not at all otherwise.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y"))
        .where("k IS NOT NULL AND y IN (0, 1)")
        .groupBy("k")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .where("y = z")
        .select("k", "y", F.md5(F.col("k").cast("string")).alias("h"))
        .orderBy("h", "k")
        .limit(most)
    )
    # at most ``most`` rows of two numbers: its size is bounded by the parameter
    texts = documents.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = texts.join(F.broadcast(chosen.select("k", "y", "h")), "k").select("h", "t", "y").toArrow()
    h, t, y = (rows.column(c).to_pylist() for c in ("h", "t", "y"))
    return [(b, c) for _, b, c in sorted(zip(h, t, y))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.hstack([np.asarray(x, float).reshape(len(y), -1), np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
