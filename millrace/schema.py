"""The row types that operators exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("line", "block", "function", "method", "class", "module")
STAGES = ("grep", "ast", "vector", "fusion")

LISTING = "key string, size long, etag string, last_modified long"
SIGNALS = "struct<cosine:float,literal_match:float,term_overlap:int>"
SPAN = (
    "uri string, byte_range struct<start:bigint,end:bigint>, line_range array<int>, symbol string, kind string, snippet string, "
    f"score double, rank_signals {SIGNALS}, source_stage string, content_hash string, truncated boolean"
)
SPAN_COLUMNS = ("uri", "byte_range", "line_range", "symbol", "kind", "snippet", "score", "rank_signals", "source_stage", "content_hash", "truncated")
CONTAINER = "array<struct<start:bigint,end:bigint,first:int,last:int,symbol:string,kind:string>>"

#: Order of results: place in the corpus.
PLACE = ("uri", "line_range", "byte_range.start")


def place() -> list[Column]:
    return [F.col("uri"), F.col("line_range")[0], F.col("byte_range.start")]


def text(content: Column) -> Column:
    """Content as a string with its very bytes, so that byte offsets stay right."""
    return content.cast("string")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and n + 1 offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def empty_spans(spark) -> DataFrame:
    return spark.createDataFrame([], SPAN)


def span_json(spans: DataFrame) -> DataFrame:
    """One JSON object a span: nulls are left out, and ``truncated`` unless it is true."""
    cols = [F.when(F.col(c), F.lit(True)).alias(c) if c == "truncated" else F.col(c) for c in SPAN_COLUMNS]
    return spans.select(F.to_json(F.struct(*cols)).alias("json"))


def spans_from_json(lines: DataFrame) -> DataFrame:
    """Spans from JSON objects; absent fields are null and ``truncated`` false."""
    rows = lines.select(F.from_json("json", SPAN).alias("s")).select("s.*")
    return rows.withColumn("truncated", F.coalesce("truncated", F.lit(False)))
