"""Lines of a corpus, and those that match a pattern."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import java_pattern
from ..schema import SIGNALS, place, text, utf8

MAX_OBJECT_BYTES = 64 << 20
#: A path segment that begins with a dot and is longer than it.
HIDDEN = r"(^|/)\.[^/]+"
#: White space of Unicode, which ends no snippet.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LITERAL_META = set(".+*?()|[]{}^$\\")


def visible(corpus: DataFrame, max_object_bytes: int = MAX_OBJECT_BYTES, skip_hidden: bool = True) -> DataFrame:
    """Files that a scan looks into: not too large and not hidden."""
    kept = corpus.where(F.octet_length("content") <= max_object_bytes)
    return kept.where(~F.col("uri").rlike(HIDDEN)) if skip_hidden else kept


@F.arrow_udf(ArrayType(IntegerType()))
def _line_starts(contents: pa.Array) -> pa.Array:
    """Where the lines of each content begin, in bytes, with its length at the end: one more number than ``split`` has parts."""
    data, at = utf8(contents.fill_null(""))
    feeds = np.flatnonzero(data == 10)
    first = np.searchsorted(feeds, at)
    count = np.diff(first)
    ends = np.concatenate(([0], np.cumsum(count + 2)))
    out = np.zeros(ends[-1], np.int32)
    out[ends[1:] - 1] = np.diff(at)
    own = np.repeat(np.arange(len(count)), count)
    out[ends[own] + 1 + np.arange(len(feeds)) - first[own]] = feeds + 1 - at[own]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))


def lines(corpus: DataFrame) -> DataFrame:
    """(uri, line_no, line, start, end) for every line, numbered from 1.

    ``start`` and ``end`` are byte offsets; ``end`` includes the line feed, which a last line may lack. A final
    line feed begins no further line, and null or empty contents have none. Offsets are counted within the row, without a shuffle.
    """
    return matching_lines(corpus, None)


def matching_lines(corpus: DataFrame, keep: Column | None, extra: dict[str, Column] | None = None, stamp_hash: bool = False) -> DataFrame:
    """(uri, line_no, line, start, end, ...) of the lines for which ``keep`` holds, with the ``content_hash`` of
    their file where it is wanted.

    Time is linear in the size of a file, however many lines match: all offsets of a file come from one pass over its bytes, its
    hash is taken once, before its lines become rows, and the contents stay behind then. Lines are split and matched within generated code.
    """
    t = text(corpus["content"])
    digest = [F.concat(F.lit("sha256:"), F.sha2(corpus["content"].cast("binary"), 256)).alias("content_hash")] if stamp_hash else []
    held = corpus.select("uri", t.alias("_t"), _line_starts(t).alias("_starts"), *digest)
    kept = [F.col("content_hash")] if stamp_hash else []
    rows = held.select("uri", "_starts", *kept, F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line"))
    for name, column in (extra or {}).items():
        rows = rows.withColumn(name, column)
    if keep is not None:
        rows = rows.where(keep)
    total = F.element_at("_starts", -1)
    start, end = F.get("_starts", F.col("pos")), F.get("_starts", F.col("pos") + 1)
    # what follows a final line feed is no line; the offsets are never null, and no filter on them need go below
    rows = rows.where(F.coalesce(start < total, F.lit(False)))
    return rows.select("uri", (F.col("pos") + 1).alias("line_no"), "line", start.cast("long").alias("start"), end.cast("long").alias("end"), *kept, *(extra or {}))


def as_spans(rows: DataFrame, *extra: str) -> DataFrame:
    """Line spans from ``matching_lines``."""
    return rows.select(
        "uri",
        F.struct(F.col("start"), F.col("end")).alias("byte_range"),
        F.array("line_no", "line_no").alias("line_range"),
        F.lit(None).cast("string").alias("symbol"),
        F.lit("line").alias("kind"),
        F.rtrim("line", F.lit(BLANKS)).alias("snippet"),
        F.lit(1.0).alias("score"),
        F.lit(None).cast(SIGNALS).alias("rank_signals"),
        F.lit("grep").alias("source_stage"),
        F.col("content_hash") if "content_hash" in rows.columns else F.lit(None).cast("string").alias("content_hash"),
        F.lit(False).alias("truncated"),
        *extra,
    )


def grep(
    corpus: DataFrame, pattern: str, *, case_insensitive: bool = False, multi_line: bool = False, max_hits: int | None = 1000,
    max_hits_per_file: int | None = None, stamp_hash: bool = False, max_object_bytes: int = MAX_OBJECT_BYTES, skip_hidden: bool = True,
) -> DataFrame:
    """One span for each line that matches: the first ``max_hits`` in order of uri, line and byte.

    Without ``max_hits`` all come, in no order across files, so that nothing is shuffled (``sorted_spans`` gives the order).
    Matching is by line, whatever ``multi_line`` says, which only sets the flag of the pattern.
    """
    files = visible(corpus, max_object_bytes, skip_hidden)
    if pattern and not case_insensitive and not set(pattern) & _LITERAL_META:
        files = files.where(F.contains(text(F.col("content")), F.lit(pattern)))  # reaches the scan
    hits = as_spans(matching_lines(files, F.col("line").rlike(java_pattern(pattern, case_insensitive, multi_line)), stamp_hash=stamp_hash))
    if max_hits_per_file is not None:
        nth = F.row_number().over(Window.partitionBy("uri").orderBy(F.col("line_range")[0]))
        hits = hits.withColumn("_n", nth).where(F.col("_n") <= max_hits_per_file).drop("_n")
    return hits if max_hits is None else sorted_spans(hits, max_hits)


def sorted_spans(spans: DataFrame, limit: int | None = None) -> DataFrame:
    """Spans by place; with a limit this is a top-k without a full sort."""
    ordered = spans.orderBy(*place())
    return ordered if limit is None else ordered.limit(limit)


def legacy_hits(spans: DataFrame) -> DataFrame:
    """(id, uri, score, snippet, metadata): the older shape of a hit."""
    meta = F.to_json(F.struct(F.col("line_range")[0].alias("line"), F.col("byte_range.start").alias("start"), F.col("byte_range.end").alias("end")))
    return spans.select(F.format_string("%s:%d", "uri", F.col("line_range")[0]).alias("id"), "uri", "score", "snippet", meta.alias("metadata"))
