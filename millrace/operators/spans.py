"""Widening of spans to the definitions that enclose them, drift, and projections of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SPAN_COLUMNS
from .containers import with_containers
from .grep import sorted_spans

SNIPPET = 800


def enclosing(containers: Column, at: Column) -> Column:
    """The innermost container of a byte: the latest start, and of equal ones the narrowest; null if there is none."""
    inside = F.filter(containers, lambda c: (c["start"] <= at) & (at < c["end"]))
    best = F.array_max(F.transform(inside, lambda c: F.struct(c["start"].alias("s"), (-c["end"]).alias("e"), c["first"].alias("first"), c["last"].alias("last"), c["symbol"].alias("symbol"), c["kind"].alias("kind"))))
    return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), (-best["e"]).alias("end"), best["first"].alias("first"), best["last"].alias("last"), best["symbol"].alias("symbol"), best["kind"].alias("kind")))


def drop_drifted(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Spans that still fit their file: within its length, and of its hash if they carry one."""
    now = files.select("uri", F.octet_length("content").alias("_len"), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("_hash"))
    kept = spans.join(now, "uri").where((F.col("byte_range.end") <= F.col("_len")) & (F.col("content_hash").isNull() | (F.col("content_hash") == F.col("_hash"))))
    return kept.select(*spans.columns)


def distinct_spans(spans: DataFrame, *by: str) -> DataFrame:
    """One span for each uri and byte range; the first by line and score is kept."""
    w = Window.partitionBy(*by, "uri", "byte_range.start", "byte_range.end").orderBy(F.col("line_range")[0], F.desc("score"), "kind")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def widen(spans: DataFrame, corpus: DataFrame, *by: str) -> DataFrame:
    """Spans replaced by the innermost definition around the first character of their line that is not blank.

    Only files with hits are parsed. Drifted spans go; spans of other languages and outside of any
    definition stay as they are, but get the content hash where the language is known. Spans of one
    definition become one, within equal values of the columns ``by``. Joined on uri, with the containers of a file in one row: an
    interval join without a blow-up.
    """
    hit = corpus.select("uri", "content").join(spans.select("uri").distinct(), "uri", "left_semi")
    files = with_containers(hit)
    renamed = files.select("uri", F.col("content").alias("_c"), F.col("language").alias("_lang"), F.col("content_hash").alias("_h"), F.col("containers").alias("_k"))
    rows = spans.join(renamed, "uri")
    start, end = F.col("byte_range.start"), F.col("byte_range.end")
    rows = rows.where((end <= F.octet_length("_c")) & (F.col("content_hash").isNull() | (F.col("content_hash") == F.col("_h"))))
    line = F.substring(F.col("_c"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    blank = F.length(F.ltrim(line, F.lit(" \t\r\n"))) == 0
    probe = F.when(blank, start).otherwise(start + F.octet_length(line) - F.octet_length(F.ltrim(line, F.lit(" \t\r\n"))))
    rows = rows.withColumn("_w", enclosing(F.col("_k"), probe))
    whole = F.substring(F.col("_c"), (F.col("_w.start") + 1).cast("int"), (F.col("_w.end") - F.col("_w.start")).cast("int")).cast("string")
    found = F.col("_w").isNotNull()
    new = {
        "byte_range": F.when(found, F.struct(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"))).otherwise(F.col("byte_range")),
        "line_range": F.when(found, F.array("_w.first", "_w.last")).otherwise(F.col("line_range")),
        "symbol": F.when(found, F.col("_w.symbol")).otherwise(F.col("symbol")),
        "kind": F.when(found, F.col("_w.kind")).otherwise(F.col("kind")),
        "snippet": F.when(found, F.left(whole, F.lit(SNIPPET))).otherwise(F.col("snippet")),
        "source_stage": F.when(found, F.lit("ast")).otherwise(F.col("source_stage")),
        "content_hash": F.when(F.col("_lang").isNotNull(), F.col("_h")).otherwise(F.col("content_hash")),
        "truncated": F.when(found, F.char_length(whole) > SNIPPET).otherwise(F.col("truncated")),
    }
    return distinct_spans(rows.select(*[new.get(c, F.col(c)).alias(c) for c in spans.columns]), *by)


def first_line(snippet: Column, chars: int) -> Column:
    """The first line that is not blank, cut after so many characters."""
    found = F.filter(F.split(snippet, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")
    return F.left(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")), F.lit(chars))


def concise(spans: DataFrame, chars: int = 160) -> DataFrame:
    return spans.select("uri", "line_range", "symbol", "kind", first_line(F.col("snippet"), chars).alias("snippet"), "score")


def findings(spans: DataFrame, chars: int = 240) -> DataFrame:
    """Delegate's shape of a span; its byte range is an array."""
    return spans.select(
        "uri", F.array("byte_range.start", "byte_range.end").alias("byte_range"), "line_range", "symbol", "kind", first_line(F.col("snippet"), chars).alias("snippet"), "score"
    )


def printed(spans: DataFrame) -> DataFrame:
    """One line of text a span."""
    tag = F.concat_ws(" ", F.initcap("kind"), "symbol")
    return spans.select(F.format_string("%s:%d-%d [%s]\t%s", "uri", F.col("line_range")[0], F.col("line_range")[1], tag, F.coalesce(first_line(F.col("snippet"), 1 << 20), F.lit(""))).alias("line"))


def with_symbols(spans: DataFrame, names: list[str], limit: int | None = None) -> DataFrame:
    return sorted_spans(spans.where(F.col("symbol").isin(names)), limit)


__all__ = ["SPAN_COLUMNS", "concise", "distinct_spans", "drop_drifted", "enclosing", "findings", "first_line", "printed", "widen", "with_symbols"]
