"""Fusion of ranked lists and lexical ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SPAN_COLUMNS

RRF_K = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fuse(ranked: DataFrame, top: int | None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of spans with the columns ``list`` and ``rank`` (from 1).

    A span's score is the sum of 1 / (k + rank) over the lists that hold it; its other values are those of
    the first list. Order: score, then uri, start and end.
    """
    payload = F.struct(*[c for c in SPAN_COLUMNS if c not in ("uri", "byte_range", "score")])
    fused = ranked.groupBy("uri", "byte_range").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min_by(payload, F.struct("list", "rank")).alias("p"))
    rows = fused.select("uri", "byte_range", "score", "p.*").select(*SPAN_COLUMNS)
    ordered = rows.orderBy(F.desc("score"), "uri", "byte_range.start", "byte_range.end")
    return ordered if top is None else ordered.limit(top)


def ranked(spans: DataFrame, number: int, *order: Column, cap: int | None = None) -> DataFrame:
    """Spans of one list with their rank; only the first ``cap`` are kept, before ranks are given."""
    if cap is not None:
        spans = spans.orderBy(*order).limit(cap)
    return spans.withColumn("list", F.lit(number)).withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order)))


def boosted(spans: DataFrame, query: str, terms: list[str]) -> DataFrame:
    """Spans whose score has the lexical boost, and the signals it rests on.

    A thousandth for each term in uri, symbol or snippet, three quarters of it for each term in the
    symbol, and one for the whole query as it was typed, all in ASCII lower case.
    """
    low = lambda c: F.translate(c, _UPPER, _LOWER)
    symbol = low(F.coalesce("symbol", F.lit("")))
    hay = F.concat_ws("\n", low(F.col("uri")), symbol, low(F.coalesce("snippet", F.lit(""))))

    def count(where: Column) -> Column:
        total = F.lit(0)
        for t in terms:
            total = total + F.contains(where, F.lit(t)).cast("int")
        return total

    phrase = query.translate(str.maketrans(_UPPER, _LOWER))
    hits = count(hay)
    literal = hits + 0.75 * count(symbol) + F.contains(hay, F.lit(phrase)).cast("int")
    cosine = F.when(F.col("rank_signals").isNotNull(), F.col("rank_signals.cosine"))
    return spans.withColumns(
        {
            "score": F.col("score") + 0.001 * literal,
            "rank_signals": F.struct(cosine.alias("cosine"), literal.cast("float").alias("literal_match"), hits.cast("int").alias("term_overlap")),
        }
    )


def rank(spans: DataFrame, query: str, terms: list[str], top: int) -> DataFrame:
    """The best spans by boosted score, then by terms, uri, line and byte."""
    return boosted(spans, query, terms).orderBy(F.desc("score"), F.desc("rank_signals.term_overlap"), "uri", F.col("line_range")[0], "byte_range.start").limit(top)
