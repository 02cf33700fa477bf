"""The public verbs: find, search, delegate and the hybrid query."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..errors import MillraceError
from ..functions.text import any_of, case_variants, java_pattern, query_terms, regex_escape, symbol_pattern, tokenize
from ..operators.grep import as_spans, grep, matching_lines, sorted_spans, visible
from ..operators.ranking import RRF_K, fuse, rank, ranked
from ..operators.spans import findings, widen, with_symbols
from ..operators.vectors import hit_spans
from ..schema import SPAN_COLUMNS, empty_spans, place
from .index import VectorIndex


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def grep_verb(corpus: DataFrame, pattern: str, case_insensitive: bool = False, max_hits: int = 1000, ast: bool = False) -> DataFrame:
    """Matching lines, or with ``ast`` the definitions around them."""
    hits = grep(corpus, pattern, case_insensitive=case_insensitive, max_hits=clamp(max_hits, 1, 5000), stamp_hash=ast)
    return sorted_spans(widen(hits, corpus)) if ast else hits


def find(corpus: DataFrame, symbol: str, max_hits: int = 1000, variants: bool = True) -> DataFrame:
    """Definitions of a name, in any of its case styles or exactly as it is."""
    names = case_variants(symbol) if variants else [symbol]
    wide = grep_verb(corpus, symbol_pattern(names), max_hits=clamp(4 * max_hits, 1, 5000), ast=True)
    return with_symbols(wide, names, max_hits)


def probes(query: str, terms: list[str]) -> list[str]:
    """At most three patterns: any term, the whole phrase if it has several words, and the first term."""
    out = [any_of(terms)]
    phrase = query.strip()
    if len(phrase.split()) > 1:
        out.append(regex_escape(phrase))
    if (first := regex_escape(terms[0])) not in out:
        out.append(first)
    return out


def probe_spans(corpus: DataFrame, patterns: list[str], cap: int, ast: bool = True) -> DataFrame:
    """The spans of all probes with ``list`` and ``rank``, from one scan of the corpus: ranks follow the order of places.

    A line becomes a row for each probe that it matches. Each probe's hits are capped by place, within the tasks first,
    before they are widened.
    """
    matched = F.array(*[F.when(F.col("line").rlike(java_pattern(p, True)), F.lit(i)) for i, p in enumerate(patterns)])
    rows = matching_lines(visible(corpus), None, {"_lists": F.array_compact(matched)}, stamp_hash=ast)
    rows = as_spans(rows.select("*", F.explode("_lists").alias("list")), "list")
    nth = F.row_number().over(Window.partitionBy("list").orderBy(*place()))
    lists = rows.withColumn("rank", nth).where(F.col("rank") <= cap)
    if not ast:
        return lists
    return widen(lists.drop("rank"), corpus, "list").withColumn("rank", nth)


def search(corpus: DataFrame, query: str, k: int = 20, ast: bool = True) -> DataFrame:
    """The best spans for a query: up to three probes fused by reciprocal ranks, then ranked lexically."""
    terms = query_terms(query)
    if not terms or k <= 0:
        return empty_spans(corpus.sparkSession)
    cap = clamp(8 * k, 64, 2000)
    return rank(fuse(probe_spans(corpus, probes(query, terms), cap, ast), cap), query, terms, k)


def search_within(corpus: DataFrame, query: str, k: int = 20, ast: bool = True, budget_ms: int = 15_000) -> PlanResult:
    """``search`` within a budget of time: its spans, or none, and a row of the stage that says why."""
    return _bounded(search(corpus, query, k, ast), "search", budget_ms)


def delegate_within(corpus: DataFrame, query: str, k: int = 20, ast: bool = True, budget_ms: int = 5_000) -> tuple[DataFrame, str, list[StageStat]]:
    """The findings of ``delegate`` within a budget of time, their summary and the row of the stage."""
    found, _ = delegate(corpus, query, k, ast)
    rows, stat = within_budget(found, "delegate", budget_ms)
    counts: dict[str, int] = {}
    for r in rows:
        counts[r.uri] = counts.get(r.uri, 0) + 1
    listed = ", ".join(f"{n} in {uri}" for uri, n in sorted(counts.items()))
    return corpus.sparkSession.createDataFrame(rows, found.schema), f'{len(rows)} match(es) for "{query}"' + (f": {listed}" if rows else ""), [stat]


def _bounded(df: DataFrame, stage: str, budget_ms: int) -> PlanResult:
    rows, stat = within_budget(df, stage, budget_ms)
    return PlanResult(df.sparkSession.createDataFrame(rows, df.schema), [stat])


def stage_table(spark, stages: list[StageStat]) -> DataFrame:
    """(stage, hits, dropped, error) of a plan's stages."""
    return spark.createDataFrame([(s.stage, s.hits, s.dropped, s.error) for s in stages], "stage string, hits int, dropped boolean, error string")


def summary_text(tool: str, result) -> str:
    """The line of text that stands for a result: counts of spans or entries, bytes, a summary, or ok."""
    if isinstance(result, str):
        return result
    if isinstance(result, (bytes, bytearray)):
        return f"{len(result)} bytes"
    if isinstance(result, DataFrame):
        n = result.count()
        return f"{n} span{'' if n == 1 else 's'}" if "byte_range" in result.columns else f"{n} entr{'y' if n == 1 else 'ies'}"
    return "ok"


def delegate(corpus: DataFrame, query: str, k: int = 20, ast: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings, and a row (summary) that counts them by uri: one probe for any term, ranked lexically without fusion."""
    terms = query_terms(query)
    k = clamp(k, 1, 50)
    spark = corpus.sparkSession
    if not terms:
        best = empty_spans(spark)
    else:
        hits = grep(corpus, any_of(terms), case_insensitive=True, max_hits=clamp(20 * k, 64, 2000), stamp_hash=ast)
        best = rank(widen(hits, corpus) if ast else hits, query, terms, k)
    found = findings(best)
    counts = found.groupBy("uri").agg(F.count("*").alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uri", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" in "), x["uri"])), ", ")
    summary = counts.agg(F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(f' match(es) for "{query}"'), F.when(F.count("*") > 0, F.concat(F.lit(": "), parts)).otherwise(F.lit(""))).alias("summary"))
    return found, summary


@dataclass
class StageStat:
    stage: str
    ms: int
    hits: int
    dropped: bool = False
    error: str | None = None


@dataclass
class PlanResult:
    spans: DataFrame
    stages: list[StageStat] = field(default_factory=list)


def within_budget(df: DataFrame, stage: str, budget_ms: int) -> tuple[list, StageStat]:
    """The rows of a small result, or none if its jobs take longer than the budget; they are then cancelled."""
    spark, began, tag = df.sparkSession, time.time(), f"millrace-{stage}-{time.time_ns()}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(budget_ms / 1000, stop)
    timer.start()
    spark.addTag(tag)
    try:
        rows = df.collect()
        if late.is_set():
            raise TimeoutError
        return rows, StageStat(stage, int(1000 * (time.time() - began)), len(rows))
    except Exception as error:
        reason = f"{stage} exceeded its budget of {budget_ms} ms" if late.is_set() else str(error)[:500]
        return [], StageStat(stage, int(1000 * (time.time() - began)), 0, True, reason)
    finally:
        timer.cancel()
        spark.removeTag(tag)


def hybrid(corpus: DataFrame, query: str, index: VectorIndex | None = None, k: int = 10, probe: int = 8, grep_ms: int = 2500, vector_ms: int = 1500, embedder=None) -> PlanResult:
    """Lexical and vector hits fused by reciprocal ranks. A stage that is empty, fails or exceeds its budget is
    left out, and its row of the stages says so. Both lists are small: 512 and 2k spans at most."""
    spark = corpus.sparkSession
    terms = tokenize(query)
    if k <= 0:
        return PlanResult(empty_spans(spark))
    lists, stages = [], []
    if terms:
        hits = grep(corpus, any_of(terms), case_insensitive=True, max_hits=clamp(4 * k, 32, 512))
        rows, stat = within_budget(ranked(hits, 0, *place()), "grep", grep_ms)
        stages.append(stat)
        lists.append((rows, hits))
    if index is not None:
        try:
            q = spark.createDataFrame([(0, query)], "query_id long, text string")
            found = hit_spans(index.search_text(q, 2 * k, probe, embedder), index.docs)
            rows, stat = within_budget(found.withColumn("list", F.lit(1)).select(*SPAN_COLUMNS, "list", F.col("rank").cast("int").alias("rank")), "vector", vector_ms)
        except MillraceError as error:
            rows, stat = [], StageStat("vector", 0, 0, True, str(error))
        stages.append(stat)
        lists.append((rows, None))
    kept = [tuple(r[c] for c in (*SPAN_COLUMNS, "list", "rank")) for rows, _ in lists for r in rows]
    if not kept:
        return PlanResult(empty_spans(spark), stages)
    schema = empty_spans(spark).schema.add("list", IntegerType()).add("rank", IntegerType())
    return PlanResult(fuse(spark.createDataFrame(kept, schema), k, RRF_K), stages)
