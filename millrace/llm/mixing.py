"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed

#: Expected copies are kept as whole millionths, so that prefix sums are exact.
UNIT = 1_000_000
#: Rows that a shard of a source holds at most, about. Shards are leading hex digits of the order hash.
SHARD_ROWS = 50_000


def random_offset(seed: int) -> int:
    """The one random offset in [0, UNIT), from the seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:12], 16) % UNIT


def shard_digits(rows: int) -> int:
    """So many digits that a shard has SHARD_ROWS rows or fewer, also where all are of one source."""
    digits = 3
    while 16**digits * SHARD_ROWS < rows:
        digits += 1
    return digits


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, copy: str | None = "copy") -> DataFrame:
    """Rows of ``docs``, each as often as systematic sampling emits it, with ``copy`` = 0, 1, ...

    A document of source s is expected share(s) * epochs * all characters / characters(s)
    times, so that sources contribute characters in proportion to their weights.
    ``weights`` names the sources to use, others get none; without it a source weighs the
    square root of its characters. Within a source, in the order of the md5 of doc_id, expected copies are
    summed, one random offset is added, and a document is emitted once for each
    integer that its interval crosses.

    Only (source, shard) counts are summed across the cluster: shards are leading digits
    of the order hash, as many as the number of rows asks for, so neither a hot source nor the number of rows
    loads one task. The number of shards has no effect on the rows.

    Sizes come from ``n_chars``; null or negative ones count as 0. Null sources form one
    source of their own, which ``weights`` can't name. Null ids are ordered first. Rows with
    equal ids are ordered by text, and equal rows are exchangeable. A source without characters emits nothing,
    an empty table gives an empty one, and other columns pass through, whatever their names, save that one
    of the name ``copy``, in any case, is replaced. With ``copy=None`` there is no such column, and all pass through.
    """
    spark = docs.sparkSession
    digits = shard_digits(docs.count())
    size = F.greatest(F.coalesce(F.col("n_chars").cast("long"), F.lit(0)), F.lit(0))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    shards = (
        docs.select(source.alias("s"), F.substring(key, 1, digits).alias("d"), size.alias("z"))
        .groupBy("s", "d")
        .agg(F.count("*").alias("n"), F.sum("z").alias("z"))
    )
    sums = shards.groupBy("s").agg(F.sum("z").alias("z")).where("z > 0")
    if weights is None:
        sums = sums.withColumn("w", F.sqrt(F.col("z").cast("double")))
    else:
        given = spark.createDataFrame([("=" + k, float(v)) for k, v in sorted(weights.items())], "s string, w double")
        sums = sums.join(given, "s")
    total = sums.agg(F.sum("w").alias("all_w")).crossJoin(shards.agg(F.sum("z").alias("all_z")))
    rates = sums.crossJoin(total).select(
        "s", F.round(F.col("w") / F.col("all_w") * epochs * F.col("all_z") / F.col("z") * UNIT).cast("long").alias("c")
    )
    before = Window.partitionBy("s").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.join(rates, "s")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(F.col("s").alias("_s"), F.col("d").alias("_d"), "before", "c")
    )
    rows = docs.select(
        packed(docs, *([copy] if copy else [])).alias("r"), source.alias("_s"), F.substring(key, 1, digits).alias("_d"), key.alias("_h")
    )
    # the counts are the small side, whatever the size; documents are shuffled once for join and window
    placed = rows.join(starts.hint("shuffle_hash"), ["_s", "_d"]).withColumn(
        "i", F.row_number().over(Window.partitionBy("_s", "_d").orderBy("_h", F.col("r.doc_id"), F.col("r.text"))) + F.col("before")
    )
    u = random_offset(seed)
    copies = F.expr(f"int((i * c + {u}) div {UNIT} - ((i - 1) * c + {u}) div {UNIT})")
    emitted = placed.withColumn("k", copies).where("k > 0").select("r", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("k"))
    return emitted.select("r.*", F.col("k").alias(copy)) if copy else emitted.select("r.*")


def mixing_sql(seed: int = 17) -> str:
    """DuckDB SQL for ``mix_sources(documents)`` with the default weights."""
    u = random_offset(seed)
    return f"""
    WITH s AS (SELECT source, sum(greatest(coalesce(n_chars, 0), 0)) AS z FROM documents GROUP BY source),
    r AS (SELECT source, CAST(round(sqrt(CAST(z AS DOUBLE)) / (SELECT sum(sqrt(CAST(z AS DOUBLE))) FROM s WHERE z > 0)
            * 1.0 * (SELECT sum(z) FROM s) / z * {UNIT}) AS BIGINT) AS c FROM s WHERE z > 0),
    o AS (SELECT d.*, r.c, row_number() OVER (PARTITION BY d.source
            ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, text) AS i
          FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
    k AS (SELECT doc_id, text, lang, source, n_chars, (i * c + {u}) // {UNIT} - ((i - 1) * c + {u}) // {UNIT} AS k FROM o)
    SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(k)) AS INTEGER) AS copy FROM k
    """
