"""Queries over the shared tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoint import written
from .functions.text import chunks, java_pattern, query_terms, query_terms_column, tokenize_column
from .operators import kmeans
from .operators.grep import as_spans, grep, lines, matching_lines, visible
from .operators.ranking import boosted, fuse
from .operators.spans import concise, drop_drifted, findings, first_line
from .operators.vectors import knn_batch, probe_clusters, recall, search_clusters, stored_clusters
from .plans.index import default_k
from .plans.search import clamp, delegate, probe_spans, probes, search
from .sources.store import glob, ls, ranges, read

QUERY = "the thing of ation and other"
TERMS = query_terms(QUERY)
LITERAL, ALTERNATION, ANCHOR = "tion", "ation|ing|lich", "^[A-Z][a-z]+ .*[.]$"
FOLDED = "über|ción|tion"
GLOB = "documents/*7"
TOP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "doc_id").alias("uri"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), "page_id").alias("uri"), F.col("html").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("conversations"), "conv_id", "turn").alias("uri"), F.col("text").alias("content"))


def flat(spans: DataFrame, *more: Column | str) -> DataFrame:
    """Spans in plain columns."""
    return spans.select("uri", F.col("line_range")[0].alias("line_no"), F.col("byte_range.start").alias("start"), F.col("byte_range.end").alias("end"), "snippet", *more)


# --- lines -----------------------------------------------------------------------------------

LINES = """
    x AS (SELECT {uri} AS uri, {text} AS content FROM {table} WHERE {text} <> ''),
    y AS (SELECT uri, strlen(content) AS total, unnest(string_split(content, chr(10))) AS line,
                 generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM x),
    z AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY uri ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM y),
    l AS (SELECT uri, CAST(line_no AS INTEGER) AS line_no, line, CAST(start AS BIGINT) AS start,
                 CAST(least(start + strlen(line) + 1, total) AS BIGINT) AS "end", regexp_replace(line, '\\s+$', '') AS snippet FROM z WHERE start < total)
"""
DOCS = LINES.format(uri="'documents/' || doc_id", text="text", table="documents")
PAGES = LINES.format(uri="'pages/' || page_id", text="html", table="pages")
TALK = LINES.format(uri="'conversations/' || conv_id || '/' || turn", text="text", table="conversations")
FLAT = 'uri, line_no, start, "end", snippet'


def line_scan(spark, sf):
    return lines(documents(spark, sf))


def grep_literal(spark, sf):
    return flat(grep(documents(spark, sf), LITERAL, max_hits=None))


def grep_ci(spark, sf):
    return flat(grep(documents(spark, sf), FOLDED, case_insensitive=True, max_hits=None))


def grep_alternation(spark, sf):
    return flat(grep(documents(spark, sf), ALTERNATION, max_hits=None))


def grep_anchor(spark, sf):
    return flat(grep(documents(spark, sf), ANCHOR, max_hits=None))


def grep_cap(spark, sf):
    return flat(grep(documents(spark, sf), LITERAL, max_hits=1000))


def grep_per_file_cap(spark, sf):
    return flat(grep(documents(spark, sf), LITERAL, max_hits=None, max_hits_per_file=2))


def grep_hash(spark, sf):
    return flat(grep(documents(spark, sf), LITERAL, max_hits=None, stamp_hash=True), "content_hash")


def grep_pages(spark, sf):
    return flat(grep(pages(spark, sf), "<(p|h1|title)", max_hits=None))


def grep_conversations(spark, sf):
    return flat(grep(conversations(spark, sf), ALTERNATION, max_hits=None))


def drift(spark, sf):
    """Spans of all documents against files of which those of an even length have changed."""
    before = documents(spark, sf)
    now = before.select("uri", F.when(F.octet_length("content") % 2 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return flat(drop_drifted(grep(before, LITERAL, max_hits=None, stamp_hash=True), now))


def concise_snippet(spark, sf):
    return documents(spark, sf).select("uri", first_line(F.col("content"), 160).alias("snippet"))


def concise_response(spark, sf):
    return concise(grep(documents(spark, sf), LITERAL, max_hits=None)).select("uri", F.col("line_range")[0].alias("line_no"), "kind", "snippet")


# --- terms and ranking -----------------------------------------------------------------------


def tokenize(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(tokenize_column(F.col("text"))).alias("pos", "term"))


def query_terms_(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(query_terms_column(F.col("text"))).alias("pos", "term"))


def _hits(spark, sf) -> DataFrame:
    return as_spans(matching_lines(visible(documents(spark, sf)), F.col("line").rlike(java_pattern(probes(QUERY, TERMS)[0], True))))


def lexical_rank(spark, sf):
    rows = boosted(_hits(spark, sf), QUERY, TERMS)
    return flat(rows, F.round("score", 6).alias("score"), F.col("rank_signals.term_overlap").alias("term_overlap")).drop("snippet")


def rrf_fuse(spark, sf):
    cap = clamp(8 * TOP, 64, 2000)
    rows = fuse(probe_spans(documents(spark, sf), probes(QUERY, TERMS), cap, ast=False), cap)
    return flat(rows, F.round("score", 6).alias("score"))


def search_topk(spark, sf):
    return flat(search(documents(spark, sf), QUERY, TOP), F.round("score", 6).alias("score"))


def delegate_topk(spark, sf):
    found, _ = delegate(documents(spark, sf), QUERY, TOP)
    return found.select("uri", F.col("line_range")[0].alias("line_no"), F.col("byte_range")[0].alias("start"), F.round("score", 6).alias("score"), "snippet")


def delegate_counts(spark, sf):
    return delegate(documents(spark, sf), QUERY, TOP)[1]


def _probe_sql() -> tuple[str, str]:
    names, lists = [], []
    for i, p in enumerate(probes(QUERY, TERMS)):
        cap = clamp(8 * TOP, 64, 2000)
        names.append(f"p{i} AS (SELECT *, row_number() OVER (ORDER BY uri, line_no, start) AS rn FROM l WHERE regexp_matches(line, '(?i){p}') QUALIFY rn <= {cap})")
        lists.append(f"SELECT {FLAT}, rn FROM p{i}")
    return ", ".join(names), " UNION ALL ".join(lists)


_P, _U = _probe_sql()
FUSED = f"{DOCS}, {_P}, f AS (SELECT uri, start, \"end\", min(line_no) AS line_no, min(snippet) AS snippet, sum(CAST(1 AS DOUBLE) / (60 + rn)) AS score FROM ({_U}) GROUP BY uri, start, \"end\" ORDER BY score DESC, uri, start, \"end\" LIMIT {clamp(8 * TOP, 64, 2000)})"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HAY = _ASCII.format("uri || chr(10) || chr(10) || snippet")
_OVER = " + ".join(f"CAST(contains({_HAY}, '{t}') AS INTEGER)" for t in TERMS)
BOOST = f"({_OVER} + CAST(contains({_HAY}, '{QUERY.lower()}') AS INTEGER)) * CAST(0.001 AS DOUBLE)"
FIRST = "left(coalesce(list_filter(string_split({}, chr(10)), lambda v: regexp_replace(v, '\\s+', '', 'g') <> '')[1], ''), {})"
ANY = f"regexp_matches(line, '(?i){probes(QUERY, TERMS)[0]}')"
DELEGATE = f"""{DOCS}, h AS (SELECT * FROM l WHERE {ANY} ORDER BY uri, line_no, start LIMIT {clamp(20 * TOP, 64, 2000)}),
    b AS (SELECT *, CAST(1 AS DOUBLE) + {BOOST} AS score, {_OVER} AS o FROM h ORDER BY score DESC, o DESC, uri, line_no, start LIMIT {TOP})"""


# --- chunks ----------------------------------------------------------------------------------


def chunk_windows(spark, sf):
    return chunks(documents(spark, sf)).select("uri", "start", "end", F.sha2("text", 256).alias("digest"))


_CONT = "coalesce(hex(b[{0} + 1 : {0} + 1]) BETWEEN '80' AND 'BF', false)"
CHUNKS = f"""
    WITH x AS (SELECT 'documents/' || doc_id AS uri, encode(text) AS b, strlen(text) AS n FROM documents WHERE text <> ''),
    s AS (SELECT uri, b, n, unnest(range(0, n, 1000)) AS s FROM x),
    k AS (SELECT * FROM s WHERE NOT {_CONT.format('s')}),
    e AS (SELECT uri, b, n, s, least(s + 1200, n) AS q FROM k),
    m AS (SELECT uri, b, n, s, q + CASE WHEN q >= n OR NOT {_CONT.format('q')} THEN 0 WHEN NOT {_CONT.format('(q + 1)')} THEN 1 WHEN NOT {_CONT.format('(q + 2)')} THEN 2 ELSE 3 END AS e FROM e),
    f AS (SELECT *, coalesce(max(CASE WHEN e >= n THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM m)
    SELECT uri, s AS start, e AS "end", sha256(b[s + 1 : e]) AS digest FROM f WHERE done = 0
"""

# --- vectors ---------------------------------------------------------------------------------

K, PROBE, ROUNDS = 10, 8, 8


def _vectors(spark, sf) -> DataFrame:
    return kmeans.unit_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


def vec_normalize(spark, sf):
    return _vectors(spark, sf).select("doc_id", F.posexplode("vector").alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


def vec_knn_exact(spark, sf):
    """The neighbours of the first vector."""
    rows = _vectors(spark, sf)
    q = rows.orderBy("doc_id").limit(1).select(F.col("doc_id").alias("query_id"), "vector")
    return _scored(knn_batch(rows, q, K))


def vec_knn_batch(spark, sf):
    """The neighbours of every vector."""
    rows = _vectors(spark, sf)
    return _scored(knn_batch(rows, rows.select(F.col("doc_id").alias("query_id"), "vector"), K))


def _scored(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _trained(spark, sf) -> tuple[DataFrame, np.ndarray, DataFrame, DataFrame]:
    rows = _vectors(spark, sf)
    centroids, assigned = kmeans.train(rows, default_k(rows.count()), ROUNDS)
    table_ = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")
    return rows, centroids, assigned, table_


def kmeans_assign(spark, sf):
    return _trained(spark, sf)[2].select("doc_id", "cluster_id")


def kmeans_step(spark, sf):
    return _trained(spark, sf)[3].select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", "i", F.round("x", 6).alias("x"))


def cluster_sizes(spark, sf):
    _, centroids, assigned, _ = _trained(spark, sf)
    return kmeans.sizes(assigned, len(centroids))


def probe_topn(spark, sf):
    rows, _, _, centroids = _trained(spark, sf)
    return probe_clusters(rows.select(F.col("doc_id").alias("query_id"), "vector"), centroids, PROBE).select("query_id", "cluster_id")


def probe_search(spark, sf):
    rows, _, assigned, centroids = _trained(spark, sf)
    return _scored(search_clusters(assigned, centroids, rows.select(F.col("doc_id").alias("query_id"), "vector"), K, PROBE))


def recall_curve(spark, sf):
    rows, _, assigned, centroids = _trained(spark, sf)
    q = rows.select(F.col("doc_id").alias("query_id"), "vector")
    truth, stored = written(knn_batch(rows, q, K), "truth"), stored_clusters(assigned)
    out = None
    for p in (1, 2, 4, 8, 16):
        part = recall(search_clusters(assigned, centroids, q, K, p, stored=stored), truth, K).select(F.lit(p).alias("probe"), F.round("recall", 6).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


def _rounds(rows: str = "n", prefix: str = "") -> str:
    """All rounds of training: a0 and c1 from the seeds s, and so on; at the end the assignment a and the centroids c."""
    out = []
    for i in range(ROUNDS):
        before = f"{prefix}s" if not i else f"{prefix}c{i}"
        out.append(f"""{prefix}a{i} AS MATERIALIZED (SELECT doc_id, v, cluster_id FROM {rows} CROSS JOIN {before} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(list_dot_product(v, c), 12) DESC, cluster_id) = 1),
    {prefix}m{i} AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x) AS x FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM {prefix}a{i}) GROUP BY ALL) GROUP BY cluster_id),
    {prefix}c{i + 1} AS MATERIALIZED (SELECT b.cluster_id, coalesce(list_transform(m.c, lambda x: x / greatest(sqrt(list_dot_product(m.c, m.c)), 1e-12)), b.c) AS c FROM {before} b LEFT JOIN {prefix}m{i} m USING (cluster_id))""")
    return ",\n    ".join(out) + f",\n    {prefix}a AS (SELECT * FROM {prefix}a{ROUNDS - 1}), {prefix}c AS (SELECT * FROM {prefix}c{ROUNDS})"


VEC = f"""
    n AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings),
    kk AS (SELECT CAST(greatest(1, floor(sqrt(count(*)))) AS BIGINT) AS k, count(*) AS n FROM n),
    pos AS (SELECT doc_id, v, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM n),
    s AS (SELECT CAST(i AS INTEGER) AS cluster_id, v AS c FROM (SELECT unnest(range(k)) AS i, n // k AS step, n FROM kk) JOIN pos ON pos = least(i * step, n - 1)),
{_rounds()},
    t AS (SELECT n.doc_id AS query_id, cluster_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY round(list_dot_product(v, c), 9) DESC, cluster_id) AS rn FROM n CROSS JOIN c)
"""
KNN = """SELECT q.doc_id AS query_id, d.doc_id AS doc_id, round(list_dot_product(q.v, d.v), 9) AS s,
    CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_dot_product(q.v, d.v), 9) DESC, d.doc_id) AS INTEGER) AS rank FROM n q CROSS JOIN n d"""
PROBED = """SELECT q.doc_id AS query_id, a.doc_id AS doc_id, round(list_dot_product(q.v, a.v), 9) AS s,
    CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_dot_product(q.v, a.v), 9) DESC, a.doc_id) AS INTEGER) AS rank
    FROM n q JOIN t ON t.query_id = q.doc_id AND rn <= {} JOIN a ON a.cluster_id = t.cluster_id"""


# --- listing, reading ----------------------------------------------------------------


def ls_glob(spark, sf):
    rows = documents(spark, sf).select(F.col("uri").alias("key"), F.octet_length("content").cast("long").alias("size"))
    return ls(glob(rows, "", GLOB), limit=1000)


def read_range(spark, sf):
    return read(documents(spark, sf), "documents/5", 10, 100)


def read_all(spark, sf):
    """Bytes 10 to 110 of every document, and whether they are text."""
    return ranges(documents(spark, sf), 10, 100)


def findings_response(spark, sf):
    return findings(grep(documents(spark, sf), LITERAL, max_hits=None)).select("uri", F.col("byte_range")[0].alias("start"), F.col("byte_range")[1].alias("end"), "snippet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.rstrip("_"): f
    for f in (
        line_scan, grep_literal, grep_ci, grep_alternation, grep_anchor, grep_cap, grep_per_file_cap, grep_hash, grep_pages, grep_conversations, drift, concise_snippet, concise_response,
        findings_response, tokenize, query_terms_, lexical_rank, rrf_fuse, search_topk, delegate_topk, delegate_counts, chunk_windows, vec_normalize, vec_knn_exact, vec_knn_batch, kmeans_assign, kmeans_step,
        cluster_sizes, probe_topn, probe_search, recall_curve, ls_glob, read_range, read_all,
    )
}


def _grep(cte: str, where: str, tail: str = "", cols: str = FLAT) -> str:
    return f"WITH {cte} SELECT {cols} FROM l WHERE {where} {tail}"


def _terms_sql(lower: str, least: int, stop: list[str], most: int, fallback: bool) -> str:
    words = f"list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: strlen(x) >= {least})"
    listed = ", ".join(f"'{s}'" for s in stop)
    kept = f"(s NOT IN ({listed})" + (f" OR NOT list_aggregate(list_transform(w, lambda x: x NOT IN ({listed})), 'bool_or'))" if fallback else ")")
    return f"""WITH t AS (SELECT item_id, list_transform({words}, lambda x: {lower}) AS w FROM benchmark),
    u AS (SELECT item_id, w, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM t),
    d AS (SELECT item_id, s, min(i) AS i FROM u WHERE {kept} GROUP BY item_id, s)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS pos, s AS term FROM d QUALIFY pos < {most}"""


from .functions.text import PLAN_STOP, PLAN_TERMS, SEARCH_STOP, SEARCH_TERMS  # noqa: E402

_TION = "contains(line, 'tion')"
ORACLES: dict[str, str] = {
    "line_scan": f'WITH {DOCS} SELECT uri, line_no, line, start, "end" FROM l',
    "grep_literal": _grep(DOCS, _TION),
    "grep_ci": _grep(DOCS, f"regexp_matches(line, '(?i){FOLDED}')"),
    "grep_alternation": _grep(DOCS, f"regexp_matches(line, '{ALTERNATION}')"),
    "grep_anchor": _grep(DOCS, f"regexp_matches(line, '{ANCHOR}')"),
    "grep_cap": _grep(DOCS, _TION, "ORDER BY uri, line_no, start LIMIT 1000"),
    "grep_per_file_cap": _grep(DOCS, _TION, "QUALIFY row_number() OVER (PARTITION BY uri ORDER BY line_no) <= 2"),
    "grep_hash": f"WITH {DOCS} SELECT {FLAT}, 'sha256:' || sha256(content) AS content_hash FROM l JOIN x USING (uri) WHERE {_TION}",
    "grep_pages": _grep(PAGES, "regexp_matches(line, '<(p|h1|title)')"),
    "grep_conversations": _grep(TALK, f"regexp_matches(line, '{ALTERNATION}')"),
    "drift": f"WITH {DOCS} SELECT {FLAT} FROM l JOIN x USING (uri) WHERE {_TION} AND strlen(content) % 2 = 1",
    "concise_snippet": f"SELECT 'documents/' || doc_id AS uri, {FIRST.format('text', 160)} AS snippet FROM documents",
    "concise_response": f"WITH {DOCS} SELECT uri, line_no, 'line' AS kind, {FIRST.format('snippet', 160)} AS snippet FROM l WHERE {_TION}",
    "findings_response": f'WITH {DOCS} SELECT uri, start, "end", {FIRST.format("snippet", 240)} AS snippet FROM l WHERE {_TION}',
    "tokenize": _terms_sql("lower(x)", 3, sorted(PLAN_STOP), PLAN_TERMS, False),
    "query_terms": _terms_sql(_ASCII.format("x"), 2, sorted(SEARCH_STOP), SEARCH_TERMS, True),
    "lexical_rank": f'WITH {DOCS} SELECT uri, line_no, start, "end", round(CAST(1 AS DOUBLE) + {BOOST}, 6) AS score, {_OVER} AS term_overlap FROM l WHERE {ANY}',
    "rrf_fuse": f'WITH {FUSED} SELECT uri, line_no, start, "end", snippet, round(score, 6) AS score FROM f',
    "search_topk": f'WITH {FUSED} SELECT uri, line_no, start, "end", snippet, round(score + {BOOST}, 6) AS score FROM f ORDER BY score + {BOOST} DESC, {_OVER} DESC, uri, line_no, start LIMIT {TOP}',
    "delegate_topk": f"WITH {DELEGATE} SELECT uri, line_no, start, round(score, 6) AS score, {FIRST.format('snippet', 240)} AS snippet FROM b",
    "delegate_counts": f"WITH {DELEGATE}, g AS (SELECT uri, count(*) AS n FROM b GROUP BY uri) SELECT sum(n)::BIGINT || ' match(es) for \"{QUERY}\": ' || string_agg(n || ' in ' || uri, ', ' ORDER BY uri) AS summary FROM g",
    "chunk_windows": CHUNKS,
    "vec_normalize": f"WITH {VEC} SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n)",
    "vec_knn_exact": f"WITH {VEC} SELECT query_id, doc_id, round(s, 6) AS score, rank FROM ({KNN}) WHERE rank <= {K} AND query_id = (SELECT min(doc_id) FROM n)",
    "vec_knn_batch": f"WITH {VEC} SELECT query_id, doc_id, round(s, 6) AS score, rank FROM ({KNN}) WHERE rank <= {K}",
    "kmeans_assign": f"WITH {VEC} SELECT doc_id, cluster_id FROM a",
    "kmeans_step": f"WITH {VEC} SELECT cluster_id, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT cluster_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c)",
    "cluster_sizes": f"WITH {VEC} SELECT s.cluster_id, count(a.doc_id) AS n FROM s LEFT JOIN a USING (cluster_id) GROUP BY s.cluster_id",
    "probe_topn": f"WITH {VEC} SELECT query_id, cluster_id FROM t WHERE rn <= {PROBE}",
    "probe_search": f"WITH {VEC} SELECT query_id, doc_id, round(s, 6) AS score, rank FROM ({PROBED.format(PROBE)}) WHERE rank <= {K}",
    "recall_curve": f"WITH {VEC}, truth AS (SELECT query_id, doc_id FROM ({KNN}) WHERE rank <= {K}) "
    + " UNION ALL ".join(
        f"SELECT {p} AS probe, round((SELECT count(*) FROM truth JOIN (SELECT query_id, doc_id FROM ({PROBED.format(p)}) WHERE rank <= {K}) USING (query_id, doc_id)) / ({K}.0 * (SELECT count(*) FROM n)), 6) AS recall"
        for p in (1, 2, 4, 8, 16)
    ),
    "ls_glob": "SELECT 'documents/' || doc_id AS key, strlen(text) AS size FROM documents WHERE regexp_matches('documents/' || doc_id, '^documents/.*7$') ORDER BY key LIMIT 1000",
    "read_range": "SELECT 'documents/5' AS uri, CAST(octet_length(encode(text)[11:110]) AS BIGINT) AS bytes, try(decode(encode(text)[11:110])) AS text FROM documents WHERE doc_id = 5",
    "read_all": "SELECT 'documents/' || doc_id AS uri, CAST(octet_length(encode(text)[11:110]) AS BIGINT) AS bytes, try(decode(encode(text)[11:110])) AS text FROM documents",
}

from . import queries_more  # noqa: E402

QUERIES |= queries_more.QUERIES
ORACLES |= queries_more.ORACLES

__all__ = ["ORACLES", "QUERIES", "documents"]
