"""More queries: stores, sinks, definitions, indexes, streams and plans, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoint import shared_folder
from .errors import IndexError_
from .functions.text import any_of, case_variants, java_pattern, query_terms, regex_escape_column, symbol_pattern, tokenize
from .marked import CODE, DEFINITIONS
from .operators.containers import LANGUAGES, language_column, with_containers
from .operators.grep import grep, legacy_hits, visible
from .operators.ranking import boosted
from .operators.spans import distinct_spans, printed
from .operators.vectors import hit_spans, knn_batch, ranking_metrics
from .plans.index import VectorIndex, build_from_vectors, build_index, index, index_path
from .plans.search import find, grep_verb, hybrid, search, search_within, stage_table, summary_text
from .queries import _ASCII, CHUNKS, DOCS, FIRST, FLAT, KNN, LINES, LITERAL, PROBE, QUERY, VEC, _rounds, _vectors, documents, flat, pages, table
from .schema import span_json, spans_from_json
from .sources.codecs import decode_centroids, decode_clusters, encode_centroids, encode_clusters, read_vecs, write_vecs
from .sources.files import where, write_files
from .sources.manifest import list_with_manifest, read_manifest, write_manifest
from .sources.store import CorpusCache, Store, join_uri_column, open_store, text_files, uri_columns
from .streaming.incremental import append, changed, follow, removed


def _folder(spark: SparkSession, name: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


# --- addresses, stores, manifests, caches --------------------------------------------------------

_URI = "CASE doc_id % 5 WHEN 0 THEN 's3://bucket-' || lang || '/docs/' || doc_id WHEN 1 THEN 'file:///docs//' || doc_id WHEN 2 THEN 'gs://' || source WHEN 3 THEN 'r2://b/a://' || doc_id ELSE 'docs/' || doc_id END"


def uri_parse(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_URI).alias("uri"))
    return rows.select("doc_id", *uri_columns(F.col("uri")), join_uri_column(F.concat("uri", F.lit("//")), F.concat(F.lit("/"), "doc_id")).alias("joined"))


def _paths(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.expr(_PATH).alias("uri"), F.col("text").alias("content"))


_PATH = "CASE doc_id % 6 WHEN 0 THEN '.git/' WHEN 1 THEN 'a/.hidden/' WHEN 2 THEN 'a/./' WHEN 3 THEN 'a..b/' WHEN 4 THEN 'a/' ELSE '' END || doc_id"


def visible_files(spark, sf):
    return visible(_paths(spark, sf), 2000).select("uri")


def _store(spark, sf) -> Store:
    """Every page as a file of its own; a hidden and an empty one are among them."""
    root = _folder(spark, "store")
    write_files(pages(spark, sf).select(F.concat("uri", F.lit(".html")).alias("uri"), "content"), where(root))
    store, prefix = open_store(spark, root)
    assert not prefix
    store.put("pages/.hidden/x", b"hidden")
    store.put("pages/empty.html", b"")
    store.put("gone", b"gone")
    store.delete("gone")
    return store


_FILES = "SELECT 'pages/' || page_id || '.html' AS key, encode(html) AS raw FROM pages UNION ALL SELECT 'pages/.hidden/x', encode('hidden') UNION ALL SELECT 'pages/empty.html', encode('')"


def store_list(spark, sf):
    return _store(spark, sf).list("pages").select("key", "size")


def store_corpus(spark, sf):
    return _store(spark, sf).corpus().select("uri", F.sha2("content", 256).alias("digest"))


def store_text(spark, sf):
    """The files that the index verb would take."""
    return text_files(_store(spark, sf).corpus(), "pages/*.html", 3000).select("uri", F.octet_length("content").cast("long").alias("size"))


def manifest_list(spark, sf):
    store = _store(spark, sf)
    write_manifest(store)
    return list_with_manifest(store).select("key", "size")


def manifest_head(spark, sf):
    store = _store(spark, sf)
    write_manifest(store, "pages")
    head, entries = read_manifest(store, "pages")
    return entries.agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")).select("entries", "bytes", F.lit(head["count"]).cast("long").alias("counted"), F.lit(head["prefix"]).alias("prefix"))


def corpus_cache(spark, sf):
    """Contents by way of the cache after every other page has changed."""
    store = _store(spark, sf)
    cache = CorpusCache(store, _folder(spark, "cache"))
    cache.corpus("pages").count()
    even = table(spark, sf, "pages").where("page_id % 2 = 0")
    write_files(even.select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("uri"), F.concat("html", F.lit("<!-- new -->")).alias("content")), where(store.root))
    return cache.corpus("pages").select("uri", F.sha2("content", 256).alias("digest"))


_ETAG = "md5(text)"


def changed_files(spark, sf):
    """Listings of documents before and after: those of even numbers have changed, every seventh is new and every eleventh gone."""
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("key"), F.octet_length("text").cast("long").alias("size"), F.expr(_ETAG).alias("etag"), F.lit(1).cast("long").alias("last_modified"), "doc_id")
    now = rows.where("doc_id % 11 <> 0").withColumn("etag", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE etag END")).drop("doc_id")
    before = rows.where("doc_id % 7 <> 0").drop("doc_id")
    return changed(now, before).select("key", F.lit("changed").alias("what")).unionByName(removed(now, before).select("key", F.lit("removed").alias("what")))


def cluster_codec(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7).cast("int").alias("cluster_id"))
    dim = rows.select(F.max(F.size("vector"))).first()[0]
    back = decode_clusters(encode_clusters(rows), dim)
    return back.select("cluster_id", "doc_id", F.posexplode("vector").alias("i", "x")).select("cluster_id", "doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def centroid_codec(spark, sf):
    """The first vectors of each label by way of the centroids' bytes: one matrix of as many rows as there are labels."""
    rows = table(spark, sf, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()
    dim = len(rows[0].v)
    back = decode_centroids(encode_centroids([r.v for r in rows]), dim, len(rows))
    return spark.createDataFrame([(i, j, round(float(x), 6)) for i, r in enumerate(back) for j, x in enumerate(r)], "i int, j int, x double")


def vecs_round_trip(spark, sf):
    root = _folder(spark, "vecs")
    write_vecs(table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")), root)
    return read_vecs(spark, root, rows=100).select("pos", F.posexplode("vector").alias("i", "x")).select("pos", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


# --- patterns and sinks --------------------------------------------------------------------------

PATTERNS = [
    ("abc", True), ("a(?i)B", True), ("(?P<n>abc)", True), (r"\x{61}bc", True), ("[[:digit:]]+", True), ("a{,2}", True), (r"\p{Greek}", True), ("(", False), ("[a", False), ("a{2", False), ("a)", False), ("(?=a)", False),
    (r"(a)\1", False), ("(?<!a)b", False), ("(?>a)", False), ("a++", False), ("*a", False), (r"\Qa", False), (r"\h", False), ("(?z)a", False), ("[z-a]", False), ("a|b|", True), ("", True), (r"\u{1F600}", True),
]


def valid_patterns(spark, sf):
    def ok(pattern: str) -> bool:
        try:
            java_pattern(pattern)
        except IndexError_:
            return False
        return True

    return spark.createDataFrame([(i, ok(p)) for i, (p, _) in enumerate(PATTERNS)], "i int, ok boolean")


def grep_posix(spark, sf):
    return flat(grep(documents(spark, sf), r"[[:digit:]]{2,}[[:space:][:punct:]]|(?P<cap>\b[[:upper:]]{3})", max_hits=None))


def grep_flags(spark, sf):
    return flat(grep(documents(spark, sf), r"T(?i)ION\b|\x{45}n(?-i)[a-z&&[^aeiou]]", max_hits=None))


def grep_clamped(spark, sf):
    return flat(grep_verb(documents(spark, sf), LITERAL, max_hits=0))


def _all(spark, sf) -> DataFrame:
    return grep(documents(spark, sf), LITERAL, max_hits=None)


def text_sink(spark, sf):
    return printed(_all(spark, sf))


def json_sink(spark, sf):
    return span_json(_all(spark, sf))


def json_round_trip(spark, sf):
    return flat(spans_from_json(span_json(_all(spark, sf))), "truncated", F.round("score", 6).alias("score"))


def legacy_sink(spark, sf):
    return legacy_hits(_all(spark, sf)).select("id", "uri", F.round("score", 6).alias("score"), "snippet", "metadata")


def summaries(spark, sf):
    rows = [("grep", grep_verb(code(spark), "TODO last")), ("find", find(code(spark), "open_lid")), ("ls", documents(spark, sf)), ("read", b"12345"), ("delegate", "2 match(es)"), ("index", None)]
    return spark.createDataFrame([(tool, summary_text(tool, result)) for tool, result in rows], "tool string, summary string")


def distinct_hits(spark, sf):
    """Hits of two patterns, the second of a higher score; one span stays for each place."""
    both = _all(spark, sf).unionByName(grep(documents(spark, sf), "ation", max_hits=None).withColumn("score", F.lit(2.0)))
    return flat(distinct_spans(both), F.round("score", 6).alias("score"))


def escaped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", regex_escape_column(F.col("text")).alias("pattern"))


NAMES = ["openLid", "open_lid", "HTTPServer", "x", "getURLPath", "MAX_SIZE", "kebab-case-name", "dotted.name:here", "a1B2", "", "plain", "parseHTML5Doc", "__init__"]


def symbol_names(spark, sf):
    """The case styles of names, and the pattern for them."""
    rows = [(n, i, v, symbol_pattern([v])) for n in NAMES for i, v in enumerate(case_variants(n))]
    return spark.createDataFrame(rows, "name string, i int, style string, pattern string")


_SUFFIX = ["rs", "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "md", "RS", "txt", ""]


def languages(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("doc_id") % len(_SUFFIX) + 1).cast("int"))
    uri = F.concat(F.lit("a.b/"), "source", F.lit("."), suffix)
    return table(spark, sf, "documents").select("doc_id", language_column(uri).alias("language"))


# --- definitions -----------------------------------------------------------------------------------


def code(spark: SparkSession) -> DataFrame:
    """No shared table holds source code; this corpus does."""
    return spark.createDataFrame(CODE, "uri string, content string")


def code_definitions(spark, sf):
    rows = with_containers(code(spark)).where("containers IS NOT NULL").select("uri", F.explode("containers").alias("c"))
    return rows.select("uri", "c.*")


def widen_code(spark, sf):
    return flat(grep_verb(code(spark), "TODO", ast=True), "symbol", "kind", "source_stage")


def find_symbol(spark, sf):
    return flat(find(code(spark), "open_lid"), "symbol", "kind")


CODE_QUERY = "todo open_lid inside"


def rank_symbols(spark, sf):
    rows = boosted(grep_verb(code(spark), "TODO", ast=True), CODE_QUERY, query_terms(CODE_QUERY))
    return flat(rows, F.round("score", 6).alias("score"), F.col("rank_signals.term_overlap").alias("term_overlap")).drop("snippet")


def search_empty(spark, sf):
    none = search(documents(spark, sf), " .. ", 20).unionByName(search(documents(spark, sf), QUERY, 0))
    return none.select("uri", "snippet")


# --- indexes, plans and streams ---------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(rows: DataFrame) -> DataFrame:
    """An embedder that SQL can follow: how often each letter occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # letters are single bytes, which occur in no character of several
            n = np.array([np.bincount(np.frombuffer(t or b"", np.uint8), minlength=256) for t in batch.column(1).to_pylist()], float).reshape(-1, 256)
            n = n[:, ord("a") : ord("z") + 1] + n[:, ord("A") : ord("Z") + 1]
            none = np.repeat(batch.column(1).is_null().to_numpy(zero_copy_only=False), len(LETTERS))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(LETTERS)), pa.array(n.ravel(), mask=none))
            yield pa.record_batch([batch.column(0), flat], names=["id", "vector"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, vector array<double>")


_built: dict[tuple, str] = {}


def _once(spark: SparkSession, name: str, sf: str, build: Callable[[str], object]) -> str:
    """The path of an index that is built once a session."""
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _built:
        path = _folder(spark, name)
        build(path)
        _built[key] = path
    return _built[key]


def _documents_index(spark, sf) -> VectorIndex:
    return VectorIndex(spark, _once(spark, "documents-index", sf, lambda path: build_index(documents(spark, sf), path, letters)))


def index_search(spark, sf):
    """The neighbours of every vector by way of an index of all of them."""
    rows = _vectors(spark, sf)
    docs = rows.select("doc_id", F.lit("v").alias("uri"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long")).alias("byte_range"), F.lit("").alias("snippet"))
    path = _once(spark, "vector-index", sf, lambda at: build_from_vectors(rows, docs, at))
    found = VectorIndex(spark, path).search(rows.select(F.col("doc_id").alias("query_id"), "vector"), 10, PROBE, exact=True)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def index_manifest(spark, sf):
    m = _documents_index(spark, sf).manifest
    return spark.createDataFrame([(m["version"], m["dim"], m["k"], m["num_docs"], i, n) for i, n in enumerate(m["cluster_sizes"])], "version int, dim int, k int, num_docs long, cluster_id int, n long")


def index_text(spark, sf):
    """The nearest chunks of every benchmark passage, as spans."""
    held = _documents_index(spark, sf)
    found = held.search_text(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5, PROBE, letters)
    rows = hit_spans(found, held.docs)
    return rows.select("query_id", "rank", "uri", F.col("byte_range.start").alias("start"), F.col("byte_range.end").alias("end"), F.round("score", 6).alias("score"), "kind", "source_stage", F.sha2("snippet", 256).alias("digest"))


def hybrid_fuse(spark, sf):
    result = hybrid(documents(spark, sf), QUERY, _documents_index(spark, sf), 10, PROBE, 600_000, 600_000, letters)
    return result.spans.select("uri", F.col("byte_range.start").alias("start"), F.col("byte_range.end").alias("end"), F.round("score", 6).alias("score"))


def hybrid_stages(spark, sf):
    result = hybrid(documents(spark, sf), QUERY, _documents_index(spark, sf), 10, PROBE, 600_000, 600_000, letters)
    return stage_table(spark, result.stages).select("stage", "hits", "dropped")


def budget_dropped(spark, sf):
    """Stages without any time are left out, and say so."""
    late = hybrid(documents(spark, sf), QUERY, None, 10, PROBE, 0, 0, letters).stages + search_within(documents(spark, sf), QUERY, 5, False, 0).stages
    return stage_table(spark, late).select("stage", "hits", "dropped")


def index_verb(spark, sf):
    """What the index verb takes of a store: pages that are no larger than 3000 bytes."""
    store = _store(spark, sf)
    index(store, "pages", "html", "pages/*.html", 3000, embedder=letters, iters=1)
    docs = VectorIndex(spark, index_path(store, "html")).docs
    return docs.select("uri", F.col("byte_range")[0].alias("start"), F.col("byte_range")[1].alias("end"))


def index_append(spark, sf):
    """An index of the even documents, to which the odd ones are added twice, as a stream does that starts again, and then
    every tenth document, changed. A file's last chunks count."""
    rows = documents(spark, sf)
    number = F.substring("uri", 11, 20).cast("long")
    path = _folder(spark, "appended")
    build_index(rows.where(number % 2 == 0), path, letters, iters=1)
    for _ in range(2):
        append(path, rows.where(number % 2 == 1), letters, 1)
    append(path, rows.where(number % 10 == 0).withColumn("content", F.concat("content", F.lit(" more"))), letters)
    held = VectorIndex(spark, path)
    return held.docs.join(held.clusters.select("doc_id"), "doc_id").select("uri", F.col("byte_range")[0].alias("start"), F.col("byte_range")[1].alias("end"))


def index_stream(spark, sf):
    """Pages that a stream adds to an index of documents as files appear, in two runs."""
    path, folder, checkpoint = _folder(spark, "streamed"), _folder(spark, "incoming"), _folder(spark, "stream-checkpoint")
    build_index(documents(spark, sf).where("uri = 'documents/0'"), path, letters, 1, 1)
    for part in (0, 1):
        rows = pages(spark, sf).where(F.substring("uri", 7, 20).cast("long") % 2 == part)
        write_files(rows.select(F.concat("uri", F.lit(".html")).alias("uri"), "content"), where(folder))
        follow(spark, folder, path, checkpoint, letters).awaitTermination()
    docs = VectorIndex(spark, path).docs.where("batch > 0")
    return docs.select(F.regexp_extract("uri", "(pages/.*)$", 1).alias("uri"), F.col("byte_range")[0].alias("start"), F.col("byte_range")[1].alias("end"))


def rank_metrics(spark, sf):
    """MRR, NDCG and recall at 10 of the exact neighbours, where the right answer to a vector is the one whose number is the next but one."""
    rows = _vectors(spark, sf)
    found = knn_batch(rows, rows.select(F.col("doc_id").alias("query_id"), "vector"), 10).select("query_id", F.col("doc_id").cast("string").alias("uri"), "rank")
    gold = rows.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 2).cast("string").alias("uri"))
    return ranking_metrics(found, gold).select(*[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "recall")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        uri_parse, visible_files, store_list, store_corpus, store_text, manifest_list, manifest_head, corpus_cache, changed_files, cluster_codec, centroid_codec, vecs_round_trip, valid_patterns, grep_posix, grep_flags,
        grep_clamped, text_sink, json_sink, json_round_trip, legacy_sink, summaries, distinct_hits, escaped, symbol_names, languages, code_definitions, widen_code, find_symbol, rank_symbols, search_empty, index_search,
        index_manifest, index_text, hybrid_fuse, hybrid_stages, budget_dropped, index_verb, index_append, index_stream, rank_metrics,
    )
}


# --- SQL -------------------------------------------------------------------------------------------


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_CODE = "x0(uri, content) AS (VALUES " + ", ".join(f"({_text(u)}, {_text(c)})" for u, c in CODE) + "), d(uri, s, e, f, g, symbol, kind) AS (VALUES " + ", ".join(
    f"({_text(u)}, {s}, {e}, {f}, {g}, {_text(n)}, {_text(k)})" for u, s, e, f, g, n, k in DEFINITIONS
) + "), " + LINES.format(uri="uri", text="content", table="x0")


def _widened(pattern: str) -> str:
    """Hits of a pattern in the marked code, widened by a join with the marks."""
    return f"""{_CODE}, h AS (SELECT l.*, start + strlen(line) - strlen(ltrim(line, ' ' || chr(9) || chr(13))) AS p, content FROM l JOIN x USING (uri) WHERE regexp_matches(line, '{pattern}')),
    j AS (SELECT h.*, d.s, d.e, d.f, d.symbol, d.kind FROM h LEFT JOIN d ON d.uri = h.uri AND d.s <= h.p AND h.p < d.e QUALIFY row_number() OVER (PARTITION BY h.uri, h.line_no ORDER BY d.s DESC NULLS LAST, d.e) = 1),
    w AS (SELECT DISTINCT uri, CAST(coalesce(f, line_no) AS INTEGER) AS line_no, CAST(coalesce(s, start) AS BIGINT) AS start, CAST(coalesce(e, "end") AS BIGINT) AS "end",
          CASE WHEN s IS NULL THEN snippet ELSE left(decode(encode(content)[s + 1 : e]), 800) END AS snippet, symbol, coalesce(kind, 'line') AS kind, CASE WHEN s IS NULL THEN 'grep' ELSE 'ast' END AS source_stage FROM j)"""


def _styles(name: str) -> list[str]:
    """The case styles by another route than the library's: a character at a time."""
    if len(name) < 2:
        return [name]
    words, now = [], ""
    for i, c in enumerate(name):
        if c in "_-.:":
            words, now = [*words, now], ""
            continue
        after = name[i + 1 : i + 2]
        hump = c.isupper() and now and ((now[-1].islower() or now[-1].isdigit()) or (now[-1].isupper() and after.islower()))
        words, now = ([*words, now], c) if hump else (words, now + c)
    words = [w.lower() for w in [*words, now] if w]
    if not words:
        return [name]
    title = "".join(w.capitalize() for w in words)
    out = []
    for v in (name, "_".join(words), "-".join(words), "_".join(words).upper(), words[0] + title[len(words[0]) :], title):
        out += [v] if v not in out else []
    return out


_HAY = f"{_ASCII.format('uri')} || chr(10) || {_ASCII.format(chr(34) + 'sym' + chr(34))} || chr(10) || {_ASCII.format('snippet')}"
_CODE_TERMS = query_terms(CODE_QUERY)
_OVERLAP = " + ".join(f"CAST(contains(hay, '{t}') AS INTEGER)" for t in _CODE_TERMS)
_IN_SYMBOL = " + ".join(f"CAST(contains({_ASCII.format('sym')}, '{t}') AS INTEGER)" for t in _CODE_TERMS)
# other names than those of the lines
_CHUNK_CTE = re.sub(r"\b([xskemf])(?= AS \()|(?<=FROM )([xskemf])\b", r"c\1\2", CHUNKS[: CHUNKS.index("SELECT uri, s AS start")].strip().removeprefix("WITH").rstrip())
_PAGES_CTE = _CHUNK_CTE.replace("'documents/' || doc_id", "'pages/' || page_id || '.html'").replace("text", "html").replace("FROM documents", "FROM pages")
_LETTER = "[" + ", ".join(f"CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"
_UNIT = "list_transform(raw, lambda x: x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12))"
_INDEX = f"""{_CHUNK_CTE},
    ch AS MATERIALIZED (SELECT uri, s AS start, e AS "end", decode(b[s + 1 : e]) AS text, row_number() OVER (ORDER BY uri, s) - 1 AS doc_id FROM cf WHERE done = 0),
    n0 AS MATERIALIZED (SELECT doc_id, {_UNIT} AS v FROM (SELECT doc_id, {_LETTER} AS raw FROM (SELECT doc_id, {_ASCII.format("text")} AS t FROM ch))),
    xkk AS (SELECT CAST(greatest(1, floor(sqrt(count(*)))) AS BIGINT) AS k, count(*) AS n FROM n0),
    xs AS (SELECT CAST(i AS INTEGER) AS cluster_id, v AS c FROM (SELECT unnest(range(k)) AS i, n // k AS step, n FROM xkk) JOIN n0 ON doc_id = least(i * step, n - 1)),
    {_rounds("n0", "x")}"""


def _near(queries: str, k: int) -> str:
    """The nearest chunks in the probed clusters, for ``q0(query_id, t)``."""
    return f"""q0 AS ({queries}), qv AS (SELECT query_id, {_UNIT} AS q FROM (SELECT query_id, {_LETTER} AS raw FROM q0)),
    qt AS (SELECT query_id, q, cluster_id FROM qv CROSS JOIN xc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 9) DESC, cluster_id) <= {PROBE}),
    near AS (SELECT query_id, doc_id, round(list_dot_product(q, CAST(CAST(v AS FLOAT[]) AS DOUBLE[])), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, CAST(CAST(v AS FLOAT[]) AS DOUBLE[])), 9) DESC, doc_id) AS INTEGER) AS rank
             FROM qt JOIN xa USING (cluster_id) QUALIFY rank <= {k})"""


_HYBRID = f"""WITH {DOCS}, {_INDEX}, {_near(f"SELECT 0 AS query_id, {_ASCII.format(_text(QUERY))} AS t", 20)},
    gl AS (SELECT uri, start, "end", row_number() OVER (ORDER BY uri, line_no, start) AS rank FROM l WHERE regexp_matches(line, '(?i){any_of(tokenize(QUERY))}') QUALIFY rank <= 40),
    vl AS (SELECT uri, start, "end", rank FROM near JOIN ch USING (doc_id))"""
_TION = "contains(line, 'tion')"
_MORE = "CASE WHEN doc_id % 10 = 0 THEN text || ' more' ELSE text END"
_APPENDED = _CHUNK_CTE.replace("encode(text) AS b, strlen(text) AS n", f"encode({_MORE}) AS b, strlen({_MORE}) AS n")

ORACLES: dict[str, str] = {
    "uri_parse": f"""WITH u AS (SELECT doc_id, {_URI} AS uri FROM documents), p AS (SELECT *, strpos(uri, '://') AS colon FROM u), r AS (SELECT *, CASE WHEN colon > 0 THEN uri[1 : colon - 1] END AS scheme, CASE WHEN colon > 0 THEN uri[colon + 3 :] END AS rest FROM p)
        SELECT doc_id, scheme, CASE WHEN scheme <> 'file' THEN split_part(rest, '/', 1) END AS authority, CASE WHEN scheme = 'file' THEN rest ELSE CASE WHEN contains(rest, '/') THEN rest[strpos(rest, '/') + 1 :] WHEN rest IS NOT NULL THEN '' END END AS key,
        rtrim(uri, '/') || '/' || doc_id AS joined FROM r""",
    "visible_files": f"SELECT uri FROM (SELECT {_PATH} AS uri, text FROM documents) WHERE strlen(text) <= 2000 AND NOT list_bool_or(list_transform(string_split(uri, '/'), lambda x: x[1] = '.' AND length(x) > 1))",
    "store_list": f"SELECT key, octet_length(raw) AS size FROM ({_FILES})",
    "store_corpus": f"SELECT key AS uri, sha256(raw) AS digest FROM ({_FILES})",
    "store_text": f"SELECT key AS uri, octet_length(raw) AS size FROM ({_FILES}) WHERE octet_length(raw) BETWEEN 1 AND 3000 AND ends_with(key, '.html')",
    "manifest_list": f"SELECT key, octet_length(raw) AS size FROM ({_FILES})",
    "manifest_head": f"SELECT count(*) AS entries, CAST(sum(octet_length(raw)) AS BIGINT) AS bytes, count(*) AS counted, 'pages' AS prefix FROM ({_FILES})",
    "corpus_cache": f"SELECT key AS uri, sha256(CASE WHEN TRY_CAST(regexp_extract(key, '/([0-9]+)[.]', 1) AS BIGINT) % 2 = 0 THEN raw || encode('<!-- new -->') ELSE raw END) AS digest FROM ({_FILES})",
    "changed_files": "SELECT 'd/' || doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'changed' END AS what FROM documents WHERE (doc_id % 11 <> 0 AND (doc_id % 2 = 0 OR doc_id % 7 = 0)) OR (doc_id % 11 = 0 AND doc_id % 7 <> 0)",
    "cluster_codec": "SELECT CAST(vec_id % 7 AS INTEGER) AS cluster_id, vec_id AS doc_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "centroid_codec": "SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label))",
    "vecs_round_trip": "SELECT row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS pos, CAST(i - 1 AS INTEGER) AS i, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)",
    "valid_patterns": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {ok})" for i, (_, ok) in enumerate(PATTERNS)) + ") AS t(i, ok)",
    "grep_posix": f"WITH {DOCS} SELECT {FLAT} FROM l WHERE regexp_matches(line, '[[:digit:]]{{2,}}[[:space:][:punct:]]') OR list_bool_or(list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z]{{3}}')))",
    "grep_flags": f"WITH {DOCS} SELECT {FLAT} FROM l WHERE list_bool_or(list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_matches(w, 'T(?i:ion)$'))) OR regexp_matches(line, '(?i:En)[b-df-hj-np-tv-z]')",
    "grep_clamped": f"WITH {DOCS} SELECT {FLAT} FROM l WHERE {_TION} ORDER BY uri, line_no, start LIMIT 1",
    "text_sink": f"WITH {DOCS} SELECT uri || ':' || line_no || '-' || line_no || ' [Line]' || chr(9) || {FIRST.format('snippet', 1 << 20)} AS line FROM l WHERE {_TION}",
    "json_sink": f"""WITH {DOCS} SELECT '{{"uri":"' || uri || '","byte_range":{{"start":' || start || ',"end":' || "end" || '}},"line_range":[' || line_no || ',' || line_no || '],"kind":"line","snippet":' || to_json(snippet) || ',"score":1.0,"source_stage":"grep"}}' AS json FROM l WHERE {_TION}""",
    "json_round_trip": f"WITH {DOCS} SELECT {FLAT}, false AS truncated, CAST(1 AS DOUBLE) AS score FROM l WHERE {_TION}",
    "legacy_sink": f"""WITH {DOCS} SELECT uri || ':' || line_no AS id, uri, CAST(1 AS DOUBLE) AS score, snippet, '{{"line":' || line_no || ',"start":' || start || ',"end":' || "end" || '}}' AS metadata FROM l WHERE {_TION}""",
    "summaries": "SELECT * FROM (VALUES ('grep', '1 span'), ('find', '5 spans'), ('read', '5 bytes'), ('delegate', '2 match(es)'), ('index', 'ok')) AS t(tool, summary) UNION ALL SELECT 'ls', count(*) || CASE WHEN count(*) = 1 THEN ' entry' ELSE ' entries' END FROM documents",
    "distinct_hits": f"WITH {DOCS} SELECT {FLAT}, CAST(CASE WHEN contains(line, 'ation') THEN 2 ELSE 1 END AS DOUBLE) AS score FROM l WHERE {_TION}",
    "escaped": "SELECT doc_id, regexp_replace(text, '([.+*?()|\\[\\]{}^$\\\\/])', '\\\\\\1', 'g') AS pattern FROM documents",
    "symbol_names": "SELECT * FROM (VALUES " + ", ".join(f"({_text(n)}, {i}, {_text(v)}, {_text(chr(92) + 'b' + v.replace('.', chr(92) + '.') + chr(92) + 'b')})" for n in NAMES for i, v in enumerate(_styles(n))) + ") AS t(name, i, style, pattern)",
    "languages": f"SELECT doc_id, CASE lower([{', '.join(map(_text, _SUFFIX))}][doc_id % {len(_SUFFIX)} + 1]) " + " ".join(f"WHEN {_text(s)} THEN {_text(n)}" for s, n in LANGUAGES.items()) + " END AS language FROM documents",
    "code_definitions": f'WITH {_CODE} SELECT uri, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(f AS INTEGER) AS first, CAST(g AS INTEGER) AS last, symbol, kind FROM d',
    "widen_code": f"WITH {_widened('TODO')} SELECT * FROM w",
    "find_symbol": f"WITH {_widened('|'.join(chr(92) + 'b' + v + chr(92) + 'b' for v in _styles('open_lid')))} SELECT {FLAT}, symbol, kind FROM w WHERE symbol IN ({', '.join(map(_text, _styles('open_lid')))})",
    "rank_symbols": f"""WITH {_widened('TODO')}, v AS (SELECT *, coalesce(symbol, '') AS sym FROM w), o AS (SELECT *, {_HAY} AS hay FROM v)
        SELECT uri, line_no, start, "end", round(CAST(1 AS DOUBLE) + 0.001 * ({_OVERLAP} + 0.75 * ({_IN_SYMBOL}) + CAST(contains(hay, '{CODE_QUERY}') AS INTEGER)), 6) AS score, {_OVERLAP} AS term_overlap FROM o""",
    "search_empty": "SELECT 'x' AS uri, 'x' AS snippet WHERE false",
    "index_search": f"""WITH {VEC} SELECT * FROM (SELECT n.doc_id AS query_id, a.doc_id, round(list_dot_product(n.v, CAST(CAST(a.v AS FLOAT[]) AS DOUBLE[])), 6) AS score, CAST(row_number() OVER (PARTITION BY n.doc_id ORDER BY round(list_dot_product(n.v, CAST(CAST(a.v AS FLOAT[]) AS DOUBLE[])), 9) DESC, a.doc_id) AS INTEGER) AS rank
        FROM n JOIN t ON t.query_id = n.doc_id AND rn <= {PROBE} JOIN a ON a.cluster_id = t.cluster_id) WHERE rank <= 10""",
    "index_manifest": f"WITH {_INDEX} SELECT 1 AS version, 26 AS dim, CAST(k AS INTEGER) AS k, xkk.n AS num_docs, xs.cluster_id, count(xa.doc_id) AS n FROM xs CROSS JOIN xkk LEFT JOIN xa ON xa.cluster_id = xs.cluster_id GROUP BY ALL",
    "index_text": f"""WITH {_INDEX}, {_near(f"SELECT item_id AS query_id, {_ASCII.format('text')} AS t FROM benchmark", 5)}
        SELECT query_id, rank, uri, start, "end", round(score, 6) AS score, 'block' AS kind, 'vector' AS source_stage, sha256(left(text, 280)) AS digest FROM near JOIN ch USING (doc_id)""",
    "hybrid_fuse": f'{_HYBRID} SELECT uri, start, "end", round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score FROM (SELECT * FROM gl UNION ALL SELECT * FROM vl) GROUP BY uri, start, "end" ORDER BY sum(CAST(1 AS DOUBLE) / (60 + rank)) DESC, uri, start, "end" LIMIT 10',
    "hybrid_stages": f"{_HYBRID} SELECT 'grep' AS stage, CAST(count(*) AS INTEGER) AS hits, false AS dropped FROM gl UNION ALL SELECT 'vector', CAST(count(*) AS INTEGER), false FROM vl",
    "budget_dropped": "SELECT * FROM (VALUES ('grep', 0, true), ('search', 0, true)) AS t(stage, hits, dropped)",
    "index_verb": f'WITH {_PAGES_CTE.replace("html <> " + chr(39) * 2, "strlen(html) BETWEEN 1 AND 3000")} SELECT uri, s AS start, e AS "end" FROM cf WHERE done = 0',
    "index_append": f'WITH {_APPENDED} SELECT uri, s AS start, e AS "end" FROM cf WHERE done = 0',
    "index_stream": f'WITH {_PAGES_CTE} SELECT uri, s AS start, e AS "end" FROM cf WHERE done = 0',
    "rank_metrics": f"""WITH {VEC}, r AS (SELECT query_id, rank FROM ({KNN}) WHERE rank <= 10 AND doc_id = query_id + 2), g AS (SELECT n.doc_id, r.rank FROM n LEFT JOIN r ON r.query_id = n.doc_id)
        SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1.0 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM g""",
}

__all__ = ["ORACLES", "QUERIES"]
