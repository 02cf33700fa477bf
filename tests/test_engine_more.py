"""Scale, caches, dialects and indexes of the retrieval engine."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.errors import IndexError_, StoreError
from millrace.functions.text import java_pattern
from millrace.functions.vector import dot
from millrace.marked import CODE, DEFINITIONS
from millrace.operators import kmeans
from millrace.operators.containers import definitions, with_containers
from millrace.operators.grep import grep
from millrace.operators.matrix import Slices, top
from millrace.operators.vectors import knn_exact, percentiles, probe_clusters, search_clusters
from millrace.plans.index import VectorIndex, build_from_vectors, build_index
from millrace.plans.search import delegate, delegate_within, search_within
from millrace.sources.files import where, write_files
from millrace.sources.store import CorpusCache, open_store
from millrace.streaming.incremental import append

LANGUAGE = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go"}


def frame(spark, *files):
    return spark.createDataFrame(list(files), "uri string, content string")


@pytest.mark.parametrize("uri,text", [x for x in CODE if x[0].rsplit(".")[-1] in LANGUAGE])
def test_definitions_as_marked_by_hand(uri, text):
    got = {(d["start"], d["end"], d["first"], d["last"], d["symbol"], d["kind"]) for d in definitions(text.encode(), LANGUAGE[uri.rsplit(".")[-1]])}
    assert got == {d[1:] for d in DEFINITIONS if d[0] == uri}


def test_grep_takes_time_in_proportion_to_the_file(spark):
    def seconds(n):
        c = frame(spark, ("f", "".join(f"a needle in line {i} of some length or other\n" for i in range(n))))
        best = []
        for _ in range(3):
            began = time.time()
            assert grep(c, "needle", max_hits=None, stamp_hash=True).agg(F.max("byte_range.end")).first()[0] > 40 * n
            best.append(time.time() - began)
        return min(best)

    seconds(1000)
    small, large = seconds(20_000), seconds(160_000)
    assert large < 16 * max(small, 0.2)  # eight times the bytes; by the square it would be 64 times


def test_pattern_dialect(spark):
    c = frame(spark, ("a", "al: x\n123\nabc\naB\nAB\n"))
    hits = lambda p: [r.snippet for r in grep(c, p).collect()]
    assert hits("[[:digit:]]+") == ["123"] and hits("(?P<n>abc)") == ["abc"] and hits("a(?i)B") == ["abc", "aB"] and hits(r"\x{61}bc") == ["abc"]
    assert hits("[^[:alpha:]:[:space:]]") == ["123"] and hits(r"^\p{Lu}+$") == ["AB"] and hits(r"a{,0}bc$") == ["abc"]
    for bad in ("(", "[a", "(?=x)", r"\1", "a**+", "(?P<n>a)(?P<n>b)", r"[a--b]", "\\"):
        with pytest.raises(IndexError_):
            java_pattern(bad)


def test_products_in_slices(spark):
    r = np.random.default_rng(3)
    x, c = r.normal(size=(200, 6)), r.normal(size=(30, 6))
    c[7] = c[3]  # of equal centroids the first counts
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    whole = {y.doc_id: y.cluster_id for y in kmeans.assign(vectors, c).collect()}
    assert whole == {i: int(np.argmax(np.round(v @ c.T, 12))) for i, v in enumerate(x)} and 7 not in whole.values()
    held = Slices(spark, c, slice_bytes=6 * 8 * 4)
    assert len(held.parts) == 8 and np.array_equal(np.concatenate([m for _, m in held]), c)
    q = vectors.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: [int(j) for j in np.lexsort((np.arange(30), -np.round(unit[i] @ c.T, 9)))[:4]] for i in range(20)}
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, centroid array<double>")
    got = {}
    for y in probe_clusters(q, centroids, 4).collect():
        got.setdefault(y.query_id, set()).add(y.cluster_id)
    assert got == {i: set(v) for i, v in want.items()}
    assert probe_clusters(q, centroids, 99).count() == 20 * 30


def test_queries_in_parts(spark, monkeypatch):
    from millrace.operators import vectors as module

    r = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(150, 5)))], "doc_id long, vector array<double>")
    q = vectors.withColumnRenamed("doc_id", "query_id")
    rows = lambda: sorted(map(tuple, knn_exact(vectors, q, 3).select("query_id", "doc_id", "rank").collect()))
    clusters = kmeans.assign(vectors, r.normal(size=(6, 5)))
    centroids = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(6)], "cluster_id int, centroid array<double>")
    found = lambda: sorted(map(tuple, search_clusters(clusters, centroids, q, 3, 6).select("query_id", "doc_id", "rank").collect()))
    whole = rows(), found()
    monkeypatch.setattr(module, "QUERY_BYTES", 1500)
    assert (rows(), found()) == whole
    assert top(np.array([[1.0, 2, 2, 2, 0]]), np.array([9, 8, 7, 6, 5]), 2)[1].tolist() == [[6, 7]]
    assert knn_exact(vectors, q.limit(0), 3).count() == 0
    assert percentiles([]) == {} and percentiles([3, 1, 2, 10]) == {"mean": 4, "p50": 3, "p95": 10, "p99": 10}
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(dot(F.col("a"), F.col("b"))).collect()


def letters(rows):
    return rows.select("id", F.array(*[F.length(F.regexp_replace("text", f"[^{c}]", "")).cast("double") for c in "abc"]).alias("vector"))


def test_index_is_whole_or_not_there_and_appends_once(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(IndexError_):
        VectorIndex(spark, path)
    build_index(frame(spark, ("a", "aab"), ("b", "bbc"), ("c", "cc")), path, letters, 2)
    for _ in range(2):  # a batch that is written again takes its own place
        assert append(path, frame(spark, ("d", "abc"), ("e", "ccc")), letters, 1) == 2
    assert VectorIndex(spark, path).manifest["num_docs"] == 5
    append(path, frame(spark, ("a", "ccca")), letters)
    held = VectorIndex(spark, path)
    assert sorted((r.uri, r.snippet) for r in held.docs.collect()) == [("a", "ccca"), ("b", "bbc"), ("c", "cc"), ("d", "abc"), ("e", "ccc")]
    q = spark.createDataFrame([(0, "aab")], "query_id long, text string")
    near = held.search_text(q, 5, 2, letters).join(held.docs, "doc_id").orderBy("rank").collect()
    assert len(near) == 5 and {r.uri for r in near} == set("abcde")  # the former chunk of a is gone
    with pytest.raises(IndexError_):
        held.search(spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>"), 1)
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "doc_id long, vector array<double>")
    build_from_vectors(vectors, spark.createDataFrame([(0, "z", [0, 1], "")], "doc_id long, uri string, byte_range array<long>, snippet string"), path, 1, 1)
    assert VectorIndex(spark, path).manifest["num_docs"] == 1


def test_cluster_scan_is_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    build_index(frame(spark, *[(str(i), "abc"[i % 3] * 9) for i in range(30)]), path, letters, 3)
    held = VectorIndex(spark, path)
    plan = search_clusters(held.clusters, held.centroids, spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vector array<double>"), 3, 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "cluster_id" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_stores_ranges_and_cache(spark, tmp_path):
    store, _ = open_store(spark, f"file://{tmp_path}")
    assert write_files(frame(spark, ("a/b.txt", "hello"), (".h/x", "hidden"), ("e", "")), where(f"file://{tmp_path}")) == 3
    assert store.get("a/b.txt") == b"hello" and store.get_range("a/b.txt", 1, 3) == b"ell" and store.get_range("a/b.txt", 4, 9) == b"o" and store.get_range("a/b.txt", 9, 1) == b""
    raw, head = store.get_fresh("e")
    assert raw == b"" and head["size"] == 0
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(StoreError):
            store.get(bad)
    (tmp_path.parent / "outside").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path.parent / "outside")
    with pytest.raises(StoreError):
        store.get("link")
    (tmp_path / "link").unlink()
    with pytest.raises(Exception, match="leaves its root"):
        write_files(frame(spark, ("../out", "x")), where(f"file://{tmp_path}"))
    cache = CorpusCache(store, f"file://{tmp_path.parent}/cache-{tmp_path.name}")
    want = {"a/b.txt": b"hello", ".h/x": b"hidden", "e": b""}
    for fetched in (3, 0):
        assert {r.uri: bytes(r.content) for r in cache.corpus().collect()} == want and cache.fetched == fetched
    store.put("a/b.txt", b"hello again")
    store.delete("e")
    assert {r.uri: bytes(r.content) for r in cache.corpus().collect()} == {"a/b.txt": b"hello again", ".h/x": b"hidden"} and cache.fetched == 1


def test_parsers_and_their_cache(spark, tmp_path):
    files = frame(spark, ("a.toy", "one"), ("b.toy", "one"), ("c.PY", "def f(): pass"), ("d", "x"))
    toy = lambda raw: [(0, len(raw), 1, 1, raw.decode(), "block")]
    folder = f"file://{tmp_path}/parsed"
    for _ in range(2):
        rows = {r.uri: r.containers for r in with_containers(files, {"toy": toy}, folder).collect()}
        assert rows["a.toy"][0].symbol == rows["b.toy"][0].symbol == "one" and rows["c.PY"][0].symbol == "f" and rows["d"] is None
        assert spark.read.parquet(f"{folder}/grammar-2").count() == 2  # equal contents once, and nothing is parsed again
    never = lambda raw: [] if raw is None else 1 / 0
    assert {r.uri for r in with_containers(files, {"toy": never}, folder).where("containers IS NOT NULL").collect()} == {"a.toy", "b.toy", "c.PY"}


def test_budgets(spark):
    c = frame(spark, ("a.py", "def f():\n    return 'needle'\n"), ("b", "needle"))
    good = search_within(c, "needle", 5, budget_ms=600_000)
    assert good.spans.count() == 2 and [(s.stage, s.hits, s.dropped) for s in good.stages] == [("search", 2, False)]
    late = search_within(c, "needle", 5, budget_ms=0)
    assert late.spans.count() == 0 and late.stages[0].dropped and "budget" in late.stages[0].error
    found, summary, stages = delegate_within(c, "needle", 5, budget_ms=600_000)
    assert sorted(map(str, found.collect())) == sorted(map(str, delegate(c, "needle", 5)[0].collect())) and summary == delegate(c, "needle", 5)[1].first()[0] and stages[0].hits == 2
    found, summary, stages = delegate_within(c, "needle", 5, budget_ms=0)
    assert found.count() == 0 and summary == '0 match(es) for "needle"' and stages[0].dropped
