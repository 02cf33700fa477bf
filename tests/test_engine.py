"""The retrieval engine on small corpora, and against short models of its rules."""

import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.errors import ConfigError, IndexError_, RequestError, StoreError
from millrace.functions.text import any_of, case_variants, chunks, java_pattern, query_terms, query_terms_column, regex_escape, tokenize, tokenize_column
from millrace.operators import kmeans
from millrace.operators.containers import definitions
from millrace.operators.grep import grep, legacy_hits, lines
from millrace.operators.ranking import fuse
from millrace.operators.spans import concise, drop_drifted, findings, printed
from millrace.operators.vectors import knn_batch, knn_exact, probe_clusters, ranking_metrics, recall, search_clusters
from millrace.plans.index import VectorIndex, build_index, default_k
from millrace.plans.search import delegate, find, grep_verb, hybrid, probes, search
from millrace.schema import SPAN, empty_spans, span_json, spans_from_json
from millrace.sources import codecs
from millrace.sources.manifest import PATH, list_with_manifest, read_manifest, write_manifest
from millrace.sources.store import Address, Store, glob, glob_regex, join_uri, ls, open_store, parse_uri, read, safe_key, text_files
from millrace.sources.store import settings as store_settings
from millrace.streaming.incremental import append, changed, follow, removed

PY = b"import os\n\ndef alpha():\n    return 1\n\ndef beta():\n    # TODO: inside beta\n    return alpha()\n"
RS = b"fn one() -> i32 { 1 }\n\nfn two() -> i32 {\n    // TODO\n    2\n}\n"


def corpus(spark, *files):
    return spark.createDataFrame([(u, bytearray(c if isinstance(c, bytes) else c.encode()) if c is not None else None) for u, c in files], "uri string, content binary")


def spans(df):
    return [(r.uri, r.byte_range.start, r.byte_range.end, list(r.line_range), r.symbol, r.kind) for r in df.collect()]


def model_lines(raw):
    out, at = [], 0
    for n, line in enumerate(raw.split(b"\n"), 1):
        end = min(at + len(line) + 1, len(raw))
        if at < len(raw):
            out.append((n, at, end))
        at = end
    return out


def test_line_spans(spark):
    c = corpus(spark, ("f", "one\ntwo needle needle\nthree\nneedle"), ("g", ""), ("h", "\n"), ("n", None))
    assert spans(grep(c, "needle")) == [("f", 4, 22, [2, 2], None, "line"), ("f", 28, 34, [4, 4], None, "line")]
    assert sorted((r.uri, r.line_no) for r in lines(c).collect()) == [("f", 1), ("f", 2), ("f", 3), ("f", 4), ("h", 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aé\n\r x中", max_size=25), min_size=1, max_size=8))
def test_lines_and_grep_follow_the_model(spark, texts):
    c = corpus(spark, *[(f"u{i}", t) for i, t in enumerate(texts)])
    want = sorted((f"u{i}", *x) for i, t in enumerate(texts) for x in model_lines(t.encode()))
    assert sorted((r.uri, r.line_no, r.start, r.end) for r in lines(c).collect()) == want
    assert sorted((r.uri, r.line_range[0], r.byte_range.start, r.byte_range.end) for r in grep(c, "", max_hits=None).collect()) == want


def test_scan_of_a_prefix_caps_and_filters(spark):
    files = [(f"data/file_{i:02}.txt", "x\nneedle\n" if i % 3 == 0 else "x\n") for i in range(16)]
    c = corpus(spark, *files, (".git/a", "needle"), ("a/.x/y", "needle"), ("./b", "needle"), ("big", b"needle" * 20))
    got = spans(grep(c, "needle", max_object_bytes=100))
    assert [g[0] for g in got] == ["./b"] + [f"data/file_{i:02}.txt" for i in (0, 3, 6, 9, 12, 15)]
    assert len(spans(grep(c, "needle", max_hits=2))) == 2
    many = corpus(spark, ("a", "x\nx\nx\n"), ("b", "x\n"))
    assert [(g[0], g[3][0]) for g in spans(grep(many, "x", max_hits_per_file=2))] == [("a", 1), ("a", 2), ("b", 1)]


def test_dialect(spark):
    c = corpus(spark, ("a", "ÜBER\nseñor\r\nnada\n"))
    assert len(spans(grep(c, "über", case_insensitive=True))) == 1
    assert len(spans(grep(c, r"\w+ñ\w+"))) == 1 and len(spans(grep(c, r"\bñ"))) == 0
    assert [r.snippet for r in grep(c, "señor").collect()] == ["señor"]
    for bad in ("(", "a(?=b)", r"(a)\1", "a++", "(?<!x)y"):
        with pytest.raises(IndexError_):
            java_pattern(bad)
    assert java_pattern(r"[+*]+\\1") and java_pattern("x", True, True).startswith("(?dUim)")


def test_terms():
    assert tokenize("The quick brown fox jumps over the lazy dog") == ["quick", "brown", "fox", "jumps", "over", "lazy", "dog"]
    assert tokenize("alpha beta alpha gamma") == ["alpha", "beta", "gamma"]
    assert len(tokenize(" ".join(f"term{i}" for i in range(20)))) == 12
    assert query_terms("the of and") == ["the", "of", "and"] and query_terms("x") == []
    assert query_terms("Find the TODO inside Beta") == ["todo", "beta"]
    assert len(query_terms(" ".join(f"t{i:02}" for i in range(20)))) == 16
    assert regex_escape("a-b.c/d") == r"a-b\.c\/d" and any_of(["a", "b+"]) == r"a|b\+"
    assert probes("foo bar", ["foo", "bar"]) == ["foo|bar", "foo bar", "foo"] and probes("foo", ["foo"]) == ["foo"]


def test_case_variants():
    assert case_variants("x") == ["x"]
    assert case_variants("fooBar") == ["fooBar", "foo_bar", "foo-bar", "FOO_BAR", "FooBar"]
    assert case_variants("get") == ["get", "GET", "Get"]
    assert case_variants("HTTPServer") == ["HTTPServer", "http_server", "http-server", "HTTP_SERVER", "httpServer", "HttpServer"]
    assert case_variants("XMLHttpReq")[1] == "xml_http_req"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab The_-of.é ", max_size=40), min_size=1, max_size=10))
def test_term_columns_equal_the_functions(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", tokenize_column(F.col("t")).alias("a"), query_terms_column(F.col("t")).alias("b")).collect():
        assert list(r.a) == tokenize(r.t) and list(r.b) == query_terms(r.t)


def model_chunks(raw, size, overlap):
    out, at = [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    while at < len(raw):
        end = min(at + size, len(raw))
        while inside(end):
            end += 1
        if not inside(at):
            out.append((at, end))
            if end >= len(raw):
                break
        at += size - overlap
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aé中\U0001f600", max_size=60), min_size=1, max_size=8))
def test_chunks_follow_the_model(spark, texts):
    c = corpus(spark, *[(str(i), t) for i, t in enumerate(texts)])
    want = sorted((str(i), *x) for i, t in enumerate(texts) for x in model_chunks(t.encode(), 10, 3))
    rows = chunks(c, 10, 3).collect()
    assert sorted((r.uri, r.start, r.end) for r in rows) == want
    assert all(texts[int(r.uri)].encode()[r.start : r.end].decode() == r.text for r in rows)
    whole = chunks(c, 10, 3, align_start=True).groupBy("uri").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect()
    assert all((r.a, r.b) == (0, len(texts[int(r.uri)].encode())) for r in whole)


def test_span_json(spark):
    full = grep(corpus(spark, ("a", "x\n")), "x")
    line = span_json(full).first().json
    assert "truncated" not in line and "symbol" not in line and '"byte_range":{"start":0,"end":2}' in line
    back = spans_from_json(span_json(full))
    assert back.collect() == full.collect()
    old = spans_from_json(spark.createDataFrame([('{"uri":"a","kind":"line"}',)], "json string")).first()
    assert old.symbol is None and old.truncated is False
    assert legacy_hits(full).first().id == "a:1"
    assert printed(full).first().line == "a:1-1 [Line]\tx"
    assert concise(full).first().snippet == "x" and list(findings(full).first().byte_range) == [0, 2]


def test_widening(spark):
    c = corpus(spark, ("a.py", PY), ("vendor/a.py", PY), ("b.rs", RS), ("x.unknown", "TODO\n"), ("empty.py", "# TODO outside\n"))
    got = {g[0]: g for g in spans(grep_verb(c, "TODO", ast=True))}
    assert got["a.py"][3:] == ([6, 8], "beta", "function") and got["vendor/a.py"][3:] == ([6, 8], "beta", "function")
    assert got["b.rs"][3:] == ([3, 6], "two", "function")
    assert got["x.unknown"][5] == "line" and got["empty.py"][5] == "line"
    rows = {r.uri: r for r in grep_verb(c, "TODO", ast=True).collect()}
    assert rows["a.py"].content_hash.startswith("sha256:") and rows["a.py"].source_stage == "ast" and not rows["a.py"].truncated
    assert [g[3] for g in spans(find(corpus(spark, ("a.py", b"def beta():\n    pass\n# beta\nbeta()\n")), "beta"))] == [[1, 2]]
    long = corpus(spark, ("l.py", "def f():\n    # TODO\n" + "    x = 1\n" * 200))
    r = grep_verb(long, "TODO", ast=True).first()
    assert r.truncated and len(r.snippet) == 800


def test_innermost_and_languages():
    nested = definitions(b"class A:\n    def f(self):\n        def g():\n            return 1\n        return g\n", "python")
    assert [(d["symbol"], d["first"], d["last"]) for d in nested] == [("A", 1, 5), ("f", 2, 5), ("g", 3, 4)]
    assert definitions("# é\ndef f():\n  pass\n".encode(), "python")[0]["start"] == 5
    assert definitions(b"def (", "python") == []
    rust = definitions(b'struct P { a: i32 }\nimpl P {\n  fn m(&self) { let s = "}"; /* { */ }\n}\nmod t { fn u() {} }\n', "rust")
    assert [(d["symbol"], d["kind"], d["first"], d["last"]) for d in rust] == [("P", "class", 1, 1), (None, "block", 2, 4), ("m", "function", 3, 3), ("t", "module", 5, 5), ("u", "function", 5, 5)]
    go = definitions(b"func (r *T) M() {\n}\n\ntype T struct {\n}\n", "go")
    assert [(d["symbol"], d["kind"]) for d in go] == [("M", "method"), ("T", "class")]
    ts = definitions(b"export class P {\n  go(x: number): void {\n    if (x) { return }\n  }\n}\nconst f = (a) => {\n}\n", "typescript")
    assert [(d["symbol"], d["kind"]) for d in ts] == [("P", "class"), ("go", "method"), ("f", "function")]


def test_drift(spark):
    old, new = corpus(spark, ("a", "TODO x\n"), ("b", "TODO\n")), corpus(spark, ("a", "TODO y\n"), ("b", "TODO\n"))
    assert [g[0] for g in spans(drop_drifted(grep(old, "TODO", stamp_hash=True), new))] == ["b"]
    assert len(spans(drop_drifted(grep(old, "TODO"), corpus(spark, ("a", "T"), ("b", "TODO\n"))))) == 1


def ranked_list(spark, *lists):
    rows = [(u, (s, e), [1, 1], None, "line", u, 1.0, None, "grep", None, False, i, r) for i, own in enumerate(lists) for r, (u, s, e) in enumerate(own, 1)]
    schema = empty_spans(spark).schema.add("list", IntegerType()).add("rank", IntegerType())
    return spark.createDataFrame(rows, schema)


def test_fusion(spark):
    tie = fuse(ranked_list(spark, [("a", 100, 110)], [("a", 20, 30)]), 10)
    assert [g[1] for g in spans(tie)] == [20, 100]
    up = fuse(ranked_list(spark, [("x", 0, 1), ("y", 0, 1), ("z", 0, 1)], [("y", 0, 1), ("w", 0, 1)]), 10)
    assert spans(up)[0][0] == "y" and up.first().score == pytest.approx(1 / 62 + 1 / 61)
    many = ranked_list(spark, *[[(f"u{i:02}", 0, 1)] for i in range(16)])
    assert spans(fuse(many, None)) == spans(fuse(many, None))


def test_search_and_delegate(spark):
    c = corpus(spark, ("a.py", PY), ("b.rs", RS), ("n.txt", "nothing\n"))
    best = search(c, "find TODO inside beta function", 5).first()
    assert best.symbol == "beta" and "TODO" in best.snippet and best.rank_signals.term_overlap >= 2
    assert search(c, "beta", 0).count() == 0 and search(c, "", 5).count() == 0
    found, summary = delegate(c, "TODO", 5)
    assert found.count() == 2 and summary.first().summary == '2 match(es) for "TODO": 1 in a.py, 1 in b.rs'
    assert delegate(c, "zzz", 5)[1].first().summary == '0 match(es) for "zzz"'


def unit_rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")


def test_kmeans(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([np.eye(4)[0] + 0.1 * r.normal(size=(20, 4)), np.eye(4)[1] + 0.1 * r.normal(size=(20, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, a = kmeans.train(unit_rows(spark, x), 2, 8)
    label = {i.doc_id: i.cluster_id for i in a.collect()}
    assert len({label[i] for i in range(20)}) == 1 and len({label[i] for i in range(20, 40)}) == 1 and label[0] != label[20]
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
    # the rule itself, three rounds, with an empty cluster possible
    cent = x[[min(i * (40 // 7), 39) for i in range(7)]]
    for _ in range(3):
        at = np.argmax(np.round(x @ cent.T, 12), axis=1)
        cent = np.stack([x[at == j].mean(0) / np.linalg.norm(x[at == j].mean(0)) if (at == j).any() else cent[j] for j in range(7)])
    c, a = kmeans.train(unit_rows(spark, x), 7, 3)
    assert np.allclose(c, cent) and [i.cluster_id for i in a.orderBy("doc_id").collect()] == at.tolist()
    assert {i.cluster_id for i in kmeans.train(unit_rows(spark, x), 3, 0)[1].collect()} == {0}
    assert len(kmeans.train(unit_rows(spark, x), 40, 1)[0]) == 40
    for k in (0, 41):
        with pytest.raises(IndexError_):
            kmeans.train(unit_rows(spark, x), k)
    with pytest.raises(IndexError_):
        kmeans.train(unit_rows(spark, x[:0]), 1)
    assert [default_k(n) for n in (1, 3, 500)] == [1, 1, 22]


def test_neighbours(spark):
    x = np.random.default_rng(2).normal(size=(60, 6))
    rows = unit_rows(spark, x)
    q = rows.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "vector")
    exact, batch = (sorted(map(tuple, f(rows, q, 4).collect())) for f in (knn_exact, knn_batch))
    assert exact == batch and [e[1] for e in exact if e[3] == 1] == [0, 1, 2, 3, 4]
    c, a = kmeans.train(kmeans.unit_vectors(rows, "doc_id", "vector"), 5, 2)
    cents = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, centroid array<double>")
    assert probe_clusters(q, cents, 0).count() == 5 and probe_clusters(q, cents, 99).count() == 25
    truth = knn_exact(rows, q, 4)
    rates = [recall(search_clusters(a, cents, q, 4, p), truth, 4).first().recall for p in (1, 3, 5)]
    assert rates == sorted(rates) and rates[-1] == 1.0
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, uri string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "x")], "query_id int, uri string")
    m = ranking_metrics(ranked, gold).first()
    assert (m.mrr, m.recall) == (0.25, 0.5) and m.ndcg == pytest.approx(0.5 / np.log2(3))


def test_codecs(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(3, 4)
    ids, back = codecs.decode_cluster(codecs.encode_cluster(np.array([1, 2, 9]), v), 4)
    assert ids.tolist() == [1, 2, 9] and (back == v).all()
    assert (codecs.decode_centroids(codecs.encode_centroids(v), 4, 3) == v).all()
    for bad in (lambda: codecs.decode_cluster(b"xxx", 4), lambda: codecs.decode_centroids(b"xxxx", 4, 3)):
        with pytest.raises(IndexError_):
            bad()
    raw = b"".join(np.int32(4).tobytes() + r.tobytes() for r in v)
    (tmp_path / "v.fvecs").write_bytes(raw)
    assert [list(r.vector) for r in codecs.read_vecs(spark, f"file://{tmp_path}/v.fvecs").orderBy("pos").collect()] == v.tolist()


def test_index_hybrid_and_stream(spark, tmp_path):
    docs = [("a.md", "apples and pears grow on trees"), ("b.md", "ships sail over the ocean waves"), ("c.md", "compilers translate programs to machine code"), ("d.txt", "ignored"), ("e.md", "")]
    c = text_files(corpus(spark, *docs))
    assert sorted(r.uri for r in c.collect()) == ["a.md", "b.md", "c.md"]
    path = f"file://{tmp_path}/index"
    m = build_index(c, path, k=2, iters=3)
    assert m["num_docs"] == 3 and sum(m["cluster_sizes"]) == 3 and m["k"] == 2
    index = VectorIndex(spark, path)
    q = spark.createDataFrame([(0, "sail the ocean")], "query_id long, text string")
    top = index.search_text(q, 1, probe=2).join(index.docs, "doc_id").first()
    assert top.uri == "b.md" and top.score > 0.3
    out = hybrid(c, "ocean ships", index, k=3, grep_ms=60_000, vector_ms=60_000)
    assert out.spans.first().uri == "b.md" and [s.stage for s in out.stages] == ["grep", "vector"] and not any(s.dropped for s in out.stages)
    late = hybrid(c, "ocean", None, k=3, grep_ms=0)
    assert late.stages[0].dropped and "budget" in late.stages[0].error and late.spans.count() == 0
    with pytest.raises(IndexError_):
        VectorIndex(spark, f"file://{tmp_path}/none")
    with pytest.raises(IndexError_):
        build_index(c.limit(0), path + "2")
    with pytest.raises(IndexError_):
        index.search(spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>"), 1)
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "f.md").write_text("volcanoes erupt lava")
    follow(spark, f"file://{tmp_path}/in", path, f"file://{tmp_path}/ck").awaitTermination()
    q = spark.createDataFrame([(0, "lava volcanoes")], "query_id long, text string")
    again = VectorIndex(spark, path)
    assert again.search_text(q, 1, probe=2).join(again.docs, "doc_id").first().uri.endswith("f.md")
    assert append(path, c.limit(0)) == 0


def test_addresses():
    assert parse_uri("s3://b/k/x") == Address("s3", "b", "k/x") and parse_uri("s3://b") == Address("s3", "b", "") and parse_uri("file:///t/x") == Address("file", None, "/t/x")
    with pytest.raises(ConfigError):
        parse_uri("/no/scheme")
    assert join_uri("s3://b/p/", "/k") == "s3://b/p/k"
    for bad in ("../etc/passwd", "a/../b", "/abs"):
        with pytest.raises(StoreError):
            safe_key(bad)
    env = {"R2_ENDPOINT": "https://e", "R2_ACCOUNT_ID": "acc"}
    assert "acc" in store_settings("r2", env)["fs.s3a.endpoint"]


def test_globs(spark):
    import re

    hit = lambda p, s: bool(re.search(glob_regex(p), s))
    assert hit("*.md", "a/b.md") and hit("**/*.md", "b.md") and hit("**/*.md", "x/y/b.md") and not hit("*.md", "b.mdx")
    assert hit("{a,b}?.t[xy]", "b1.ty") and not hit("[!a]", "a") and hit("a.b", "a.b") and not hit("a.b", "axb")
    keys = spark.createDataFrame([(k, 1) for k in ("docs/a.md", "docs/b.md", "docs/c.txt")], "key string, size long")
    assert glob(keys, "docs", "*.md").count() == 2 and ls(keys, limit=0).count() == 1


def test_store_listing_and_manifest(spark, tmp_path):
    for name, text in (("docs/readme.md", "# hello world\n"), ("docs/api.md", "api"), ("data/x.bin", "0123456789"), (".hid/y", "z"), ("e", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    store, prefix = open_store(spark, f"file://{tmp_path}")
    assert prefix == "" and open_store(spark, f"file://{tmp_path}/docs/api.md")[1] == "api.md"
    assert store.head("docs/readme.md")["size"] == 14 and store.get_range("data/x.bin", 2, 5) == b"23456" and store.get("e") == b"" and store.get_range("data/x.bin", 8, 9) == b"89"
    keys = sorted(r.key for r in store.list().collect())
    assert keys == [".hid/y", "data/x.bin", "docs/api.md", "docs/readme.md", "e"]
    assert sorted(r.key for r in store.list("docs").collect()) == ["docs/api.md", "docs/readme.md"]
    assert [g[0] for g in spans(grep(store.corpus(), "hello"))] == ["docs/readme.md"]
    assert write_manifest(store) == 5 and read_manifest(store)[0]["count"] == 5
    store.put("new", b"later")
    assert list_with_manifest(store).count() == 5  # the manifest is whole, so it is believed
    entries = tmp_path / PATH / "entries"
    os.remove(next(p for p in entries.iterdir() if p.name.endswith(".gz")))
    assert list_with_manifest(store).count() == 6  # now it isn't
    store.delete("new")
    for act in (lambda: store.delete("new"), lambda: store.get("../x"), lambda: store.head("nope")):
        with pytest.raises(StoreError):
            act()
    with pytest.raises(ConfigError):
        open_store(spark, "ftp://x/y")
    assert isinstance(store, Store) and store.describe().endswith(tmp_path.name)


def test_read(spark):
    c = corpus(spark, ("a", "héllo"), ("b", b"\xff\xfe"))
    assert tuple(read(c, "a").first()) == ("a", 6, "héllo") and tuple(read(c, "a", 2, 2).first()) == ("a", 2, None)
    assert tuple(read(c, "b").first()) == ("b", 2, None)
    with pytest.raises(RequestError):
        read(c, "a", 1)


def test_changes(spark):
    schema = "key string, size long, etag string, last_modified long"
    before = spark.createDataFrame([("a", 1, None, 5), ("b", 1, None, 5), ("c", 1, None, 5)], schema)
    now = spark.createDataFrame([("a", 1, None, 5), ("b", 2, None, 5), ("d", 1, None, 6)], schema)
    assert sorted(r.key for r in changed(now, before).collect()) == ["b", "d"] and [r.key for r in removed(now, before).collect()] == ["c"]


def test_empty_corpus(spark):
    c = corpus(spark, ("a", "x")).limit(0)
    assert grep(c, "x").count() == lines(c).count() == chunks(c).count() == search(c, "some words", 3).count() == 0
    assert empty_spans(spark).schema == spark.createDataFrame([], SPAN).schema
