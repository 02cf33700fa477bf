"""The pipeline against the same five steps, document by document."""

from collections import Counter

import numpy as np

import corpus_pipeline
from millrace.llm import packing, secret_scan, simhash, toxicity
from millrace.llm.words import RunHash, word_hashes

from .test_operators import odd, sample

SF = "/root/testdata/sf0.001"


def test_run_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "n_chars").collect()]
    fitted = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tag = toxicity.Tagger(fitted)

    def rejected(text):
        ((_, total, n),) = tag([text or ""])
        return bool(n) and 1 / (1 + np.exp(-np.dot([*toxicity.evidence(total, n), 1.0], fitted["doc"]))) >= 0.5

    rows = [r for r in rows if not rejected(r[1])]
    described = []
    for _, text, *_ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words, _ = word_hashes(raw, np.array([0, len(raw)]))
        shingles = RunHash(words)(3) if len(words) >= 3 else words
        described.append((set((shingles >> np.uint64(32)).tolist()), words.tobytes()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            (s, w), (t, v) = described[i], described[j]
            if (w == v and w) or (s and t and simhash.jaccard(*(np.array(sorted(z), np.uint32)[: simhash.SKETCH] for z in (s, t))) >= simhash.SIMILAR):
                p, q = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[q] = p
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    scan, clean = secret_scan.Scanner(), []
    for key, text, source, n in rows:
        masked = text
        for start, end, _ in reversed(secret_scan.find(text or "", scan)):
            masked = masked[:start] + secret_scan.MASK + masked[end:]
        clean.append((key, masked, source, len(masked) if masked != text else n))
    coder = packing.encoding(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken")
    tokens = {r[0]: coder.encode_ordinary(r[1] or "") for r in clean}
    want = Counter()
    for key, _ in sample(clean):
        at = 0
        for n in packing.pieces(len(tokens[key]), 2048):
            want[key, at, tuple(tokens[key][at : at + n])] += 1
            at += n
    got = Counter((r.doc_id, r.start, tuple(r.tokens)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == (docs.columns if name != "packing" else ["doc_id", "piece", "start", "length", "bucket", "tokens"])
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
