"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, labelled_sample, logistic, packed, release

TOKEN = re.compile(r"\w+")
#: Labelled documents that the field is trained on, at most.
TRAINING_DOCS = 2000
#: A feature of a toxic document marks its tokens when it has such support and log odds.
SUPPORT, LOG_ODDS = 5, 2.5
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text whose tokens are tagged in one go.
BLOCK = 1 << 18
#: Tokens that training holds in arrays at a time.
PART = 100_000

SPANS = "array<struct<start:int,end:int,probability:double>>"


def tokens(text: str) -> tuple[list[str], str]:
    """The tokens of a text in lower case, and the text in which they lie at the same places as in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        return TOKEN.findall(low), low
    # lowering changed the length: tokens are found in the text, and lowered one by one
    return [w.lower() for w in TOKEN.findall(text)], text


def features(word: str) -> list[str]:
    """The features of a token: itself, its prefixes, its suffix and its shape."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n), "$" + word[-3:], "#" + str(min(len(word), 12))]


def weak_labels(docs: list[list[str]], toxic: list[int]) -> list[np.ndarray]:
    """Token labels from document labels: a token of a toxic document is toxic if the
    document frequency of one of its features is significantly higher in toxic documents."""
    many = np.array(toxic).sum()
    few = len(toxic) - many
    t, c = Counter(), Counter()
    for words, y in zip(docs, toxic):
        (t if y else c).update({f for w in set(words) for f in features(w)[:-1]})

    @lru_cache(maxsize=None)
    def marked(word: str) -> bool:
        for f in features(word)[:-1]:
            if t[f] >= SUPPORT:
                odds = np.log((t[f] + 0.5) / (many + 1)) - np.log((c[f] + 0.5) / (few + 1))
                # expected by chance under equal rates, with a normal bound of 5 deviations
                n, p = t[f] + c[f], many / max(1, many + few)
                if odds >= LOG_ODDS and t[f] - n * p > 5 * np.sqrt(n * p * (1 - p)):
                    return True
        return False

    return [np.array([y and marked(w) for w in words], bool) for words, y in zip(docs, toxic)]


class Chain:
    """Forward-backward over many sequences at once.

    All sequences are laid end to end as one chain, in which the step into the first
    token of a sequence forgets the state before it. The chain is cut into equal
    stretches: their transfer matrices are formed side by side, joined one after another,
    and the stretches are then run again from the right states. That is exact.
    """

    def __init__(self, start: np.ndarray, transition: np.ndarray):
        self.start, self.transition = start, transition

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From emission scores of state 1 (state 0 has 0) and the flags of first tokens:
        P(state 1) of each token, and the summed pair marginals."""
        n = len(emission)
        if not n:
            return np.zeros(0), np.zeros((2, 2))
        e = np.exp(np.clip(emission, -30, 30))
        width = int(np.ceil(np.sqrt(n)))
        k = -(-n // width)
        # the potentials m[from][to] of each step, one row a step of all stretches; of padding, the identity
        m = []
        for i in range(2):
            for j in range(2):
                x = np.full(k * width, float(i == j))
                x[:n] = np.where(first, self.start[j], self.transition[i, j]) * (e if j else 1.0)
                m.append(np.ascontiguousarray(x.reshape(k, width).T))
        m00, m01, m10, m11 = m
        rows = []
        for a, b in ((np.ones(k), np.zeros(k)), (np.zeros(k), np.ones(k))):
            rows.append([a, b])
        for t in range(width):
            for r in rows:
                a, b = r
                r[0], r[1] = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t]
            if t % 8 == 7:  # potentials are at most about e**30, so eight of them can't overflow
                scale = 1 / (rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1])
                for r in rows:
                    r[0], r[1] = r[0] * scale, r[1] * scale
        total = np.stack([np.stack(r, axis=1) for r in rows], axis=1)
        alpha, beta = np.empty((k, 2)), np.empty((k, 2))
        a, b = np.full(2, 0.5), np.ones(2)
        for i in range(k):
            alpha[i] = a
            a = a @ total[i]
            a /= a.sum()
        for i in range(k - 1, -1, -1):
            beta[i] = b
            b = total[i] @ b
            b /= b.sum()
        left, right = np.empty((2, width, k)), np.empty((2, width, k))
        a0, a1 = alpha[:, 0].copy(), alpha[:, 1].copy()
        for t in range(width):
            a0, a1 = a0 * m00[t] + a1 * m10[t], a0 * m01[t] + a1 * m11[t]
            if t % 8 == 7:
                scale = 1 / (a0 + a1)
                a0, a1 = a0 * scale, a1 * scale
            left[0, t], left[1, t] = a0, a1
        b0, b1 = beta[:, 0].copy(), beta[:, 1].copy()
        for t in range(width - 1, -1, -1):
            right[0, t], right[1, t] = b0, b1
            b0, b1 = m00[t] * b0 + m01[t] * b1, m10[t] * b0 + m11[t] * b1
            if t % 8 == 0:
                scale = 1 / (b0 + b1)
                b0, b1 = b0 * scale, b1 * scale
        flat = [x.T.ravel()[:n] for x in (left[0], left[1], right[0], right[1], m00, m01, m10, m11)]
        l0, l1, r0, r1 = flat[:4]
        p = l1 * r1 / (l0 * r0 + l1 * r1)
        inner = np.flatnonzero(~first)
        l0, l1, r0, r1 = l0[inner - 1], l1[inner - 1], r0[inner], r1[inner]
        p00, p01, p10, p11 = l0 * flat[4][inner] * r0, l0 * flat[5][inner] * r1, l1 * flat[6][inner] * r0, l1 * flat[7][inner] * r1
        scale = 1 / (p00 + p01 + p10 + p11)
        return p, np.array([[(p00 * scale).sum(), (p01 * scale).sum()], [(p10 * scale).sum(), (p11 * scale).sum()]])


def train(sample: list[tuple[str, int]], steps: int = 40, ridge: float = 1e-4, lasso: float = 4e-3) -> dict:
    """A field fitted to labelled documents: hashed emission weights, transitions, and the
    weights that turn the marginals of all tokens into a document score. Emission weights
    are fitted with both penalties, so that most are zero; these are left out, which changes nothing.

    With no toxic or no clean document nothing can be learned, and every score is 0.
    """
    docs = [[*map(sys.intern, tokens(text)[0])] for text, _ in sample]
    toxic = [y for _, y in sample]
    if not any(toxic) or all(toxic):
        return {"w": {}, "start": np.ones(2), "transition": np.ones((2, 2)), "doc": np.array([0.0, 0.0, -30.0])}
    labels = weak_labels(docs, toxic)
    # documents called toxic without any toxic token teach nothing about tokens
    used = [i for i, y in enumerate(toxic) if docs[i] and (not y or labels[i].any())]
    types: dict[str, int] = {}
    at = np.array([types.setdefault(w, len(types)) for i in used for w in docs[i]])
    y = np.concatenate([labels[i] for i in used]).astype(float)
    first = np.zeros(len(at), bool)
    first[np.concatenate(([0], np.cumsum([len(docs[i]) for i in used])[:-1]))] = True
    # whole documents, about PART tokens at a time
    edge = np.append(np.flatnonzero(first), len(at))
    parts = [(int(edge[lo]), int(edge[hi])) for lo, hi in blocks(np.diff(edge), PART)]
    names: dict[str, int] = {}
    rows, columns = [], []
    for w, i in types.items():
        for f in features(w):
            rows.append(i)
            columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    w = np.zeros(len(names) + 1)  # the last is the bias
    inner = np.flatnonzero(~first)
    y1 = y.astype(int)
    gold_pair = np.zeros((2, 2))
    np.add.at(gold_pair, (y1[inner - 1], y1[inner]), 1)
    gold_start = np.bincount(y1[first], minlength=2).astype(float)
    gold = np.bincount(at, y, len(types))
    theta_t, theta_s = np.zeros((2, 2)), np.zeros(2)
    state: dict[str, list] = {}

    def adam(name: str, value: np.ndarray, g: np.ndarray, i: int, rate: float) -> np.ndarray:
        m, v = state.get(name, (np.zeros_like(value), np.zeros_like(value)))
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        state[name] = [m, v]
        return value - rate * (m / (1 - 0.8**i)) / (np.sqrt(v / (1 - 0.95**i)) + 1e-8)

    for i in range(1, steps + 1):
        score = np.bincount(rows, w[columns], len(types)) + w[-1]
        chain = Chain(np.exp(theta_s), np.exp(theta_t))
        p, pair = np.empty(len(at)), np.zeros((2, 2))
        for lo, hi in parts:
            p[lo:hi], own = chain.marginals(score[at[lo:hi]], first[lo:hi])
            pair += own
        diff = np.bincount(at, p, len(types)) - gold
        p_first = p[first].sum()
        rate = 0.5 / (1 + i / 20)
        w[:-1] = adam("w", w[:-1], np.bincount(columns, diff[rows], len(names)) + ridge * len(y) * w[:-1] / 100, i, rate)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * lasso, 0)
        w[-1:] = adam("b", w[-1:], np.array([diff.sum()]), i, rate)
        theta_t = adam("t", theta_t, pair - gold_pair, i, rate / 4)
        theta_s = adam("s", theta_s, np.array([first.sum() - p_first, p_first]) - gold_start, i, rate / 4)
    fitted = {"w": {f: float(w[i]) for f, i in names.items() if w[i]}, "bias": float(w[-1]), "start": np.exp(theta_s), "transition": np.exp(theta_t)}
    x, z = [], []
    tag = Tagger(fitted)
    for lo, hi in blocks(np.array([len(t) for t, _ in sample]), BLOCK):
        for (_, total, n), (_, label) in zip(tag([t for t, _ in sample[lo:hi]]), sample[lo:hi]):
            x.append(evidence(total, n))
            z.append(label)
    return fitted | {"doc": logistic(np.array(x), np.array(z, float))}


def evidence(total: float, n: int) -> list[float]:
    """What a document score rests on: the sum of all marginals, each weighted by itself, so that the slight doubts of a
    long text don't add up, and its share of the tokens."""
    return [np.log1p(total), np.log1p(1000 * total / max(n, 1))]


class Tagger:
    """Toxic tokens of texts; the emission scores of token types are remembered."""

    def __init__(self, fitted: dict):
        self.w, self.bias = fitted["w"], fitted.get("bias", 0.0)
        self.chain = Chain(fitted["start"], fitted["transition"])
        self.seen: dict[str, float] = {}

    def emission(self, word: str) -> float:
        if len(self.seen) > 100_000:
            self.seen.clear()
        get = self.w.get
        value = self.seen[word] = self.bias + sum([get(f, 0.0) for f in features(word)])
        return value

    def __call__(self, texts: list[str]) -> list[tuple[list[tuple[int, int, float]], float, int]]:
        """For each text, the (start, end, probability) of its toxic tokens in characters, the sum of the squared marginals of all its
        tokens, and their number. A token is listed if its marginal is at least one half."""
        found = [tokens(t) for t in texts]
        sizes = np.array([len(x) for x, _ in found])
        if not self.w or not sizes.sum():
            return [([], 0.0, int(n)) for n in sizes]
        seen, emission = self.seen, self.emission
        scores = np.array([seen[w] if w in seen else emission(w) for x, _ in found for w in x])
        ends = np.cumsum(sizes)
        first = np.zeros(len(scores), bool)
        first[(ends - sizes)[sizes > 0]] = True
        p, _ = self.chain.marginals(scores, first)
        totals = np.diff(np.concatenate(([0.0], np.cumsum(p * p)))[np.concatenate(([0], ends))])
        hot = np.flatnonzero(p >= 0.5)
        out: list[tuple[list, float, int]] = [([], float(t), int(n)) for t, n in zip(totals, sizes)]
        owner = np.searchsorted(ends, hot, side="right")
        for i in np.unique(owner):
            spans = [m.span() for m in TOKEN.finditer(found[i][1])]
            for j in hot[owner == i] - (ends[i] - sizes[i]):
                out[i][0].append((*spans[j], float(p[j + ends[i] - sizes[i]])))
        return out


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> dict:
    """The field for a corpus, trained on at most ``most`` labelled documents."""
    fitted = train(labelled_sample(documents, labels, "toxic", most))
    release()
    return fitted


def _scores(fitted: dict, tag: Tagger, texts: list[str]) -> Iterator[tuple[float, list]]:
    w = fitted["doc"]
    for found, total, n in tag(texts):
        value = 1 / (1 + np.exp(-np.clip(np.dot([*evidence(total, n), 1.0], w), -30, 30))) if n and tag.w else 0.0
        yield float(value), found


_tagger: list = [None, None]


def tag_column(spark, fitted: dict):
    """A column function text -> struct(score, spans)."""
    held = spark.sparkContext.broadcast(fitted)  # a fixed number of weights from a bounded sample

    @F.arrow_udf(f"struct<score:double,spans:{SPANS}>")
    def tag(column: pa.Array) -> pa.Array:
        model = held.value
        if _tagger[0] is not model:  # a worker keeps it from batch to batch
            _tagger[:] = model, Tagger(model)
        column = column.fill_null("")
        found: list = []
        for lo, hi in blocks(pc.binary_length(column).to_numpy(), BLOCK):
            found += _scores(model, _tagger[1], column.slice(lo, hi - lo).to_pylist())
        release()
        spans = [[{"start": s, "end": e, "probability": round(p, 6)} for s, e, p in f] for _, f in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array([v for v, _ in found], pa.float64()), pa.array(spans, kind)], names=["score", "spans"]
        )

    return tag


def score_toxicity(docs: DataFrame, fitted: dict, least: float = 0.5) -> DataFrame:
    """(doc_id, score, toxic, spans) for every document.

    Each token's probability of being toxic is its forward-backward marginal over the
    whole text; ``spans`` holds start and end (characters from 0) of the tokens with at least
    one half. The document score rests on the sum of the marginals of all tokens, each weighted by itself,
    and on its share of the tokens; ``toxic`` says whether it is at least ``least``, so a score of just that is toxic.

    Null and empty texts, those without tokens, and all texts under a field without weights score 0; null and repeated ids pass through, each row on its own;
    an empty table gives an empty one; other columns are not read.
    """
    tag = tag_column(docs.sparkSession, fitted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag(F.col("text").cast("string")).alias("t"))
    return rows.select("doc_id", F.col("t.score").alias("score"), (F.col("t.score") >= least).alias("toxic"), F.col("t.spans").alias("spans"))


def drop_toxic(docs: DataFrame, fitted: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` doesn't call toxic, with all their columns, whatever their names.

    Null and empty texts stay, rows with null ids are treated as any others, and of repeated rows all go or all stay;
    an empty table gives an empty one.
    """
    tag = tag_column(docs.sparkSession, fitted)
    r = docs.select(packed(docs).alias("r"))
    return r.select("r", tag(F.col("r.text").cast("string"))["score"].alias("s")).where(F.col("s") < least).select("r.*")
