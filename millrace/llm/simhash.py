"""Near-duplicates by SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounds, bucketed, discard, materialise, mix64, packed, release, sorted_groups, text_of, utf8
from .components import components
from .words import RunHash, word_hashes

#: Fingerprints of a text, and bits of each.
TABLES, BITS = 6, 48
#: Fingerprints up to RADIUS bits apart meet: each emits what lies within half of it.
RADIUS = 2
#: Words in a shingle, and shingles in a sketch, by which colliding pairs are verified.
SHINGLE, SKETCH = 3, 256
#: Further keys of a text from its shingles, each of the least under so many hashes: texts of
#: Jaccard similarity J share one with probability 1 - (1 - J**ROWS)**BANDS, 0.97 at J = 0.5.
BANDS, ROWS = 12, 2
#: Least estimated Jaccard similarity of shingles of two near-duplicates.
SIMILAR = 0.5
#: Minima of shingles of which a text's signature holds two bits each, and how many must agree for a comparison of two
#: texts that share a key but are unlike its head. Of texts of similarity 0.5 40 agree on average, with a standard deviation of 4.
MINIMA, AGREE = 64, 28
#: Bits of a variant, besides its table, that say where it goes in the shuffle.
PLACE = 20
#: Bytes of text that are fingerprinted in one go.
BLOCK = 1 << 18

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TABLES fingerprints (n x TABLES, int64) of texts given by their words' hashes.

    A word weighs the square root of its number in the text, in sixteenths; each bit of a
    fingerprint is the sign of the weighted sum over the words' hash bits.
    """
    n = len(offsets) - 1
    out = np.zeros((n, TABLES), np.int64)
    if not len(words):
        return out
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])))
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(w)])))
    w, o = w[at], o[at]
    weight = np.rint(16 * np.sqrt(count)).astype(np.float32)
    lanes = -(-TABLES * BITS // 64)
    raw = np.stack([mix64(w + np.uint64(0x1000193 * (i + 1))) for i in range(lanes)], axis=1)
    bits = np.unpackbits(raw.view(np.uint8).reshape(len(w), -1), axis=1)[:, : TABLES * BITS]
    first = bounds(o)
    # sums of whole numbers below 2**24 are exact in single precision
    sums = np.stack([weight[x:y] @ bits[x:y].astype(np.float32) for x, y in zip(first[:-1].tolist(), first[1:].tolist())])
    signs = 2 * sums >= np.add.reduceat(weight, first[:-1])[:, None]
    power = np.int64(1) << np.arange(BITS, dtype=np.int64)
    out[o[first[:-1]]] = signs.reshape(len(signs), TABLES, BITS) @ power
    return out


def bands(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys of BITS bits (n x BANDS, int64) of texts given by their shingles, of which each has one at least."""
    keys = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    if not len(keys):
        return keys.astype(np.int64)
    factors = mix64(np.arange(BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i, factor in enumerate(factors):
            keys[:, i // ROWS] = mix64(keys[:, i // ROWS] ^ np.minimum.reduceat(shingles * factor, offsets[:-1]))
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two bits of each of MINIMA minima (n x 2, int64) of texts given by their shingles, of which each has one at least."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    if not len(out):
        return out.astype(np.int64)
    factors = mix64(np.arange(1000, 1000 + MINIMA, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i, factor in enumerate(factors):
            bits = mix64(np.minimum.reduceat(shingles * factor, offsets[:-1])) & np.uint64(3)
            out[:, i // 32] |= bits << np.uint64(2 * (i % 32))
    return out.view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct 32-bit hashes of a text's shingles, sorted."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    if len(x) > 4 * SKETCH:
        x = np.partition(x, 4 * SKETCH)[: 4 * SKETCH]
        low = np.unique(x)
        if len(low) >= SKETCH:
            return low[:SKETCH]
        x = (shingles >> np.uint64(32)).astype(np.uint32)  # many repeats among the least
    return np.unique(x)[:SKETCH]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common hashes among the least SKETCH of both sketches together."""
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    distinct = len(both) - int(same.sum())
    k = min(SKETCH, distinct) if len(a) >= SKETCH or len(b) >= SKETCH else distinct
    if not k:
        return 0.0
    rank = np.cumsum(np.concatenate(([True], ~same)))
    return int((same & (rank[1:] <= k)).sum()) / k


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        digests, prints, sketches, signs = [], [], [], []
        for lo, hi in blocks(np.diff(offsets), BLOCK):
            words, at = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            shingles = RunHash(words)(SHINGLE)
            own_shingles = [shingles[s : e - SHINGLE + 1] if e - s >= SHINGLE else words[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist()) if e > s]
            keys = np.zeros((hi - lo, BANDS), np.int64)
            every, ends = np.concatenate(own_shingles or [words]), np.cumsum([0, *map(len, own_shingles)])
            keys[np.diff(at) > 0] = bands(every, ends)
            signs.append(np.zeros((hi - lo, 2), np.int64))
            signs[-1][np.diff(at) > 0] = signatures(every, ends)
            prints.append(np.hstack([fingerprints(words, at), keys]))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
                own = words[s:e]
                digests.append(xxhash.xxh128_digest(own.tobytes()) if e > s else None)
                sketches.append((sketch(shingles[s : e - SHINGLE + 1]) if e - s >= SHINGLE else np.unique((own >> np.uint64(32)).astype(np.uint32))).tobytes())
        prints = np.concatenate(prints) if prints else np.zeros((0, TABLES + BANDS), np.int64)
        signs = np.concatenate(signs) if signs else np.zeros((0, 2), np.int64)
        yield pa.record_batch(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(prints.tolist(), pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(signs[:, 0]), pa.array(signs[:, 1])],
            names=["doc_id", "digest", "prints", "sketch", "s1", "s2"],
        )
        release()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of the nodes that share a variant. Distinct fingerprints lie within half the radius
    of the variant, so there are at most BITS + 1 of them; large groups are taken in slices."""
    for table in sorted_groups(batches, "v"):
        v, a = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("v", "a"))
        edge = bounds(v)
        size = np.diff(edge)
        left, right = [], []
        for n in np.unique(size[size > 1]).tolist():
            starts = edge[:-1][size == n]
            if n > 1000:
                for s in starts.tolist():
                    group = np.unique(a[s : s + n])
                    for i in range(len(group) - 1):
                        yield pa.record_batch([pa.array(np.full(len(group) - i - 1, group[i])), pa.array(group[i + 1 :])], schema=PAIR)
                continue
            x, y = np.triu_indices(n, 1)
            step = max(1, 1_000_000 // len(x))
            for k in range(0, len(starts), step):
                rows = a[starts[k : k + step, None] + np.arange(n)]
                left.append(np.minimum(rows[:, x], rows[:, y]).ravel())
                right.append(np.maximum(rows[:, x], rows[:, y]).ravel())
                if sum(map(len, left)) >= 1_000_000:
                    yield _distinct(left, right)
                    left, right = [], []
        if left:
            yield _distinct(left, right)


def _distinct(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.stack([x, y], axis=1)[x != y], axis=0)
    return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=PAIR)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            same = [jaccard(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= least for p, q in zip(x, y)]
            kept = batch.filter(pa.array(same, pa.bool_()))
            yield pa.record_batch([kept.column(0), kept.column(1)], schema=PAIR)

    return run


def verified(nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes that are similar enough: those whose signatures agree in AGREE minima are compared by sketch."""
    pairs = materialise(pairs, "simhash-pairs")
    # repeated ids can hold several texts: any of them serves
    chosen = nodes.groupBy("node").agg(F.min(F.struct("sketch", "s1", "s2")).alias("i"))
    signs = chosen.select("node", "i.s1", "i.s2")
    likely = pairs.join(signs.toDF("a", "s1", "s2"), "a").join(signs.toDF("b", "t1", "t2"), "b")
    likely = materialise(likely.where(_agreeing("s1", "t1") + _agreeing("s2", "t2") >= AGREE).select("a", "b"), "simhash-likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sketches = chosen.select("node", "i.sketch").join(ids, "node", "left_semi")
    a, b = sketches.toDF("a", "x"), sketches.toDF("b", "y")
    sure = materialise(likely.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long"), "simhash-sure")
    discard(pairs, likely)
    return sure


def _agreeing(a: str, b: str) -> Column:
    """The number of pairs of bits in which two longs agree."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(F.bitwise_not(differ.bitwiseOR(F.shiftrightunsigned(differ, 1))).bitwiseAND(F.lit(0x5555555555555555)))


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, group_id) for every document; ``group_id`` is the least id of its near-duplicates.

    Words (in lower case, punctuation aside) are hashed; texts of the same words are one node.
    A node has TABLES SimHash fingerprints of BITS bits. Each distinct fingerprint emits
    itself and all variants within RADIUS / 2 bits; variants are shuffled, and fingerprints that
    meet are within RADIUS bits. The nodes of a
    fingerprint are paired with the least of them. Texts with many edits have word bags too far apart
    for that: BANDS keys from the shingles bring them together, and nodes that share a key are paired alike. Nodes that are not
    similar to the least are paired with all others of the fingerprint or key whose signatures agree in AGREE minima at least, and emit variants too. Pairs are deduplicated
    and verified: the Jaccard similarity of their SHINGLE-word shingles, estimated from
    the SKETCH least hashes, must be at least ``least``. Groups are the connected components.

    Documents without any word, null and empty texts included, are groups of their own. Rows
    with a null id are left out. Rows with equal ids are one document, and one group. Ties
    don't matter, an empty table gives an empty one, and other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id IS NOT NULL")
    rows = materialise(narrow.mapInArrow(_describe, "doc_id long, digest binary, prints array<long>, sketch binary, s1 long, s2 long"), "simhash-rows")
    # one row a text: copies are counted by digest, with partial aggregation, so that any number of them loads no task; the row of the least
    # id stands for all. Rows are shuffled by id, once, and stay in buckets by it, as sketches are sought by node.
    least_ids = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")).withColumnRenamed("digest", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.coalesce(F.col("digest") == F.col("text"), F.lit(False))  # no key of the join, whose partitions are to be by id alone
    firsts = rows.repartition(n, "doc_id").join(least_ids, (F.col("doc_id") == F.col("node")) & same).drop("doc_id", "text")
    nodes = bucketed(firsts.dropDuplicates(["node", "digest"]), "simhash-nodes", "node")
    keys = nodes.select(F.posexplode("prints").alias("t", "p"), "node", "s1", "s2")
    keys = keys.select((F.shiftleft(F.col("t").cast("long"), BITS).bitwiseOR(F.col("p"))).alias("key"), "node", "s1", "s2")
    heads = bucketed(keys.repartition(n, "key").join(keys.groupBy("key").agg(F.min("node").alias("head")), "key"), "simhash-heads", "key")
    first = verified(nodes, heads.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), least)
    # who isn't joined to the head of a key is compared with all others of it: first by signature, then by sketch
    rest = heads.where("node <> head").join(first.toDF("head", "node"), ["head", "node"], "left_anti").select("key", "node", "head", "s1", "s2")
    rest = materialise(rest, "simhash-rest")
    others = rest.join(heads.select("key", F.col("node").alias("other"), F.col("s1").alias("t1"), F.col("s2").alias("t2")), "key")
    others = others.where("other <> node AND other <> head").where(_agreeing("s1", "t1") + _agreeing("s2", "t2") >= AGREE)
    others = others.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    # heads and the rest emit variants
    emitting = heads.where("node = head").select("key", "node").unionByName(rest.select("key", "node")).where(F.shiftright("key", BITS) < TABLES)
    variants = emitting.select(
        F.explode(F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << i)) for i in range(BITS)])).alias("v"), F.col("node").alias("a")
    )
    # rows go by the table and PLACE bits of the variant: equal ones still meet, and most variants of a fingerprint travel together, which packs well
    met = variants.repartition(F.shiftright("v", BITS - PLACE)).sortWithinPartitions("v").mapInArrow(_pairs, "a long, b long")
    second = verified(nodes, others.unionByName(met).distinct(), least)
    sure = first.unionByName(second)
    # rows with equal ids tie their nodes together
    ties = rows.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    roots = components(sure.unionByName(ties))
    discard(nodes, heads, rest, first, second)
    return (
        rows.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    )


def drop_near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stand for their group of ``near_duplicates``: the one with the least
    id, and of rows with that id the first by text; of equal rows one stays. Rows with a null id, and rows whose text
    is null, empty or without words (unless their id is repeated), stay. All columns are kept, whatever their names; an empty table gives an empty one."""
    groups = near_duplicates(docs, least)
    heads = groups.where("doc_id = group_id").select(F.col("doc_id").alias("_id"))
    rows = docs.select(packed(docs).alias("r"), F.col("doc_id").cast("long").alias("_id"))
    first = Window.partitionBy("_id").orderBy(F.col("r.text"))
    kept = rows.where("_id IS NOT NULL").join(heads, "_id").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("r.*").unionByName(rows.where("_id IS NULL").select("r.*"))
