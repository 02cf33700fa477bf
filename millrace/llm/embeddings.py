"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, discard, materialise, mix64, release, sorted_groups
from .components import components, forest

#: Trees by which vectors are spread over the cluster, trees that are grown in each of their cells, vectors in a leaf, and the share
#: of a node on either side of the median that goes both ways.
TREES, INNER, LEAF, SPILL = 4, 2, 1024, 0.05
#: Vectors in a cell, about; a cell is compared within one task.
CELL = 50_000
#: Bytes of the sample on which the cells' splits are fitted, and sampled vectors in a cell at least. All vectors are then routed.
SAMPLE_BYTES, SAMPLE_LEAST = 64 << 20, 8
SEED = 29
#: Vectors travel in half precision. Scalar products of unit vectors are off by no more than this; pairs that near to the
#: threshold are verified in full precision.
MARGIN = 0.0011


def directions(dim: int, levels: int, *seed: int) -> np.ndarray:
    """The random directions of a tree's levels, side by side; the same in every task."""
    return np.random.default_rng([x & 0x7FFFFFFFFFFFFFFF for x in (dim, *seed)]).standard_normal((levels, dim)).astype(np.float32).T


def split(p: np.ndarray, spill: float) -> tuple[float, float]:
    """(low, high) for the projections of a node: those up to ``high`` go left, those from ``low`` on go right.

    Around the median both hold. With too many ties for that, they are parted at the median without spill; if all are equal all go left.
    """
    low, mid, high = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill], method="nearest")
    least, most = p.min(), p.max()
    if high < most and low > least:
        return low, high
    if least == most:
        return np.inf, np.inf
    if mid == most:
        mid = p[p < most].max()
    return np.nextafter(mid, np.float32(np.inf)), mid


def fit_tree(x: np.ndarray, levels: int, spill: float, *seed: int) -> np.ndarray:
    """(2, 2**levels) bounds low and high of all nodes of a tree from sampled vectors, by heap order from 1. A node without
    sampled vectors has no split: all go left."""
    out = np.full((2, 1 << levels), np.inf, np.float32)
    if not levels:
        return out
    p = x @ directions(x.shape[1], levels, *seed)
    rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
    for level in range(levels):
        own = p[rows, level]
        order = np.argsort(node, kind="stable")
        edge = bounds(node[order])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            out[:, node[order[lo]]] = split(own[order[lo:hi]], spill)
        rows, node = descend(rows, node, own, out)
    return out


def descend(rows: np.ndarray, node: np.ndarray, own: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the children of their nodes, one or both, by their projections."""
    left, right = own <= cuts[1, node], own >= cuts[0, node]
    return np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))


def leaves(x: np.ndarray, leaf: int, spill: float, *seed: int) -> Iterator[np.ndarray]:
    """The leaves of one tree over the rows of x, as arrays of row numbers. Rows that no direction tells apart stay together."""
    open_: list[tuple[int, np.ndarray]] = [(0, np.arange(len(x)))]
    levels: list[np.ndarray] = []
    while open_:
        depth, rows = open_.pop()
        if len(rows) <= leaf or depth == 64:
            yield rows
            continue
        if depth == len(levels):
            levels.append(x @ directions(x.shape[1], 1, *seed, depth)[:, 0])
        own = levels[depth][rows]
        low, high = split(own, spill)
        if np.isinf(low):
            yield rows
        else:
            open_ += [(depth + 1, rows[own <= high]), (depth + 1, rows[own >= low])]


def alike(x: np.ndarray, threshold: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors whose cosine is at least ``threshold``, and their cosines."""
    a, b, s = [], [], []
    for i in range(0, len(x), block):
        for j in range(i, len(x), block):
            product = x[i : i + block] @ x[j : j + block].T
            r, c = np.nonzero(product >= threshold)
            keep = r + i < c + j
            a.append(r[keep] + i)
            b.append(c[keep] + j)
            s.append(product[r[keep], c[keep]])
    return np.concatenate(a), np.concatenate(b), np.concatenate(s)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors at unit length, with a digest; those without a direction are left out."""
    for batch in batches:
        ids, digests, out = [], [], []
        for key, item in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = item.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = np.sqrt((x * x).sum())
            if len(x) and np.isfinite(norm) and norm > 0:
                v = (x / norm).astype(np.float32)
                ids.append(key)
                digests.append(xxhash.xxh128_digest(v.tobytes()))
                out.append(v)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.list_(pa.float32()))], names=["id", "digest", "vec"])


def _route(dim: int, trees: int, levels: int, seed: int, held):
    """One row for each cell that a vector is in: (g, node, vec), the vector in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = held.value
        ways = [directions(dim, levels, seed, t) for t in range(trees)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            g, at = [], []
            for t in range(trees):
                rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
                if levels:
                    p = x @ ways[t]
                    for level in range(levels):
                        rows, node = descend(rows, node, p[rows, level], cuts[t])
                at.append(rows)
                g.append(mix64((node * trees + t).astype(np.uint64) ^ mix64(np.full(1, dim, np.uint64))).view(np.int64))
            at = np.concatenate(at)
            raw = np.ascontiguousarray(x[at].astype(np.float16))
            ends = np.arange(len(at) + 1, dtype=np.int32) * 2 * dim
            vec = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            yield pa.record_batch([pa.array(np.concatenate(g)), batch.column(0).take(pa.array(at)), vec], names=["g", "node", "vec"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def _compare(threshold: float, leaf: int, spill: float, inner: int, seed: int):
    """(a, b, sure): pairs that are alike, as a forest in each leaf, and those that are too near to the threshold to say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "g", CELL):
            g, nodes = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("g", "node"))
            edge = bounds(g)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if hi - lo < 2:
                    continue
                order = np.argsort(nodes[lo:hi], kind="stable")  # arrival order doesn't matter
                vec = table.column("vec").slice(lo, hi - lo).combine_chunks()
                ends = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1]
                x = np.frombuffer(vec.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float16).reshape(hi - lo, -1)[order].astype(np.float32)
                own = nodes[lo:hi][order]
                a, b, sure = [], [], []
                for tree in range(inner):
                    for rows in leaves(x, leaf, spill, seed, int(g[lo]), tree):
                        i, j, s = alike(x[rows], threshold - MARGIN)
                        if not len(i):
                            continue
                        i, j = own[rows[i]], own[rows[j]]
                        clear = s >= threshold + MARGIN
                        p, q = forest(i[clear], j[clear])
                        root = dict(zip(p.tolist(), q.tolist()))
                        near = [(u, v) for u, v in zip(i[~clear].tolist(), j[~clear].tolist()) if root.get(u, u) != root.get(v, v)]
                        a += [p, np.array([u for u, _ in near], np.int64)]
                        b += [q, np.array([v for _, v in near], np.int64)]
                        sure += [np.ones(len(p), bool), np.zeros(len(near), bool)]
                if a:
                    a, b = np.concatenate(a), np.concatenate(b)
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(sure))], names=["a", "b", "sure"])
            release()

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, inner: int = INNER, leaf: int = LEAF, spill: float = SPILL, cell: int = CELL, seed: int = SEED, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """(vec_id, group_id) for every vector; ``group_id`` is the least id of its near-duplicates, which
    are the connected components of the verified pairs.

    Equal vectors are one node. Each of ``trees`` trees splits the nodes recursively at the median of
    their projections on the random direction of the level, and those within ``spill`` of the median go to both
    sides. The splits of the upper levels, down to cells of about ``cell`` vectors, are fitted on a sample of ``sample_bytes`` at most, or as far as
    a cell has SAMPLE_LEAST sampled vectors; every vector is then routed to its cells in one pass, and shuffled once, in half precision. In each cell
    ``inner`` trees are grown further, from all vectors in it, down to ``leaf`` vectors. Within leaves all pairs are compared, and those with
    a cosine of at least ``threshold``, in full precision where half doesn't tell, are united over all trees. It works alike at every size.

    The search is approximate: a pair is found if some tree has both in a leaf. Vectors that no
    direction tells apart stay in one leaf, however many they are. Vectors of different length are never
    compared. Null, empty and zero vectors, and those with a null or infinite
    component, are groups of their own. Rows with a null id are left out; rows with equal ids are
    one group; an empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("vec")).where("id IS NOT NULL")
    usable = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull()))
    unit = usable.mapInArrow(_unit, "id long, digest binary, vec array<float>")
    # one row a vector, by partial aggregation: a vector with any number of copies loads no task
    nodes = materialise(unit.groupBy("digest").agg(F.min("id").alias("node"), F.any_value("vec").alias("vec")).withColumn("d", F.size("vec")), "vectors")
    ties = unit.select("id", "digest").join(nodes.select("digest", "node"), "digest").where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    found = None
    for dim, n in sorted(nodes.groupBy("d").count().collect()):  # a row for each length of vectors
        own = nodes.where(F.col("d") == dim).select("node", "vec")
        most = max(1, sample_bytes // (4 * dim))
        levels = max(0, int(np.ceil(np.log2(n / cell)))) if n > cell else 0
        levels = min(levels, max(0, int(np.log2(max(1, min(n, most)) / SAMPLE_LEAST))))
        cuts = np.zeros((trees, 2, 1), np.float32)
        if levels:
            share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
            sample = _matrix(own.where(share).select("vec").toArrow().column("vec").combine_chunks())
            cuts = np.stack([fit_tree(sample, levels, spill, seed, t) for t in range(trees)])
        held = spark.sparkContext.broadcast(cuts)  # two numbers a node, and fewer nodes than sampled vectors
        routed = own.mapInArrow(_route(dim, trees, levels, seed, held), "g long, node long, vec binary")
        found = routed if found is None else found.unionByName(routed)
    if found is None:
        edges = ties
    else:
        met = found.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_compare(threshold, leaf, spill, inner, seed), "a long, b long, sure boolean")
        met = materialise(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "vector-pairs")
        x, y = nodes.select(F.col("node").alias("a"), F.col("vec").alias("x")), nodes.select(F.col("node").alias("b"), F.col("vec").alias("y"))
        product = F.aggregate(F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
        near = met.where("NOT sure").join(x, "a").join(y, "b").where(F.size("x") == F.size("y")).where(product >= threshold)
        edges = met.where("sure").select("a", "b").unionByName(near.select("a", "b")).unionByName(ties)
    roots = components(edges)
    discard(nodes)
    return (
        rows.select(F.col("id").alias("vec_id")).distinct().join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("root", "vec_id").alias("group_id"))
    )
