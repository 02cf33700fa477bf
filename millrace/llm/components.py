"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node of its component, itself excepted."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) >= 1_000_000:  # a forest has fewer edges than nodes
            a, b = forest(a, b)
            yield pa.record_batch([pa.array(a), pa.array(b)], schema=EDGE)
            a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pa.record_batch([pa.array(a), pa.array(b)], schema=EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, where root is the least node of its
    component; roots are rows too.

    Partitions first contract their own edges to forests. Then the two star steps
    alternate until nothing changes; each round is written to the shared folder. Null
    ends and loops are ignored; an empty table gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = materialise(edges.mapInArrow(_contract, "a long, b long").distinct(), "links")
    before = None
    while True:
        # large star: every larger neighbour of a node is tied to the least neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(near, "a")
            .select("b", "a", F.least("m", "a").alias("m"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # small star: the smaller neighbours of a node, and itself, are tied to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        old, links = links, materialise(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            "links",
        )
        discard(old)
        state = links.agg(F.count("*"), F.sum(F.hash("a", "b")), F.countDistinct("a")).first()
        if state[0] == state[2] and tuple(state) == before:  # one root a node, and stable
            break
        before = tuple(state)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
