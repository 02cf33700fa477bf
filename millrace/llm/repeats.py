"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounds, mix64, release, sorted_groups, text_of, utf8
from .words import RunHash, sliding_min, word_hashes

#: Words of the shortest passage that counts, and words by which minimisers are chosen.
MIN_WORDS, GRAM = 50, 12
#: Suffixes that may share their first words before they are compared window by window across the cluster, and the
#: number of such beginnings that are treated so at most: the most frequent ones, 8 MB of them.
HOT, HOT_KEYS = 50_000, 1_000_000
#: Suffixes that a task compares in one go; a group of equal beginnings comes whole.
ROWS = 60_000
#: Windows whose minimisers are sought in one go: positions have 24 bits there.
STRETCH = 1 << 23

SUFFIX = "key long, doc_id long, row long, first int, left int, context binary"
FOUND = "doc_id long, row long, first int, last int, documents int"


class Suffixes:
    """The retained suffixes of texts given by their words: one for each minimiser.

    A window is a run of ``least`` words in one text. Its minimiser is its leftmost least gram, thus chosen by content
    alone; neighbouring windows with one minimiser make one suffix, which begins at the minimiser. ``key`` is the hash of its first
    ``gram`` words, ``begin`` the start of its first window, ``left`` the words of that window before the minimiser, and
    ``size`` the number of its windows.
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray, least: int, gram: int):
        self.words, self.least, self.gram = words, least, gram
        n = len(words) - least + 1
        self.text = self.begin = self.left = self.size = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.int64)
        if n <= 0:
            return
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        start = np.flatnonzero(owner[:n] == owner[least - 1 :][:n])
        if not len(start):
            return
        grams = RunHash(words)(gram)
        chosen = np.empty(n, np.int64)
        for a in range(0, n, STRETCH):
            part = grams[a : min(a + STRETCH, n) + least - gram]
            # 40 bits of the gram's hash, then the position within the stretch
            order = (mix64(part) >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
            low = (sliding_min(order, least - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            chosen[a : a + len(low)] = low + a
        chosen = chosen[start]
        head = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[start][1:] != owner[start][:-1]))))
        self.begin = start[head]
        self.text = owner[self.begin]
        self.left = chosen[head] - self.begin
        self.size = np.diff(np.concatenate((head, [len(start)])))
        self.key = grams[chosen[head]].view(np.int64)

    def contexts(self, chosen: np.ndarray) -> pa.Array:
        """The words around the chosen suffixes' beginnings that their windows cover, without the beginnings
        themselves, as 32-bit hashes that are not 0."""
        size = self.size[chosen] - 1 + self.least - self.gram
        owner = np.repeat(np.arange(len(chosen)), size)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        at = self.begin[chosen][owner] + nth + np.where(nth >= self.left[chosen][owner], self.gram, 0)
        flat = np.maximum((self.words[at] >> np.uint64(32)).astype(np.uint32), 1)
        ends = np.concatenate(([0], np.cumsum(4 * size)))
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Suffixes]]:
    """(ids, digests of the texts, offsets of the texts in words, suffixes) of blocks of texts."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in blocks(np.diff(offsets)):
            part = data[offsets[lo] : offsets[hi]]
            cut = offsets[lo : hi + 1] - offsets[lo]
            words, at = word_hashes(part, cut)
            found = Suffixes(words, at, least, gram)
            if len(found.text):
                raw = part.tobytes()
                digests = np.array([xxhash.xxh64_intdigest(raw[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())], np.uint64).view(np.int64)
                yield ids[lo:hi], digests, at, found
        release()


def _keys(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, found in _blocks(batches, least, gram):
            key, n = np.unique(found.key, return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["key", "n"])

    return run


def _retain(least: int, gram: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, at, s in _blocks(batches, least, gram):
            kept = np.flatnonzero(~np.isin(s.key, hot.value)) if len(hot.value) else np.arange(len(s.key))
            text = s.text[kept]
            yield pa.record_batch(
                [
                    pa.array(s.key[kept]), pa.array(ids[text]), pa.array(digests[text]), pa.array((s.begin - at[s.text])[kept].astype(np.int32)),
                    pa.array(s.left[kept].astype(np.int32)), s.contexts(kept),
                ],
                names=["key", "doc_id", "row", "first", "left", "context"],
            )

    return run


def _windows(least: int, gram: int, hot):
    """Every window of the suffixes with hot keys, by two hashes of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, at, s in _blocks(batches, least, gram):
            kept = np.flatnonzero(np.isin(s.key, hot.value))
            if not len(kept):
                continue
            size = s.size[kept]
            begin = np.repeat(s.begin[kept], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text = np.repeat(s.text[kept], size)
            a, b = RunHash(s.words)(least)[begin], RunHash(mix64(s.words))(least)[begin]
            yield pa.record_batch(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[text]), pa.array(digests[text]), pa.array((begin - at[text]).astype(np.int32))],
                names=["a", "b", "doc_id", "row", "first"],
            )

    return run


def _sorted(group: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row in the order of its group and words, and for each place in that order the number
    of words in common with its neighbour before it, -1 where that is of another group."""
    wide = np.empty((len(group), matrix.shape[1] + 1), ">u4")
    wide[:, 0], wide[:, 1:] = group, matrix
    order = np.argsort(np.ascontiguousarray(wide).view(f"V{4 * wide.shape[1]}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    wide = wide[order]
    differ = np.ones((len(order), wide.shape[1] + 1), bool)
    differ[1:, :-1] = wide[1:] != wide[:-1]
    return place, differ.argmax(axis=1) - 1 if len(order) else np.zeros(0, np.int64)


def compare(key: np.ndarray, doc: np.ndarray, left: np.ndarray, size: np.ndarray, context: np.ndarray, ends: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, window, documents) for every window that another document holds too; windows count from a suffix's first.

    Suffixes are sorted by the words to the right of their common beginning, and by those to the left of it, nearest first.
    One that has too few words in common with its neighbours on both sides is left at once. For each number of words on the left, the
    matches with the neighbours are extended: suffixes that agree in so many words to the left and in the rest to
    the right lie together in both orders, and share that window.
    """
    n = len(key)
    group = np.repeat(np.arange(len(bounds(key)) - 1), np.diff(bounds(key)))
    right = size - 1 + wide - left
    cols = np.arange(wide)
    at = ends[:-1, None] + left[:, None] + cols
    tail = np.where(cols < right[:, None], context[np.minimum(at, len(context) - 1)], 0) if len(context) else np.zeros((n, wide), np.uint32)
    at = ends[:-1, None] + left[:, None] - 1 - cols
    front = np.where(cols < left[:, None], context[np.maximum(at, 0)], 0) if len(context) else np.zeros((n, wide), np.uint32)
    (r, common_r), (l, common_l) = _sorted(group, tail), _sorted(group, front)  # noqa: E741

    def most(place: np.ndarray, common: np.ndarray) -> np.ndarray:
        return np.maximum(common, np.concatenate((common[1:], [-1])))[place]

    alive = np.flatnonzero(most(r, common_r) + most(l, common_l) >= wide)
    rows, windows, counts = [], [], []
    for i in range(wide + 1):  # words to the left
        own = alive[(left[alive] >= i) & (left[alive] - size[alive] < i)]
        if not len(own):
            continue
        x = np.maximum.accumulate(np.where(common_r < wide - i, np.arange(n), 0))[r[own]]
        y = np.maximum.accumulate(np.where(common_l < i, np.arange(n), 0))[l[own]]
        value = x * n + y
        order = np.lexsort((doc[own], value))
        v, d = value[order], doc[own][order]
        edge = bounds(v)
        fresh = np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1]))).astype(np.int64)
        count = np.repeat(np.add.reduceat(fresh, edge[:-1]), np.diff(edge))
        hit = count > 1
        rows.append(own[order[hit]])
        windows.append(left[own[order[hit]]] - i)
        counts.append(count[hit])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    rows, windows, counts = map(np.concatenate, (rows, windows, counts))
    order = np.lexsort((windows, rows))
    return rows[order], windows[order], counts[order]


def _extend(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "key", ROWS):
            key = table.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            edge = bounds(key)
            several = np.repeat(np.diff(edge) > 1, np.diff(edge))
            if not several.any():
                continue
            table = table.filter(pa.array(several)).combine_chunks()
            key, doc, row, first, left = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "row", "first", "left"))
            held = table.column("context").combine_chunks()
            ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
            context = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy().view(np.uint32)
            ends = (ends - ends[0]) // 4
            size = np.diff(ends) - (least - gram) + 1
            owner, window, count = compare(key, doc, left.astype(np.int64), size, context, ends, least - gram)
            if not len(owner):
                continue
            # neighbouring windows that are repeated make one stretch
            head = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1] + 1) | (owner[1:] != owner[:-1]))))
            tail = np.concatenate((head[1:], [len(owner)])) - 1
            o = owner[head]
            yield pa.record_batch(
                [
                    pa.array(doc[o]), pa.array(row[o]), pa.array((first[o] + window[head]).astype(np.int32)), pa.array((first[o] + window[tail]).astype(np.int32)),
                    pa.array(np.maximum.reduceat(count, head).astype(np.int32)),
                ],
                names=["doc_id", "row", "first", "last", "documents"],
            )
            release()

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start, end, words, documents) for every maximal passage of at least ``least`` words
    whose runs of ``least`` words all occur in another document too.

    Suffixes are retained where a minimiser is: the least hash of ``gram`` words among those
    of some run of ``least`` words. Each carries the words around its beginning that such runs cover, fewer than 2 * ``least``. Suffixes are
    shuffled by the words they begin with and sorted; those that differ from both neighbours are left. Matches are then extended,
    word by word, to the left and to the right, so that any two equal runs are found whatever else shares their minimiser,
    without comparing all pairs. Stretches of one text that overlap are joined.

    Beginnings that more than ``hot`` suffixes share, such as those of boilerplate, are counted beforehand. Their windows are
    counted one by one across the cluster, with partial aggregation, so that no task holds such a group; the result is the same.

    ``start`` and ``end`` count words from 0, ``end`` exclusive; a word is a run of ASCII
    letters, digits and characters beyond ASCII, in lower case. ``documents`` is the most documents that share one
    run of the passage. Words are compared by hashes of 32 bits, all words of a run one by one; runs of hot beginnings by 128 bits. Rows that share an id are one
    document, so that repeats among them don't count; equal rows appear once. Rows with a
    null id are left out; null, empty and short texts have no passage; texts may be of any length; an empty table
    gives an empty one. Other columns are not read.
    """
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    frequent = narrow.mapInArrow(_keys(least, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    keys = frequent.orderBy(F.desc("n")).limit(HOT_KEYS).select("key").toArrow().column("key").to_numpy()
    held = spark.sparkContext.broadcast(np.sort(keys))  # at most HOT_KEYS numbers
    kept = narrow.mapInArrow(_retain(least, gram, held), SUFFIX)
    found = kept.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_extend(least, gram), FOUND)
    if len(keys):
        windows = narrow.mapInArrow(_windows(least, gram, held), "a long, b long, doc_id long, row long, first int")
        shared = windows.select("a", "b", "doc_id").distinct().groupBy("a", "b").agg(F.count("*").cast("int").alias("documents")).where("documents > 1")
        found = found.unionByName(windows.join(shared, ["a", "b"]).select("doc_id", "row", "first", F.col("first").alias("last"), "documents"))
    inside = Window.partitionBy("doc_id", "row").orderBy("first")
    reach = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + least
    stretch = found.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn(
        "n", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        stretch.groupBy("doc_id", "row", "n")
        .agg(F.min("first").alias("start"), (F.max("last") + least).alias("end"), F.max("documents").alias("documents"))
        .select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("words"), "documents")
    )
