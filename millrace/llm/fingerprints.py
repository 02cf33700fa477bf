"""Document fingerprints: improbable-feature digests in chained Bloom filters
(after Roussev, Data Fingerprinting with Similarity Digests, 2010)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentHash, blocks, materialise, text_of, utf8
from .words import sliding_min

#: Bytes of a feature, positions among which the rarest one is sought, and how often a
#: feature must be the rarest to be selected. A text has about one feature per 8 bytes, so that
#: references of a line or two have several.
WINDOW, SPAN, POPULARITY = 32, 8, 3
#: Bits of a filter, bits set by a feature, features in a filter before the next is begun.
BITS, HASHES, CAPACITY = 2048, 5, 64
#: Common bits count beyond this share of the way from chance to the greatest possible, and
#: beyond so many standard deviations of chance.
SHARE, DEVIATIONS = 0.3, 5
#: References that overlap a document more than this are its matches.
BEYOND = 0.0
#: Entropy is cut into so many steps.
STEPS = 1000
#: Bytes of text whose entropies are counted in one go, and lanes in which that is done.
BLOCK, LANES = 1 << 21, 4096
#: Largest table of reference texts, in bytes, whose digests are sent to every task.
REFERENCE_BYTES = 16 << 20

DIGEST = "doc_id long, features int, filters int, digest binary, hashes binary"
#: Type of the list of a document's matches.
MATCHES = "array<struct<id: bigint, overlap: double>>"

_C = np.arange(WINDOW + 1, dtype=float)
#: c * log2(c), scaled so that a window's sum becomes its entropy step.
_CLOGC = np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) / WINDOW / np.log2(WINDOW) * STEPS
_CLOGC = np.rint(_CLOGC * 32).astype(np.int32)
#: What the sum gains when a count of c becomes c + 1.
_GAIN = np.diff(_CLOGC)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """The entropy step, 0 to STEPS, of the window that begins at each byte.

    The bytes are laid out in lanes that advance together: at each step every lane takes
    one byte into its window's counts and lets one go, and the sum of c log c follows.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    width = max(256, -(-n // LANES))
    lanes = -(-n // width)
    padded = np.zeros(lanes * width + WINDOW, np.uint8)
    padded[: len(data)] = data
    # byte t of every lane lies in row t; the index of its count follows
    at = np.lib.stride_tricks.as_strided(padded, (width + WINDOW - 1, lanes), (1, width)).astype(np.int32)
    at += np.arange(lanes, dtype=np.int32) * 256
    counts = np.zeros(lanes * 256, np.int16)
    total = np.zeros(lanes, np.int32)
    out = np.empty((width, lanes), np.int16)
    for t in range(width + WINDOW - 1):
        if t >= WINDOW:
            i = at[t - WINDOW]
            c = counts.take(i) - 1
            counts[i] = c
            total -= _GAIN.take(c)
        i = at[t]
        c = counts.take(i)
        total += _GAIN.take(c)
        c += 1
        counts[i] = c
        if t >= WINDOW - 1:
            out[t - WINDOW + 1] = total >> 5
    out = np.ascontiguousarray(out.T).ravel()[:n]
    np.subtract(STEPS, out, out=out)
    return np.clip(out, 0, STEPS, out=out)


def selected(steps: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of the improbable features: those that are the leftmost rarest of at least
    POPULARITY of the SPAN-wide runs of positions. Shorter inputs have one run."""
    n = len(steps)
    if not n:
        return np.zeros(0, np.int64)
    key = (rank[steps].astype(np.int64) << 32) | np.arange(n)
    span = min(SPAN, n)
    least, width = key, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    wins = np.bincount(least & 0xFFFFFFFF, minlength=n)
    return np.flatnonzero((wins >= min(POPULARITY, n - span + 1)) & (rank[steps] < rank.max()))


def features(data: np.ndarray, rank: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the distinct selected features of a text, in order."""
    at = selected(entropy_steps(data) if steps is None else steps, rank)
    if not len(at):
        return np.zeros(0, np.uint64)
    hashes = SegmentHash(data)(at, at + WINDOW)
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def digest(data: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters (k x BITS/8 bytes) and the number of features in each."""
    return filters_of(features(data, rank))


def filters_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chained filters of features, and the number of features in each."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int32)
    k = -(-len(hashes) // CAPACITY)
    filters = np.zeros((k, BITS), np.uint8)
    row = np.arange(len(hashes)) // CAPACITY
    for i in range(HASHES):
        filters[row, (hashes >> np.uint64(11 * i)) % np.uint64(BITS)] = 1
    return np.packbits(filters, axis=1), np.bincount(row, minlength=k).astype(np.int32)


Digest = tuple[np.ndarray, np.ndarray, np.ndarray]


def block_digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[Digest]:
    """``digest`` of every text of a block of texts that lie end to end, in one go, and its features."""
    n = len(offsets) - 1
    steps = entropy_steps(data)
    valid = np.diff(offsets) - WINDOW + 1  # windows of each text
    long = valid >= SPAN + POPULARITY
    none = (np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint64))
    out = [none] * n
    for i in np.flatnonzero((valid > 0) & ~long).tolist():
        own = features(data[offsets[i] : offsets[i + 1]], rank, steps[offsets[i] : offsets[i] + valid[i]])
        out[i] = *filters_of(own), own
    if not long.any():
        return out
    ranked = rank[steps].astype(np.int64)
    least = sliding_min((ranked << 32) | np.arange(len(steps)), SPAN)
    # runs of SPAN windows that lie in one text
    starts = np.repeat(offsets[:-1][long], valid[long] - SPAN + 1)
    starts += np.arange(len(starts)) - np.repeat(np.cumsum(valid[long] - SPAN + 1) - (valid[long] - SPAN + 1), valid[long] - SPAN + 1)
    wins = np.bincount(least[starts] & 0xFFFFFFFF, minlength=len(steps))
    at = np.flatnonzero((wins >= POPULARITY) & (ranked < rank.max()))
    hashes = SegmentHash(data)(at, at + WINDOW)
    text = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((at, hashes, text))
    first = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])))[: len(order)]
    keep = np.sort(order[first])
    hashes, text = hashes[keep], text[keep]
    held = np.bincount(text, minlength=n)
    ends = np.concatenate(([0], np.cumsum(held)))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(held) - held, held)
    chain = -(-held // CAPACITY)
    base = np.cumsum(chain) - chain
    row = base[text] + nth // CAPACITY
    bits = np.zeros((int(chain.sum()), BITS), np.uint8)
    for i in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * i)) % np.uint64(BITS)] = 1
    bits, sizes = np.packbits(bits, axis=1), np.bincount(row, minlength=len(bits)).astype(np.int32)
    for i in np.flatnonzero(held).tolist():
        out[i] = bits[base[i] : base[i] + chain[i]], sizes[base[i] : base[i] + chain[i]], hashes[ends[i] : ends[i + 1]]
    return out


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int32)


def _scores(common: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Scores of pairs of filters with ca and cb bits: 0 for as many common bits as chance can
    give, 1 for the greatest possible number. Small filters need the larger share of theirs."""
    least = np.minimum(ca, cb)
    chance = ca * cb / BITS
    deviation = np.sqrt(chance * (1 - ca / BITS) * (1 - cb / BITS))
    cut = chance + np.maximum(SHARE * (least - chance), DEVIATIONS * deviation)
    return np.clip((common - cut) / np.maximum(least - cut, 1e-9), 0, 1)


def overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Similarity of two digests, 0 to 1: each filter of the shorter takes its best partner
    in the other, and the mean by their numbers of features is the score."""
    if len(a) > len(b) or (len(a) == len(b) and na.sum() > nb.sum()):
        a, na, b, nb = b, nb, a, na
    if not len(a) or not len(b):
        return 0.0
    common = _popcount(a[:, None, :] & b[None, :, :])
    score = _scores(common, _popcount(a)[:, None], _popcount(b)[None, :])
    return float((score.max(axis=1) * na).sum() / na.sum())


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy step among all byte windows of all documents: the rarest
    step has rank 0. Steps of no window, and constant windows (step 0), come last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                part = data[offsets[lo] : offsets[hi]]
                steps = entropy_steps(part)
                # windows over a boundary of documents don't count
                end = offsets[lo + 1 : hi] - offsets[lo]
                covered = np.zeros(len(part) + 1, np.int32)
                np.add.at(covered, np.maximum(end - WINDOW + 1, 0), 1)
                np.add.at(covered, end, -1)
                total += np.bincount(steps[np.cumsum(covered[:-1])[: len(steps)] <= 0], minlength=STEPS + 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["step", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(count, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(STEPS + 1)
    for step, n in rows:
        total[step] = n
    total[0] = 0
    order = np.lexsort((np.arange(STEPS + 1), np.where(total > 0, total, np.inf)))
    rank = np.empty(STEPS + 1, np.int32)
    rank[order] = np.arange(STEPS + 1)
    rank[total == 0] = STEPS
    return rank


def fingerprint_documents(docs: DataFrame, references: DataFrame, reference_id: str = "item_id", ranks: np.ndarray | None = None, beyond: float = BEYOND) -> DataFrame:
    """(doc_id, features, filters, digest, nearest, overlap, matches): a digest of every document, and
    the reference texts whose digests overlap it.

    Windows of WINDOW bytes are ranked by the rarity of their entropy among all windows of
    ``docs`` (or by the given ``ranks``, to make digests of several corpora comparable).
    Selected windows are inserted in chained Bloom filters of BITS bits; ``digest`` holds the
    filters one after another. ``matches`` holds (id, overlap), by id, for every reference whose normalised
    bit overlap, that of ``overlap()``, is more than ``beyond``. ``overlap`` is the greatest of all,
    and ``nearest`` the least id of those that reach it, null where nothing overlaps.
    A document and a reference are compared if they share a selected feature; bits that agree by chance alone are no match. Up to
    REFERENCE_BYTES of reference texts, their digests are sent to every task; beyond, documents and references are joined on features.

    Null, empty and shorter texts than a window have an empty digest and no overlap. Null and
    repeated ids pass through, each row on its own; no rows give no rows, and no references give no
    overlap. Other columns are not read.
    """
    if ranks is None:
        ranks = rarity(docs)

    def digested(df: DataFrame, key: str) -> DataFrame:
        narrow = df.select(F.col(key).cast("long").alias("doc_id"), text_of().alias("text"))
        return narrow.mapInArrow(_digests(ranks), DIGEST)

    spark = docs.sparkSession
    known = digested(references, reference_id).where("filters > 0 AND doc_id IS NOT NULL")
    size = references.select(F.sum(F.octet_length(text_of()))).first()[0] or 0
    columns = ["doc_id", "features", "filters", "digest"]
    if size <= REFERENCE_BYTES:
        table = known.select("doc_id", "features", "digest", "hashes").toArrow()  # digests and features are about three times as large as their texts
        local = sorted((i, n, bytes(d), bytes(h)) for i, n, d, h in zip(*(table.column(c).to_pylist() for c in table.column_names)))
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        rows = narrow.mapInArrow(_digests(ranks, spark.sparkContext.broadcast(local), beyond), f"{DIGEST}, matches {MATCHES}")
    else:
        known = materialise(known, "references").select(F.col("doc_id").alias("id"), F.col("features").alias("m"), F.col("digest").alias("reference"), "hashes")
        mine = materialise(digested(docs, "doc_id").withColumn("row", F.monotonically_increasing_id()), "digests")
        pairs = _features(mine.select("row", "hashes")).join(_features(known.select(F.xxhash64("id", "reference").alias("row"), "hashes")).toDF("ref", "feature"), "feature").select("row", "ref").distinct()
        named = known.select(F.xxhash64("id", "reference").alias("ref"), "id", "m", "reference")
        both = pairs.join(named, "ref").join(mine.select("row", "features", "digest"), "row").select("row", "id", "features", "digest", "m", "reference")
        scored = both.mapInArrow(_overlaps(beyond), "row long, id long, overlap double")
        found = scored.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("id", "overlap"))).alias("matches"))
        rows = mine.join(found, "row", "left").select(*columns, F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["overlap"].alias("o"), (-m["id"]).alias("i"))))
    return rows.select(*columns, (-best["i"]).alias("nearest"), F.coalesce(best["o"], F.lit(0.0)).alias("overlap"), "matches")


def _features(df: DataFrame) -> DataFrame:
    """(row, feature) of ``df(row, hashes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(h, np.int64) for h in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), [len(x) for x in raw]))), pa.array(np.concatenate(raw) if raw else np.zeros(0, np.int64))], names=["row", "feature"])

    return df.mapInArrow(run, "row long, feature long")


def _overlaps(beyond: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, raw, m, other = (batch.column(i).to_pylist() for i in range(2, 6))
            score = np.array([overlap(*_split(a, x), *_split(b, y)) for x, a, y, b in zip(n, raw, m, other)])
            kept = np.flatnonzero(score > beyond)
            yield pa.record_batch([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), pa.array(score[kept])], names=["row", "id", "overlap"])

    return run


def _split(raw: bytes, features: int) -> tuple[np.ndarray, np.ndarray]:
    filters = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    n = np.full(len(filters), CAPACITY, np.int32)
    if len(n):
        n[-1] = features - CAPACITY * (len(n) - 1)
    return filters, n


def _digests(ranks: np.ndarray, held=None, beyond: float = BEYOND):
    """Digests of texts; with references, also those whose digests overlap them. Only references that share a
    feature with a text are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value if held is not None else []
        split = [_split(raw, n) for _, n, raw, _ in known]
        sizes = [len(h) // 8 for *_, h in known]
        every = np.concatenate([np.frombuffer(h, np.uint64) for *_, h in known]) if known else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(known)), sizes)[order]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("overlap", pa.float64())]))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out, numbers, filters, hashes, matches = [], [], [], [], []
            for first, last in blocks(np.diff(offsets), BLOCK):
                found = block_digests(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], ranks)
                for bits, n, _ in found:
                    out.append(bits.tobytes())
                    numbers.append(int(n.sum()))
                    filters.append(len(bits))
                if held is None:
                    hashes += [own.tobytes() for *_, own in found]
                    continue
                flat = np.concatenate([own for *_, own in found]) if found else every[:0]
                text = np.repeat(np.arange(len(found)), [len(own) for *_, own in found])
                low, high = np.searchsorted(every, flat), np.searchsorted(every, flat, side="right")
                hit = np.flatnonzero(high > low)
                count = (high - low)[hit]
                refs = owner[np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                rows: list[list] = [[] for _ in found]
                for i, j in np.unique(np.stack([np.repeat(text[hit], count), refs], axis=1), axis=0).tolist():
                    value = overlap(*found[i][:2], *split[j])
                    if value > beyond:
                        rows[i].append({"id": known[j][0], "overlap": value})
                matches += rows
                hashes += [b""] * len(found)
            columns = [batch.column(0), pa.array(numbers, pa.int32()), pa.array(filters, pa.int32()), pa.array(out, pa.binary()), pa.array(hashes, pa.binary())]
            names = ["doc_id", "features", "filters", "digest", "hashes"]
            yield pa.record_batch([*columns, *([pa.array(matches, kind)] if held is not None else [])], names=[*names, *(["matches"] if held is not None else [])])

    return run
