"""Packing by power-of-two decomposition."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentHash, blocks, release, text_of, utf8

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

SCHEMA = "doc_id long, piece int, start long, length int, bucket int, tokens array<int>"


@lru_cache(maxsize=2)
def encoding(path: str):
    """A byte-level BPE read from a file of ranks; it is never trained here."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: white space 0, letter 1, number 2, other 3."""
    out = np.full(0x110000, 3, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            out[code] = 1
        elif major == "N":
            out[code] = 2
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN begin in UTF-8 texts that lie end to end."""
    n = len(data)
    kind = classes()[:256][data]
    lead = (data & 0xC0) != 0x80
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = (padded[wide + i] for i in range(4))
        b, c, d = b & 63, c & 63, d & 63
        code = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        kind[wide] = classes()[code]
        for i in range(1, 4):  # further bytes of a character are of its kind
            more = wide[wide + i < n] + i
            more = more[~lead[more]]
            kind[more] = kind[more - 1]
    text = np.zeros(n + 1, bool)
    text[offsets] = True
    edge = np.concatenate(([True], (kind[1:] != kind[:-1]) | text[1:-1]))
    start = np.flatnonzero(edge)
    end = np.concatenate((start[1:], [n]))
    own = kind[start]
    closing = text[end]  # the run ends its text
    cut = edge.copy()
    # a space before a run belongs to the run
    spaced = np.concatenate(([False], (own[:-1] == 0) & (own[1:] != 0) & ~closing[:-1] & (data[end[:-1] - 1] == 32)))
    cut[start[spaced]] = False
    # white space before other text leaves its last character
    blank = (own == 0) & ~closing
    last = end[blank] - 1
    for _ in range(3):
        last = np.where(lead[last], last, last - 1)
    cut[last] = True
    # contractions
    mark = np.flatnonzero((own == 3) & (end - start == 1) & (data[start] == 39) & ~spaced & ~closing)
    mark = mark[own[mark + 1] == 1] if len(mark) else mark
    if len(mark):
        at = start[mark] + 1
        stop = end[mark + 1]
        x = data[at]
        y = np.where(at + 1 < stop, data[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(x, np.frombuffer(b"sdmt", np.uint8))
        two = ((x == 108) & (y == 108)) | ((x == 118) & (y == 101)) | ((x == 114) & (y == 101))
        hit = one | two
        cut[at[hit]] = False
        rest = (at + np.where(one, 1, 2))[hit]
        cut[rest[rest < stop[hit]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts that lie end to end; distinct pieces are encoded once and remembered by hash."""

    MOST = 300_000

    def __init__(self, path: str):
        self.coder = encoding(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ends = np.zeros(1 << 16, np.int64)  # of the tokens of each piece; piece 0 is empty
        self.flat = np.zeros(1 << 18, np.int32)

    def _learn(self, pieces: list[bytes], hashes: list[int]) -> None:
        found = list(map(self.coder._encode_single_piece, pieces))
        at = len(self.index) + 1
        while at + len(found) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ends[at : at + len(found)] = self.ends[at - 1] + np.cumsum(sizes)
        low, high = self.ends[at - 1], self.ends[at + len(found) - 1]
        while high > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[low:high] = np.fromiter(chain.from_iterable(found), np.int32, high - low)
        self.index.update(zip(hashes, range(at, at + len(found))))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts, and n + 1 offsets of the texts in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.index) > self.MOST:
            self.clear()
        start = piece_starts(data, offsets)
        end = np.concatenate((start[1:], [len(data)]))
        hashes, first, which = np.unique(SegmentHash(data)(start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        get = self.index.get
        at = np.fromiter((get(k, 0) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(at == 0)
        if len(new):
            raw = data.tobytes()
            self._learn([raw[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())], hashes[new].tolist())
            at[new] = np.arange(len(self.index) - len(new) + 1, len(self.index) + 1)
        at = at[which]
        size = self.ends[at] - self.ends[at - 1]
        ends = np.concatenate(([0], np.cumsum(size)))
        tokens = self.flat[np.repeat(self.ends[at - 1] - ends[:-1], size) + np.arange(ends[-1])]
        return tokens, ends[np.searchsorted(start, offsets)]


def pieces(n: int, longest: int) -> list[int]:
    """Binary lengths that sum to n, the largest first: whole pieces of ``longest``, then the
    powers of two in the rest."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        power = 1 << (rest.bit_length() - 1)
        out.append(power)
        rest -= power
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", longest: int = 2048
) -> DataFrame:
    """One row for each training sequence: (doc_id, piece, start, length, bucket, tokens).

    A text is tokenised whole and cut into pieces of lengths that are powers of two, at
    most ``longest``, in order; ``bucket`` is the binary logarithm of the length. All
    sequences of a bucket have equal length, so batches need no padding, and no sequence
    holds tokens of two documents. Every token is in exactly one piece. There is no shuffle.

    Null and empty texts give no rows; null and repeated ids pass through, each row being
    packed on its own; other columns are not read. ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        cuts: dict[int, list[int]] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in blocks(np.diff(offsets)):
                tokens, ends = encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total = np.diff(ends)
                each = []
                for n in total.tolist():
                    if n not in cuts:
                        cuts[n] = pieces(n, longest)
                    each.append(cuts[n])
                count = np.fromiter(map(len, each), np.int64, len(each))
                if not count.sum():
                    continue
                length = np.fromiter(chain.from_iterable(each), np.int32, count.sum())
                stop = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
                owner = np.repeat(np.arange(lo, hi), count)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array(stop[:-1] - np.repeat(ends[:-1], count)), pa.array(length),
                        pa.array(np.frexp(length.astype(float))[1].astype(np.int32) - 1), pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(tokens)),
                    ],
                    names=["doc_id", "piece", "start", "length", "bucket", "tokens"],
                )
            release()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("text <> ''")
    return narrow.mapInArrow(run, SCHEMA)
