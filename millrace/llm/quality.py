"""Quality classification by compression with trained dictionaries."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, logistic, text_of

#: Labelled documents that the classifier is fitted on, at most.
TRAINING_DOCS = 6000
#: Bytes of each dictionary, the compression level, and the bytes that are compressed at a time.
DICTIONARY, LEVEL, CHUNK = 1 << 16, 3, 2048


def _dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; where training finds nothing, the raw text serves as one."""
    parts = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of a whole text with two dictionaries, chunk by chunk."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=LEVEL)
            # the same few bytes of framing for either
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[int, int]:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        good, bad = (sum(len(c.compress(x)) for x in chunks) for c in self.coders)
        return good, bad

    def features(self, text: bytes) -> list[float]:
        return evidence(len(text), *self(text))


def evidence(size: int, good: int, bad: int) -> list[float]:
    """The normalised difference of the compressed sizes, the same as the evidence of the whole text (it grows with the
    root of the length, without an end), and the rate of compression by the better dictionary."""
    d = (bad - good) / max(1, bad + good)
    return [10 * d, d * np.sqrt(size) / 4, min(good, bad) / max(1, size)]


def fit_quality(documents: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS) -> dict:
    """Dictionaries and calibration from at most ``most`` labelled documents.

    Dictionaries are trained on two thirds of them, as much text of either label; the calibration
    is a logistic regression on the rest. Without both labels every score is 0.5.
    """
    sample = [(t.encode(), y) for t, y in labelled_sample(documents, labels, "quality", most) if t]
    random.Random(3).shuffle(sample)
    third = len(sample) // 3
    train, held = sample[third:], sample[:third]
    sides = [[t for t, y in train if y == label] for label in (1, 0)]
    if not all(sides) or len({y for _, y in held}) < 2:
        return {"good": b"", "bad": b"", "w": np.zeros(4)}
    size = min(sum(map(len, s)) for s in sides)
    even = []
    for side in sides:
        part, total = [], 0
        for t in side:
            if total >= size:
                break
            part.append(t)
            total += len(t)
        even.append(part)
    good, bad = map(_dictionary, even)
    sizes = Sizes(good, bad)
    return {"good": good, "bad": bad, "w": logistic(np.array([sizes.features(t) for t, _ in held]), np.array([y for _, y in held], float))}


def score_quality(docs: DataFrame, fitted: dict) -> DataFrame:
    """(doc_id, good_bytes, bad_bytes, score, good) for every document.

    A text is compressed whole, in chunks of CHUNK bytes, once with the dictionary of good texts and once with
    that of bad ones. ``score`` is the calibrated probability that it is good, from the
    normalised difference of the sizes; ``good`` says whether it is at least one half.

    Null and empty texts have sizes 0 and score 0. A score of one half is good. Repeated texts have equal scores. Null and repeated ids pass through, each row on its own;
    an empty table gives an empty one; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fitted)  # two dictionaries of at most DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sizes, w = Sizes(model["good"], model["bad"]), model["w"]
        for batch in batches:
            good, bad, score = [], [], []
            for item in batch.column(1):
                text = item.as_py().encode()
                g, b = sizes(text) if text else (0, 0)
                good.append(g)
                bad.append(b)
                x = [*evidence(len(text), g, b), 1.0]
                score.append(round(float(1 / (1 + np.exp(-np.clip(np.dot(x, w), -30, 30)))), 6) if text else 0.0)
            yield pa.record_batch(
                [batch.column(0), pa.array(good, pa.int64()), pa.array(bad, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "good_bytes", "bad_bytes", "score"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = narrow.mapInArrow(run, "doc_id long, good_bytes long, bad_bytes long, score double")
    return rows.withColumn("good", F.col("score") >= 0.5)
