"""Secret scans with character Markov models."""

from __future__ import annotations

import base64
import hashlib
import random
import string
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, packed, release, segments, text_of, utf8

MASK = "[SECRET]"
#: Characters that secrets consist of, and those that join words of a run.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_JOINTS = "+/_=-"
#: Log-likelihood ratios are kept as whole millionths, so that sums are exact in any order.
UNIT = 1_000_000
#: Shares of ordinary and of random strings whose characters follow no pattern. They bound what one pair can weigh, so that
#: a few rare pairs of a foreign word don't make it a secret.
LAPSE = (0.05, 0.02)
#: What a part beyond a joint has to add to a stretch.
EDGE = 4 * UNIT
#: What a character of no run subtracts: no stretch of a text of 2 GB gains as much.
_WALL = 1 << 44
#: Bytes of text that are scored in one go.
BLOCK = 1 << 20

_WORDS = """get set is has can make build create delete update read write open close start stop run load save parse format print value
index count size length width height name type kind node tree graph list array map table row column field record key item element
user account client server request response session token message error warning status code file path folder directory stream buffer
cache memory thread process task queue stack event handler listener manager factory service provider controller model view window
button label text string number integer double float boolean date time year month day hour minute second first last next previous
current default global local public private static final abstract interface class function method argument parameter return result
source target origin input output data config option setting property attribute version license document sentence paragraph chapter
house water people country language history general between another through without because important different government example
children company problem system program question during number always around however national political university information
communication international development responsibility understanding environment organization administration characteristics
und der die das nicht mit eine einer auch auf werden haben sein dass durch zwischen wissenschaft gesellschaft geschwindigkeit
verantwortung entwicklung universitaet zeitschrift bundesregierung selbstverstaendlich verschiedene menschen arbeit freiheit
les des une que pour dans avec sont cette comme mais plus tout nous vous leur entre gouvernement developpement environnement
responsabilite particulierement aujourd premiere question toujours pendant maintenant quelque chose
los las una que para con por como pero mas todo este esta entre cuando desarrollo responsabilidad gobierno universidad conocimiento
especialmente naturaleza siempre durante ahora algunos caracteristicas comunicacion informacion""".split()




def samples(seed: int = 5, n: int = 6000) -> list[tuple[str, int]]:
    """Labelled samples: random strings in the usual encodings, with and without the prefixes of common key formats (1), and
    ordinary identifiers, words, paths, numbers, dates, versions, UUIDs, short digests, alphabets and rules (0)."""
    r = random.Random(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    out = []
    for _ in range(n):
        size = r.choice((16, 20, 24, 32, 40, r.randint(16, 64), r.randint(20, 64)))
        raw = r.randbytes(size)
        hexed = raw.hex()[: max(size, 32)]
        out.append((r.choice((
            hexed, hexed, hexed, hexed.upper(), hexed.upper(), base64.b64encode(raw).decode()[:size], base64.urlsafe_b64encode(raw).decode()[:size], base64.b32encode(raw).decode()[:size],
            "".join(r.choices(upper + lower + digits, k=size)), "".join(r.choices(upper + lower + digits, k=size)), "".join(r.choices(lower + digits, k=max(size, 20))), "".join(r.choices(upper + digits, k=max(size, 20))),
            r.choice(("AKIA", "ASIA")) + "".join(r.choices(upper + digits, k=16)), r.choice(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "npm_")) + "".join(r.choices(upper + lower + digits, k=size)),
        )), 1))
        words = [r.choice(_WORDS) for _ in range(r.randint(1, 7))]
        salad = "".join(w[at : at + r.randint(2, 4)] for w in r.choices(_WORDS, k=r.randint(2, 6)) for at in (r.randrange(len(w)),))  # like words of a foreign tongue
        tail = r.choice(("", "", "", str(r.randint(0, 99)), f"_{r.randint(0, 9999)}", f"-{r.randint(1990, 2030)}", f"-v{r.randint(0, 9)}"))
        start, run = r.randint(0, 20), r.randint(5, 40)
        date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        out.append((r.choice((
            "_".join(words), "-".join(words), "/".join(words), "_".join(words).upper(), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]),
            "".join(words), "".join(words).capitalize(), "".join(words).upper(), "".join(str(r.randint(0, 9)) for _ in range(size)), f"{date}-" + "_".join(words), f"{date}T{r.randint(0, 23):02}",
            r.choice(_ALPHABET) * run, "/".join(f"{w}{r.randint(0, 9)}" for w in words), r.choice(_WORDS) * r.randint(3, 9), r.choice(("ha", "la", "na", "xo", "abc", "12", "01", "Aa")) * run,
            *(r.choice((str.lower, str.upper))(str(uuid.UUID(bytes=r.randbytes(16)))) for _ in range(2)), raw.hex()[: r.randint(6, 12)], (r.choice((upper, lower)) * 2)[start : start + run], (lower + digits)[start:], (upper + lower + digits)[start:],
            (digits * 4)[start : start + run], "qwertyuiopasdfghjklzxcvbnm"[start % 10 :], f"{words[0].capitalize()}{r.randint(1, 12)}{r.choice(_WORDS).upper()}", f"{words[0]}-{r.randint(0, 20)}-{r.randint(0, 99)}-{words[-1]}", "/".join(("www", words[0], date.replace("-", "/"), "-".join(words))),
        )) + tail, 0))
    return out


_CODES = np.full(256, -1, np.int64)
_CODES[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
#: The code of the state before the first character of a run.
_START = len(_ALPHABET)


def _bin(size: int) -> int:
    """Lengths by doublings and halves of them: 1, 2, 3, 4, 6, 8, 12, 16, 24, 32 and more begin a bin each."""
    return int(np.searchsorted(_BINS, size, side="right")) - 1


_BINS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32])


class Model:
    """Log-likelihood ratios of random against ordinary strings, in millionths: ``ratio`` of character pairs, ``size`` of
    lengths, and ``least``, the sum from which a stretch counts as random.

    Pairs are counted on one third of the labelled samples, lengths of the best stretches on another, and on the last
    the threshold is set so that 3 in 2000 ordinary samples pass it.
    """

    def __init__(self, seed: int = 5, n: int = 6000):
        width = _START + 1
        counts = np.full((2, width, width), 0.2)
        labelled = samples(seed, n)
        third = len(labelled) // 3
        for text, label in labelled[2 * third :]:
            at = np.concatenate(([_START], _CODES[np.frombuffer(text.encode(), np.uint8)]))
            np.add.at(counts[label], (at[:-1], at[1:]), 1)
        share = np.array(LAPSE)[:, None, None]
        logs = np.log((1 - share) * counts / counts.sum(2, keepdims=True) + share / width)
        self.ratio = np.rint((logs[1] - logs[0]) * UNIT).astype(np.int64)
        same = np.arange(width)
        self.ratio[same, same] = np.minimum(self.ratio[same, same], 0)  # a row of one character is never evidence, however long
        self.size = np.zeros(len(_BINS), np.int64)
        self.least = -_WALL
        bins = np.ones((2, len(_BINS)))
        for text, label in labelled[third : 2 * third]:
            if best := max(self.stretches(text), key=lambda x: x[2], default=None):
                bins[label, _bin(best[1] - best[0])] += 1
        self.size = np.rint(np.log(bins[1] / bins[1].sum() / (bins[0] / bins[0].sum())) * UNIT).astype(np.int64)
        scores = [max((v for *_, v in self.stretches(text)), default=0) for text, label in labelled[:third] if not label]
        self.least = int(np.quantile(scores, 0.9985))
        #: no stretch whose pairs sum to less can be a secret
        self.floor = max(0, self.least - int(self.size.max()))

    def stretches(self, run: str) -> list[tuple[int, int, int]]:
        """(start, end, score) of the random stretches of a run of the alphabet, in order.

        The stretch with the greatest sum of pair ratios, without ends beyond a joint that add less than EDGE, is widened to the next
        joint on either side, joints themselves excluded. It counts if its sum, with the ratio of its length, is more than ``least``. What is left of it
        and right of it is searched alike. Of equal sums the first is taken.
        """
        codes = _CODES[np.frombuffer(run.encode(), np.uint8)]
        sums = np.concatenate(([0], np.cumsum(self.ratio[np.concatenate(([_START], codes[:-1])), codes])))
        floor = max(0, self.least - int(self.size.max()))
        out, open_ = [], [(0, len(run))]
        while open_:
            lo, hi = open_.pop()
            if lo >= hi:
                continue
            low = np.minimum.accumulate(sums[lo:hi])
            rise = sums[lo + 1 : hi + 1] - low
            end = int(np.argmax(rise))
            value = int(rise[end])
            if value <= floor:
                continue
            start, end = lo + int(np.flatnonzero(sums[lo : lo + end + 1] == low[end])[0]), lo + end + 1
            while True:  # what lies beyond a joint and adds little belongs to another word
                joints = [i for i in range(start, end) if run[i] in _JOINTS]
                if joints and joints[-1] > start and sums[end] - sums[joints[-1]] < EDGE:
                    end = joints[-1]
                elif joints and joints[0] < end - 1 and sums[joints[0] + 1] - sums[start] < EDGE:
                    start = joints[0] + 1
                else:
                    break
            value = int(sums[end] - sums[start])
            while start > lo and run[start - 1] not in _JOINTS:
                start -= 1
            while end < hi and run[end] not in _JOINTS:
                end += 1
            s, e = start, end
            while s < e - 1 and run[s] in _JOINTS:
                s += 1
            while e > s + 1 and run[e - 1] in _JOINTS:
                e -= 1
            value += int(self.size[_bin(e - s)])
            if value > self.least:
                out.append((s, e, value))
            open_ += [(lo, start), (end, hi)]
        return sorted(out)


@lru_cache(maxsize=1)
def model(seed: int = 5, n: int = 6000) -> Model:
    """The model, trained once a process from the same samples everywhere."""
    return Model(seed, n)


_MEMBER = _CODES >= 0


class Scanner:
    """Finds the secrets of texts that lie end to end."""

    def __init__(self):
        self.model = model()
        size = _START + 2  # the last row and column stand for all characters of no run
        table = np.full((size, size), -_WALL, np.int64)
        table[: _START + 1, : _START + 1] = self.model.ratio
        table[_START + 1, : _START + 1] = self.model.ratio[_START]
        self.table = table
        self.codes = np.where(_CODES >= 0, _CODES, _START + 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, start, end, score), in bytes of the text."""
        if not len(data):
            return []
        codes = self.codes[data]
        before = np.concatenate(([_START + 1], codes[:-1]))
        before[offsets[:-1][offsets[:-1] < len(data)]] = _START + 1
        gain = self.table[before, codes]
        # a run that follows another text at once begins anew
        sums = np.cumsum(gain)
        start, end = segments(data, _MEMBER)
        inner = offsets[1:-1]
        cut = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = cut[_MEMBER[data[cut - 1]] & _MEMBER[data[cut]]]
        start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
        if not len(start):
            return []
        # within a run, the greatest rise of the sums; walls between runs keep the minimum in the run
        low = np.minimum.accumulate(np.concatenate(([0], sums[:-1])))
        wall = np.zeros(len(data), bool)
        wall[cut] = True
        rise = sums - low
        top = np.maximum.reduceat(rise, start)
        hot = np.flatnonzero(top > self.model.floor)
        # a run after a cut has no wall before it, so it is judged on its own
        hot = np.union1d(hot, np.flatnonzero(wall[start]))
        out = []
        text = np.searchsorted(offsets, start[hot], side="right") - 1
        for i, k in zip(text.tolist(), hot.tolist()):
            run = data[start[k] : end[k]].tobytes().decode("ascii")
            out += [(i, int(start[k] - offsets[i]) + s, int(start[k] - offsets[i]) + e, v) for s, e, v in self.model.stretches(run)]
        return out


def find(text: str, scan: Scanner | None = None) -> list[tuple[int, int, float]]:
    """(start, end, score) of the secrets of one text, in characters and nats."""
    raw = np.frombuffer(text.encode(), np.uint8)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(lead[s]), int(lead[e]), v / UNIT) for _, s, e, v in (scan or Scanner())(raw, np.array([0, len(raw)]))]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, shown, sha256, score) for every string that looks random.

    Every run of letters, digits and ``+/_=-`` in the whole text, of any length, is scored by two
    character Markov models, one of random strings and one of ordinary identifiers, both trained from labelled samples.
    The ratio of their likelihoods is summed over character pairs, and a run's stretch with the greatest sum is a
    secret if that sum and the ratio of its length exceed the threshold of ``Model``, so that ordinary parts that are glued to a secret don't hide it; the rest of the run is
    searched alike. ``score`` is the log-likelihood ratio in nats.
    ``start`` counts characters from 0. The secret itself isn't returned, only its first four characters and its digest.

    Null and empty texts hold none; null and repeated ids pass through, each row on its own, and a secret that occurs
    twice is reported twice; of equal stretches of a run the first is taken; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for lo, hi in blocks(np.diff(offsets), BLOCK):
                base = offsets[lo]
                found = scan(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                for i, s, e, v in found:
                    at = offsets[lo + i]
                    word = data[at + s : at + e].tobytes()
                    before = int(((data[at : at + s] & 0xC0) != 0x80).sum())
                    rows.append((batch.column(0)[lo + i].as_py(), before, e - s, word[:4].decode(), hashlib.sha256(word).hexdigest(), v / UNIT))
            if rows:
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()))],
                    names=["doc_id", "start", "length", "shown", "sha256", "score"],
                )
            release()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("text <> ''")
    return narrow.mapInArrow(run, "doc_id long, start long, length int, shown string, sha256 string, score double")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every string that ``scan_secrets`` reports replaced by MASK.

    No row is dropped; ``n_chars`` is counted anew where it exists and something was masked. Null texts stay null, and empty texts and
    those without secrets unchanged; repeated rows are treated alike; other columns pass through, whatever their names; an empty table gives an empty one.
    """

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        """The masked text, or null where there is nothing to mask."""
        scan = Scanner()
        column = column.fill_null("")
        data, offsets = utf8(column)
        out: dict[int, str] = {}
        for lo, hi in blocks(np.diff(offsets), BLOCK):
            base = offsets[lo]
            by: dict[int, list] = {}
            for i, s, e, _ in scan(data[base : offsets[hi]], offsets[lo : hi + 1] - base):
                by.setdefault(lo + i, []).append((s, e))
            for i, spans in by.items():
                raw, at, parts = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                for s, e in spans:
                    parts += [raw[at:s], MASK.encode()]
                    at = e
                out[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
        release()
        return pa.array([out.get(i) for i in range(len(column))], pa.string())

    r = F.col("r")
    clean = docs.select(packed(docs).alias("r")).select("r", mask(r["text"].cast("string")).alias("m"))
    new = {"text": F.coalesce("m", r["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("m").isNull(), r["n_chars"]).otherwise(F.length("m").cast("long"))
    return clean.select(*[new.get(c, r.getField(c)).alias(c) for c in docs.columns])
