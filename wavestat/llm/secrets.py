"""Secret scan: fixed shapes, and strings that a battery of randomness tests cannot tell from random ones.

Fixed shapes: ``assign`` (a named value), ``access`` (cloud access key),
``hex``; leftmost matches per kind, too short ones dropped.

Other long words (``CANDIDATE``, not digits alone, apart from the fixed
shapes) are tested.  The encoding is the smallest alphabet that holds the
word's characters (hex, base32, base36, base62, base64); over it,

* chi-squared: characters spread evenly over up to ``CELLS`` equal slices of
  the alphabet, one slice per five characters;
* runs: changes between the alphabet's halves are as many as chance makes;
* serial correlation: neighbouring characters do not depend on each other;

and the three p-values make one statistic (Fisher).  A word that is random
has a small one; ordinary words have large ones, but short ones may not.  So
the statistic is also taken over *ordinary* strings: every text's short words
joined and cut to each length band's least length.  In each band the words at
or under a bound are reported, the largest bound at which the share of chance
finds among them (ordinary strings at or under it times the number of words
tested, over the words found) is at most ``RATE`` and which a random string
exceeds with a chance of 0.01 only.  Short bands, where ordinary strings look
random too, thereby report nothing or only the clearest.

Both passes read every whole text.  Per batch at most bands x ``BUCKETS``
counts are shuffled.  Null or blank text: no spans.  Repeated rows and null
ids give a row each and count as often as they occur; empty tables give none,
and bounds that report nothing.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrays, strings

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
KINDS = ("assign", "access", "hex", "random")

BANDS = (16, 20, 24, 32, 40, 64)   # least length of each band
CELLS, BUCKETS, PER_UNIT = 16, 256, 4
RATE = 0.01
RANDOM_TOP = 16.81                 # chi-squared with 6 degrees of freedom, upper 0.01

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (_DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
             _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/")
SIZES = np.array([len(a) for a in ALPHABETS])


def _tables():
    """Index of each byte in each alphabet (255: not in it), class bit of each byte, slice chances."""
    index = np.full((len(ALPHABETS), 256), 255, np.uint8)
    for e, alphabet in enumerate(ALPHABETS):
        index[e, list(alphabet.encode())] = np.arange(len(alphabet))
    index[-1, list(b"-_")] = index[-1, list(b"+/")]  # the URL form
    allowed = np.zeros(256, np.uint8)  # alphabets, as bits, that hold a byte
    for e in range(len(ALPHABETS)):
        allowed |= (index[e] < 255).astype(np.uint8) << e
    chance = np.zeros((len(ALPHABETS), CELLS + 1, CELLS))
    for e, size in enumerate(SIZES):
        for k in range(2, CELLS + 1):
            chance[e, k] = np.bincount(np.arange(size) * k // size, minlength=CELLS) / size
    return index, allowed, chance


INDEX, ALLOWED, CHANCE = _tables()


def log_tail(z: np.ndarray) -> np.ndarray:
    """Log of the normal upper tail (rational form below 5, asymptotic above)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = np.exp(-a * a / 2) / np.sqrt(2 * np.pi) * poly
    far = -a * a / 2 - np.log(np.maximum(a, 1) * np.sqrt(2 * np.pi)) + np.log1p(-1 / np.maximum(a, 2) ** 2)
    upper = np.where(a < 5, np.log(np.maximum(near, 1e-300)), far)
    return np.where(z >= 0, upper, np.log1p(-np.minimum(near, 0.5)))


def battery(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fisher statistic of the three tests for strings laid end to end (bytes, lengths of 2 or more)."""
    if not len(lengths):
        return np.zeros(0)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    holds = np.bitwise_and.reduceat(ALLOWED[codes], starts)
    coding = np.argmax((holds[:, None] >> np.arange(len(ALPHABETS))) & 1, axis=1)  # the first, smallest alphabet
    letters = (codes >= 65) & (codes != 95)
    mixed = np.add.reduceat(letters.astype(np.int64), starts)
    plain = (mixed == 0) | (mixed == lengths)  # letters alone tell nothing of a coding: the widest without signs
    coding[plain & (coding < 5)] = 5
    x = INDEX[coding[owner], codes].astype(np.int64)
    size, n = SIZES[coding], lengths.astype(float)

    k = np.clip(lengths // 5, 2, CELLS)
    seen = np.bincount(owner * CELLS + x * k[owner] // size[owner], minlength=CELLS * len(lengths)).reshape(-1, CELLS)
    due = n[:, None] * CHANCE[coding, k]
    chi = np.where(due > 0, (seen - due) ** 2 / np.where(due > 0, due, 1), 0).sum(1)
    spread = 2 / (9 * (k - 1))
    uniform = log_tail((np.cbrt(chi / (k - 1)) - (1 - spread)) / np.sqrt(spread))

    high = x * 2 >= size[owner]
    above = np.add.reduceat(high.astype(np.int64), starts).astype(float)
    within = owner[1:] == owner[:-1]
    changes = np.bincount(owner[1:][within], (high[1:] != high[:-1])[within], len(lengths))
    twice = 2 * above * (n - above)
    varies = (twice > 0) & (twice > n)
    sd = np.sqrt(np.where(varies, twice * (twice - n) / (n * n * (n - 1)), 1))
    z_runs = np.where(varies, (changes + 1 - twice / n - 1) / sd, np.sqrt(n))

    mean = np.bincount(owner, x, len(lengths)) / n
    off = x - mean[owner]
    energy = np.bincount(owner, off * off, len(lengths))
    along = np.bincount(owner[1:][within], (off[1:] * off[:-1])[within], len(lengths))
    z_serial = np.where(energy > 0, (along / np.where(energy > 0, energy, 1) + 1 / n) * np.sqrt(n), np.sqrt(n))
    two_sided = np.log(2) + log_tail(np.abs(z_runs)) + np.log(2) + log_tail(np.abs(z_serial))
    return -2 * (uniform + two_sided)


def buckets(statistic: np.ndarray) -> np.ndarray:
    return np.minimum((np.maximum(statistic, 0) * PER_UNIT).astype(np.int64), BUCKETS - 1)


def band(lengths) -> np.ndarray:
    return np.searchsorted(BANDS, lengths, side="right") - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, kinds by place in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base) -> list[tuple[int, int]]:
    """Long words, not digits alone, that no fixed shape touches."""
    out, j = [], 0
    ends = sorted((a, b) for a, _, b in base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while j < len(ends) and ends[j][1] <= a:
            j += 1
        if (j == len(ends) or ends[j][0] >= b) and not m[0].isdigit():
            out.append((a, b))
    return out


def _statistics(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(battery, length) of candidates, padding left out."""
    bare = [w.rstrip("=") for w in words]
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    return battery(np.frombuffer("".join(bare).encode(), np.uint8), lengths), lengths


_LAPS = np.repeat(np.arange(len(BANDS)), BANDS)  # piece of each place in one lap of lengths


def ordinary(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(battery, length) of the texts' short words, joined within a text and cut to the bands' lengths in turn."""
    stream = [CANDIDATE.sub(" ", t).encode("ascii", "ignore") for t in texts]
    codes = np.frombuffer(b"".join(stream), np.uint8)
    lengths = np.fromiter(map(len, stream), np.int64, len(stream))
    text = np.repeat(np.arange(len(stream)), lengths)
    use = ALLOWED[codes] > 0
    codes, text = codes[use], text[use]
    held = np.bincount(text, minlength=len(stream))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(held) - held, held)
    piece = place // len(_LAPS) * len(BANDS) + _LAPS[place % len(_LAPS)]
    fresh = np.flatnonzero(np.diff(piece, prepend=-1) | np.diff(text, prepend=-1)) if len(codes) else np.zeros(0, np.int64)
    sizes = np.diff(fresh, append=len(codes))
    whole = sizes == np.array(BANDS)[piece[fresh] % len(BANDS)]
    return battery(codes[np.repeat(whole, sizes)], sizes[whole]), sizes[whole]


def _counts(lengths, statistic) -> np.ndarray:
    return np.bincount(band(lengths) * BUCKETS + buckets(statistic), minlength=len(BANDS) * BUCKETS)


def _parts(texts: list[str], size: int = 4_000_000):
    """Neighbouring texts of about ``size`` characters together."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def bounds(counted: dict[tuple[int, int], tuple[int, int]], rate: float = RATE) -> list[int]:
    """Per band the last bucket to report (-1: none), from {(band, bucket): (ordinary, tested)}."""
    out = []
    for b in range(len(BANDS)):
        known, tested = (np.array([counted.get((b, i), (0, 0))[j] for i in range(BUCKETS)]) for j in (0, 1))
        chance = (1 + np.cumsum(known)) / (1 + known.sum())
        fine = chance * tested.sum() <= rate * np.cumsum(tested)
        fine[int(RANDOM_TOP * PER_UNIT):] = False
        fine &= tested > 0
        out.append(int(np.flatnonzero(fine)[-1]) if fine.any() else -1)
    return out


def limits(docs: DataFrame, rate: float = RATE) -> list[int]:
    """Bounds per length band from all texts (bands x ``BUCKETS`` counts reach the driver)."""
    def count(batches):
        for batch in batches:
            total = np.zeros((2, len(BANDS) * BUCKETS), np.int64)
            for part in _parts([t or "" for t in strings(batch, "text")]):
                statistic, lengths = ordinary(part)
                total[0] += _counts(lengths, statistic)
                words = [t[a:b] for t in part for a, b in candidates(t, base_spans(t))]
                statistic, lengths = _statistics(words)
                total[1] += _counts(lengths, statistic)
            at = np.flatnonzero(total.any(0))
            yield arrays(["cell", "ordinary", "tested"], [at, total[0, at], total[1, at]])

    rows = (docs.select("text").mapInArrow(count, "cell long, ordinary long, tested long").groupBy("cell")
            .agg(F.sum("ordinary").alias("ordinary"), F.sum("tested").alias("tested")).collect())
    return bounds({divmod(r.cell, BUCKETS): (r.ordinary, r.tested) for r in rows}, rate)


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()),
    ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_random", T.LongType()))])


def _text(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def found(texts: list[str], top: list[int]) -> list[tuple]:
    """(n_assign, n_access, n_hex, base_sha256, spans, n_random) per text."""
    base = [base_spans(t) for t in texts]
    words = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
    statistic, lengths = _statistics([texts[i][a:b] for i, a, b in words])
    report = buckets(statistic) <= np.array(top, np.int64)[band(lengths)] if words else []
    more: dict[int, list] = {}
    for (i, a, b), yes in zip(words, report):
        if yes:
            more.setdefault(i, []).append((a, 3, b))
    out = []
    for i, spans in enumerate(base):
        kinds = [k for _, k, _ in spans]
        digest = hashlib.sha256(_text(spans).encode()).hexdigest()
        extra = more.get(i, [])
        out.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, _text(sorted(spans + extra)), len(extra)))
    return out


def scanned(docs: DataFrame, top: list[int]) -> DataFrame:
    """Counts, digest and spans (code points, end exclusive) of every text; ``top`` from ``limits``."""
    names = SCHEMA.fieldNames()

    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in strings(batch, "text")]
            if texts:
                rows = found(texts, top)
                yield arrays(names, [batch.column(0), *zip(*rows)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
