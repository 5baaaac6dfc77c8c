"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q and at least
``max(MIN_LENGTH, 3 q)`` words that cannot be extended keeping q.  Texts of
one chunk are laid out as a flat array of word numbers, a word that matches
nothing between them, so all work is numpy over the chunk:

* **Direct lag scans** for q up to ``SHORT``: stretches of equal words q apart.
* **Scales** for longer q.  A scale has grams of K words and windows of w
  grams, w + K - 1 <= 2q and q <= K.  In a run of three periods some window
  lies q before its copy, so the window's least gram is selected at p and
  p + q; a gram of q words or more recurs in a run only at multiples of q, so
  the two are neighbours among the selected copies of that gram.  Neighbouring
  equal minimizers therefore seed every run of the scale.
* **Extension** compares words to both sides of a seed.  Seeds that cannot
  reach two periods of matches are dropped first: one of the two grams half the
  missing way to the left and right must match its copy too.

A stretch found under several lags has the smallest as its period: three
periods long, it has a smaller period only if that divides the lag, and then
the same stretch is found under the divisor.

Grams are compared by 64-bit hashes (doubling, mixed at every level); what is
returned was compared word by word.  Long texts cost one pass per scale, about
log(n) / log(1.6) of them, and a few arrays of eight bytes a word.

Null or blank text: no words, no runs, digests of empty strings.  Repeated
rows and null ids give a row each; an empty table gives none.  Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrays, binary, ranks, strings

MIN_LENGTH, SHORT, CHUNK_BYTES = 24, 9, 4 << 20

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_runs", T.LongType()), ("start", T.LongType()),
    ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()),
    ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType()), ("n_dropped", T.LongType()))])


def scales(longest: int):
    """(gram, window, least period) of every scale needed for runs of at most ``longest`` words."""
    covered = SHORT
    while 3 * (covered + 1) <= longest:
        gram = covered + 1
        while (gram + 1 + (gram + 1) // 4) // 2 <= covered + 1:
            gram += 1
        yield gram, gram // 4, covered + 1
        covered = gram


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(17))) + np.uint64(0x632BE59BD9B4E019))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours (by doubling)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:len(x) - step], x[step:])
        have += step
    return x


def _selected(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window of ``window`` neighbours (all of equal ones)."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    least = _sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, h.dtype)
    best = _sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    return np.flatnonzero(best == h)


def _reach(words: np.ndarray, i: int, lag: int, step: int) -> int:
    """Matches between i, i + step, ... and the places ``lag`` on, in growing blocks."""
    done, block = 0, 64
    limit = len(words) - lag - i if step > 0 else i + 1
    while done < limit:
        size = min(block, limit - done)
        if step > 0:
            a = words[i + done:i + done + size]
            b = words[i + done + lag:i + done + lag + size]
        else:
            a = words[i - done - size + 1:i - done + 1][::-1]
            b = words[i - done - size + 1 + lag:i - done + 1 + lag][::-1]
        same = a == b
        if not same.all():
            return done + int(np.argmin(same))
        done += size
        block *= 2
    return limit


def _lag_stretches(words: np.ndarray, lag: int):
    """(start, end) of maximal stretches of period ``lag`` that are long enough."""
    if len(words) <= lag:
        return
    edges = np.diff(np.concatenate([[False], words[lag:] == words[:-lag], [False]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = last - first + lag >= max(MIN_LENGTH, 3 * lag)
    yield from zip(first[long].tolist(), (last[long] + lag).tolist())


def _seeds(h: np.ndarray, window: int, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of neighbouring equal minimizers whose lag is the scale's and can reach two periods."""
    at = _selected(h, window)
    order = at[np.argsort(h[at], kind="stable")]
    p, lag = order[:-1], np.diff(order)
    fit = (h[order[:-1]] == h[order[1:]]) & (lag >= least) & (lag <= gram) if len(order) else np.zeros(0, bool)
    p, lag = p[fit], lag[fit]
    half = (2 * lag - gram + 1) // 2
    right, left = p + half, p - half
    fine = (right + lag < len(h)) & (h[np.minimum(right, len(h) - 1)] == h[np.minimum(right + lag, len(h) - 1)])
    fine |= (left >= 0) & (h[np.maximum(left, 0)] == h[np.maximum(left, 0) + lag])
    return p[fine], lag[fine]


def stretches(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) in the flat array, sorted; texts lie at ``starts`` and are parted by unique words."""
    found: dict[tuple[int, int], int] = {}

    def add(first, last, lag):
        if found.get((first, last), lag) >= lag:
            found[first, last] = lag

    for lag in range(1, SHORT + 1):
        for first, last in _lag_stretches(words, lag):
            add(first, last, lag)
    longest = int(lengths.max(initial=0))
    flat, origin = words, None  # origin: place in ``words`` of each place in ``flat``
    level, size = _mix(flat.astype(np.uint64) + np.uint64(1)), 1
    kept = len(lengths)
    for gram, window, least in scales(longest):
        long = lengths >= 3 * least
        if 2 * long.sum() < kept:  # go on with the texts that can hold such a run
            kept = int(long.sum())
            origin = np.concatenate([np.arange(a, a + n + 1) for a, n in zip(starts[long], lengths[long])])
            flat = words[origin]
            level, size = _mix(flat.astype(np.uint64) + np.uint64(1)), 1
        while 2 * size <= gram:
            level = _joined(level[:len(level) - size], level[size:])
            size *= 2
        extra = gram - size
        h = _joined(level[:len(level) - extra], level[extra:]) if extra else level
        p, lag = _seeds(h, window, gram, least)
        order = np.lexsort((p, lag))
        before, until = 0, -1
        for i, q in zip(p[order].tolist(), lag[order].tolist()):
            if q == before and i < until:
                continue
            first = i - _reach(flat, i - 1, q, -1) if i else 0
            last = i + _reach(flat, i, q, 1) + q
            before, until = q, last - q
            if last - first >= 3 * q:
                shift = 0 if origin is None else int(origin[first]) - first
                add(first + shift, last + shift, q)
    return sorted((a, b, q) for (a, b), q in found.items())


def planted(words: list, doc_id) -> list:
    """The words with the contract's repeats: a tenth of the ids have a periodic tail."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def _row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    drop = np.zeros(len(words) + 1, np.int64)
    for first, last, q in runs:
        if best is None or (last - first) * best[2] > (best[1] - best[0]) * q:  # sorted: ties keep start, then period
            best = first, last, q
        drop[first + q] += 1
        drop[last] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    digest = hashlib.sha256("".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()).hexdigest()
    left = words if not runs else [w for w, k in zip(words, keep.tolist()) if k]
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(words), len(runs), *top, digest, hashlib.sha256(b" ".join(left)).hexdigest(), len(words) - len(left))


def rows(ids: list, texts: list[list[bytes]]) -> list[tuple]:
    """One result row per text (given as words)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = ranks([w for text in texts for w in (*text, None)])
    ends = starts + lengths
    flat[ends] = flat.max(initial=0) + 1 + np.arange(len(texts))  # parted by words that match nothing
    per_text: list[list] = [[] for _ in texts]
    found = stretches(flat, starts, lengths)
    owner = np.searchsorted(starts, [f[0] for f in found], side="right") - 1
    for (a, b, q), t in zip(found, owner.tolist()):
        per_text[t].append((a - int(starts[t]), b - int(starts[t]), q))
    return [_row(i, text, runs) for i, text, runs in zip(ids, texts, per_text)]


def _chunks(ids, texts, size: int):
    """Neighbouring texts of at most ``size`` bytes together (one text at least)."""
    part: list = []
    held = 0
    for i, text in zip(ids, texts):
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append((i, text))
        held += len(text)
    if part:
        yield part


def periodic(docs: DataFrame, plant: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Runs of every whole text: count, greatest exponent, digests of all runs and of the text without repeats.

    ``plant``: give a tenth of the texts a periodic tail first (see ``planted``).
    """
    names = SCHEMA.fieldNames()

    def judge(batches):
        for batch in batches:
            for part in _chunks(strings(batch, "doc_id"), binary(batch, "text"), chunk_bytes):
                words = [text.split() for _, text in part]
                if plant:
                    words = [planted(w, i) for w, (i, _) in zip(words, part)]
                yield arrays(names, list(zip(*rows([i for i, _ in part], words)))).cast(_arrow())

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)


def _arrow():
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(SCHEMA)
