"""Quality rules: gradient-boosted trees over document statistics.

The model is fitted on at most ``MAX_TRAIN`` labelled documents (those of
smallest id hash), with a sign constraint on chosen features, and flattened
into node arrays that score a batch of documents at once.

Nulls: a null text has no words (base_failed); labels with a null doc_id or
quality are ignored; with no usable labels the verdict is "keep" for every
document that passes the base rules.  Repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, binary, column, ranks

MAX_TRAIN = 20_000  # labelled documents the model is fitted on
TREES, DEPTH, BINS, RATE, RIDGE, MIN_CHILD = 40, 3, 32, 0.3, 1.0, 5.0
KEEP_AT = 0.5
FEATURES = ["symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "distinct_share",
            "word_length", "marks_per_word", "log_words", "log_lines"]
#: -1: the score may only fall as the feature rises; 0: free
SIGNS = np.array([-1, -1, -1, 0, 0, 0, 0, 0, 0])
SYMBOLS = b"#*$%&|<>"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words lying in a window of eight words that occurs at least twice (exact, by prefix doubling)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    size = 1
    while size < window:
        ids = np.unique(ids[:-size] * (ids.max() + 1) + ids[size:], return_inverse=True)[1]
        size *= 2
    hit = np.bincount(ids)[ids] > 1
    edges = np.zeros(n + window, np.int64)
    edges[:n] += hit
    edges[window:] -= hit
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_distinct, n_marks)."""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    # code points = bytes that do not continue a character
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    counts = np.bincount(raw, minlength=256)
    lines = [x for x in text.split(b"\n") if x.split()]
    ids = ranks(words)
    return (n, chars, int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(ids),
            len(lines), int(counts[65:91].sum()), int(ids.max()) + 1 if n else 0, int(counts[list(b"!?")].sum()))


def features(stats: np.ndarray) -> np.ndarray:
    n, chars, symbols, dup, repeat, lines, upper, distinct, marks = stats.T.astype(float)
    w = np.maximum(n, 1)
    return np.stack([symbols / w, dup / np.maximum(lines, 1), repeat / w, upper / np.maximum(chars, 1), distinct / w,
                     chars / w, marks / w, np.log1p(n), np.log1p(lines)], 1)


@dataclass
class Forest:
    """All trees in flat arrays: a node's feature, threshold, children (a leaf points to itself) and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``x``."""
        margin = np.full(len(x), self.bias)
        if len(self.roots) and len(x):
            at = np.tile(self.roots, (len(x), 1))
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            margin += self.value[at].sum(1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS) -> Forest:
    """Histogram boosting with logistic loss; children of a constrained split keep their order through bounds."""
    nodes: list[list] = []
    roots = []
    p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return Forest(*(np.zeros(0, t) for t in (int, float, int, int, float)), np.zeros(0, int), bias + 2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), bias)

    def leaf(g, h, low, high):
        return float(np.clip(-RATE * g / (h + RIDGE), low, high))

    def grow(rows, depth, low, high) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append([0, np.inf, at, at, leaf(g, h, low, high)])
        best = (1e-6, None)
        if depth < DEPTH and h >= 2 * MIN_CHILD:
            for j, c in enumerate(cuts):
                gl = np.cumsum(np.bincount(code[rows, j], grad[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], hess[rows], len(c) + 1))[:-1]
                gr, hr = g - gl, h - hl
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g**2 / (h + RIDGE)
                order = (-gr / (hr + RIDGE) + gl / (hl + RIDGE)) * signs[j]
                gain[(hl < MIN_CHILD) | (hr < MIN_CHILD) | (order < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (j, int(gain.argmax())))
        if best[1]:
            j, b = best[1]
            side = code[rows, j] <= b
            values = [leaf(grad[r].sum(), hess[r].sum(), low, high) for r in (rows[side], rows[~side])]
            mid = sum(values) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high),) * 2}[int(signs[j])]
            nodes[at][0], nodes[at][1] = j, float(cuts[j][b])
            nodes[at][2] = grow(rows[side], depth + 1, *bounds[0])
            nodes[at][3] = grow(rows[~side], depth + 1, *bounds[1])
        else:
            margin[rows] += nodes[at][4]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True))
    return Forest(*(np.array(c) for c in cols), np.array(roots), bias)


def _measure(batches):
    for b in batches:
        rows = [statistics(t) for t in binary(b, "text")]
        yield arrays(["label", "stats"], [column(b, "label"), pa.array(rows, pa.list_(pa.int64()))])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Fit on the labelled documents of smallest id hash; only ``max_train`` rows of nine numbers reach the driver.
    Of rows with the same id the one of least text is measured."""
    usable = labels.where("doc_id is not null and quality is not null")
    share = min(1.0, 2 * max_train / max(1, usable.count()))  # of the hashes' range, so that few rows of a task are sorted
    sample = (usable.where(F.xxhash64("doc_id") <= int(-2**63 + share * (2**64 - 2048)))
              .select("doc_id", (F.col("quality") > 0).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train))
    one = (docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # max_train rows at most
           .groupBy("doc_id", "label").agg(F.min("text").alias("text")))  # of repeated ids the least text
    rows = one.mapInArrow(_measure, "label int, stats array<long>").collect()
    rows.sort(key=lambda r: (r.label, r.stats))
    stats = np.array([r.stats for r in rows], np.int64).reshape(-1, 9)
    return fit(features(stats), np.array([r.label for r in rows], float))


def judged(docs: DataFrame, model: Forest, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept; ``extra`` names columns of docs to carry along."""
    def run(batches):
        for b in batches:
            s = np.array([statistics(t) for t in binary(b, "text")], np.int64).reshape(-1, 9)
            score = model.score(features(s))
            failed = (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])
            yield arrays(names, [column(b, "doc_id"), *(s[:, i] for i in range(5)), failed, score,
                                 ~failed & (score >= KEEP_AT), *(column(b, c) for c in extra)])

    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
             "kept", *extra]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_STATS}, base_failed boolean, score double, kept boolean{carried}"
    return docs.select(*dict.fromkeys(["doc_id", "text", *extra])).mapInArrow(run, schema)


def filtered(docs: DataFrame, model: Forest) -> DataFrame:
    """The kept documents, with all columns of ``docs``."""
    def run(batches):
        for b in batches:
            s = np.array([statistics(t) for t in binary(b, "text")], np.int64).reshape(-1, 9)
            keep = (s[:, 0] >= 20) & (100 * s[:, 4] <= 30 * s[:, 0]) & (model.score(features(s)) >= KEEP_AT)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
