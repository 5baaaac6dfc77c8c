"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are read as lower-case words (A-Z), known by 64-bit
hashes whose first bits are one of ``FEATURES`` features, with document frequencies counted over all documents.  A
randomised SVD of the TF-IDF passages of all documents is computed by Spark
tasks that sum A'(A W); only FEATURES x RANK numbers reach the driver.  The
first ``DROP`` directions, which hold the languages' common words, are left out, and
each word's row is scaled to unit length, so that frequent words do not drown the rest.
Every passage of every document (runs of chunks of ``CHUNK`` words, at every chunk,
about as long as the item) is compared with all items, in blocks of items, by the
cosine of their sums of rows, weighted by squared inverse document frequency and, on
both sides, over the words of the block's items (a paraphrase's own words are not
held against it); those of ``COSINE`` or more are candidates.  They are decided on the text, with an item's
length of words more on either side: one whose words fill less than ``LIKELY`` of the
item cannot hold a subsequence of that share and goes; then the longest common subsequence of words with the item, and with the
item's answer (its last ``ANSWER`` words, as the table has no answer column),
whose words must stand within ``SPAN`` words and count by their inverse document
frequency; an answer of common words, of less than half the item's weight a
word, decides nothing.  Candidates of a share of ``LIKELY`` or more are returned; of these, a share of
``SURE`` or the answer makes contamination.

Null or blank texts and items without words give no rows; an item without an id is
named by the hash of its text (``item_hash``, given for all).  Repeated rows are
each reported, repeated items once.  Texts are read whole, whatever their length.  With an empty documents or benchmark table the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, binary, column, free_names

FEATURE_BITS, RANK, DROP, OVER, POWER = 14, 64, 8, 16, 0
FEATURES = 1 << FEATURE_BITS
CHUNK, COSINE, SEARCH_WORDS = 8, 0.7, 1 << 17
ITEM_BLOCK, FIT_PASSAGE, FIT_BLOCK, FIT_TASKS = 5000, 32, 512, 64
ANSWER, SPAN, SURE, LIKELY, ANSWERED = 8, 12, 0.7, 0.5, 0.75
_FOLDED = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_BYTES = np.array([0 if b == 32 else b for b in _FOLDED], np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


class Hashes:
    """64-bit hashes of a text's words, from prefix sums of byte * base ** place (modulo 2 ** 64)."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))

    def __call__(self, text: bytes) -> np.ndarray:
        raw = _BYTES[np.frombuffer(text, np.uint8)]
        n = len(raw)
        if n > len(self.powers):
            self.powers, self.inverses = self._powers(_BASE, 2 * n), self._powers(pow(_BASE, -1, 1 << 64), 2 * n)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = raw > 0
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(raw * self.powers[:n], out=sums[1:])
        got = (sums[ends] - sums[starts]) * self.inverses[starts]
        return (got ^ got >> np.uint64(32)) * _MIX


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _frequencies(batches):
    hashes, seen, n = Hashes(), np.zeros(FEATURES, np.int64), 0
    for b in batches:
        for t in binary(b, "text"):
            n += 1
            here = np.zeros(FEATURES, bool)
            here[_features(hashes(t))] = True
            seen += here
    used = np.flatnonzero(seen)
    yield arrays(["feature", "n"], [np.append(used, -1), np.append(seen[used], n)])


def _blocks(batches, hashes: Hashes):
    """(features, passage, passages) of about ``FIT_BLOCK`` words of one or more texts, in passages of ``FIT_PASSAGE``."""
    held, at, words_held, passages = [], [], 0, 0
    for b in batches:
        for t in binary(b, "text"):
            whole = _features(hashes(t))
            for k in range(0, len(whole), FIT_BLOCK):
                f = whole[k:k + FIT_BLOCK]
                held.append(f)
                at.append(passages + np.arange(len(f)) // FIT_PASSAGE)
                words_held, passages = words_held + len(f), int(at[-1][-1]) + 1
                if words_held >= FIT_BLOCK:
                    yield np.concatenate(held), np.concatenate(at), passages
                    held, at, words_held, passages = [], [], 0, 0
    if held:
        yield np.concatenate(held), np.concatenate(at), passages


def _spread(idf: np.ndarray, basis: np.ndarray):
    """A'(A W) of all passages (``FIT_PASSAGE`` words each), one sum per task, in rows of feature blocks."""
    def run(batches):
        out, slot = np.zeros((FEATURES, basis.shape[1]), np.float32), np.zeros(FEATURES, np.int64)
        for f, at, n in _blocks(batches, Hashes()):
            seen = np.zeros(FEATURES, bool)
            seen[f] = True
            own = np.flatnonzero(seen)
            slot[own] = np.arange(len(own))
            cells = np.bincount(slot[f] * n + at, idf[f], len(own) * n).reshape(-1, n).astype(np.float32)
            norm = np.maximum(np.bincount(at, idf[f] ** 2, n), 1e-9).astype(np.float32)
            out[own] += cells @ (cells.T @ basis[own] / norm[:, None])
        out = out.astype(np.float32)
        for k in range(0, FEATURES, 1024):
            yield arrays(["part", "sums"], [pa.array([k], pa.int32()), pa.array([out[k:k + 1024].tobytes()], pa.binary())])

    return run


def _added(key, table):
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def fitted(docs: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(idf, features x rank basis with rows of unit length): frequencies and passages of all documents."""
    idf = np.zeros(FEATURES, np.float64)
    rows = docs.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()
    total = max([n for f, n in rows if f < 0], default=0)
    idf[:] = np.log((total + 1) / 1.0)
    for f, n in rows:
        if f >= 0:
            idf[f] = np.log((total + 1) / (n + 0.5))
    idf = np.maximum(idf, 0.0)
    tasks = max(FIT_TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism)  # each sends one sum of FEATURES rows
    texts = docs.select("text").coalesce(tasks)
    basis = np.random.default_rng(7).standard_normal((FEATURES, DROP + rank + OVER)).astype(np.float32)
    for _ in range(1 + POWER):
        parts = texts.mapInArrow(_spread(idf, np.linalg.qr(basis)[0]), "part int, sums binary").groupBy("part").applyInArrow(
            _added, "part int, sums binary").collect()
        got = np.zeros((FEATURES, DROP + rank + OVER), np.float32)
        for part, sums in parts:
            got[part:part + 1024] = np.frombuffer(sums, np.float32).reshape(1024, -1)
        basis = got
    left, size, _ = np.linalg.svd(basis, full_matrices=False)
    live = int((size > 1e-6 * max(size[0], 1e-30)).sum())  # a small corpus has fewer directions, and no common ones to spare
    drop = min(DROP, live // 10)
    left = left[:, drop:max(drop + 1, min(drop + rank, live))]
    far = np.linalg.norm(left, axis=1, keepdims=True)
    return idf, np.where(far > 1e-7, left / np.maximum(far, 1e-7), 0)


def _in_order(length: int, matches) -> int:
    """Longest common subsequence (bit-parallel) of a text of ``length`` words with another, whose words are given as the
    bits of their positions in the first text; words that are not in it may be left out."""
    row, full = 0, (1 << length) - 1
    for found in matches:
        x = row | found
        row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


def places(words: list) -> dict:
    """Word -> bits of its positions."""
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence of two texts."""
    spots = places(a)
    return _in_order(len(a), [spots[w] for w in b if w in spots])


def _answered(last: list, weights: list[float], spots: list[int], found: list) -> float:
    """Greatest weight of the words of ``last`` that occur in order within ``SPAN`` words, of ``found`` words at ``spots``."""
    at, best = [(p, w) for p, w in zip(spots, found, strict=True) if w in last], 0.0
    for i, (start, _) in enumerate(at):
        row = [0.0] * (len(last) + 1)
        for p, w in at[i:]:
            if p >= start + SPAN:
                break
            before = 0.0
            for j, x in enumerate(last):
                old = row[j + 1]
                row[j + 1] = max(old, row[j], before + weights[j] if x == w else 0.0)
                before = old
        best = max(best, row[-1])
    return best


def _matched(items: list[tuple[int | None, int, list[bytes]]], idf: np.ndarray, basis: np.ndarray, least_cosine: float | None):
    weighted = (idf[:, None] ** 2 * basis).astype(np.float32)
    hashes = Hashes()
    coded = [hashes(b" ".join(ws)) for *_, ws in items]
    wanted = np.stack([weighted[_features(h)].sum(0) for h in coded])
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-9)
    known, ids = np.unique(np.concatenate(coded), return_inverse=True)
    lengths = np.array([len(h) for h in coded])
    ids = [w.tolist() for w in np.split(ids, np.cumsum(lengths)[:-1])]
    first_of = np.searchsorted(known >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
    deep = int(np.diff(first_of).max())  # most known words that share their first 20 bits
    rows_of = np.concatenate([weighted[_features(known)], np.zeros((1, basis.shape[1]), np.float32)])  # other words add nothing
    whole, last = [places(w) for w in ids], [w[-ANSWER:] for w in ids]
    rare = [idf[_features(h)].tolist() for h in coded]
    least_weight = [max(sum(x[-ANSWER:]), sum(x) / len(x) / 2 * min(len(x), ANSWER), 1e-9) for x in rare]
    # the items by the chunks of their passages: the powers of two below and above the item's length
    power = np.log2(lengths / CHUNK)
    spans = 1 << np.maximum(0, np.stack([np.floor(power), np.ceil(power)]).astype(int))
    classes = [(int(k), np.flatnonzero((spans == k).any(0))) for k in np.unique(spans)]

    def numbered(ws: np.ndarray) -> np.ndarray:
        """Number of each known word, else that after the last."""
        at = first_of[(ws >> np.uint64(44)).astype(np.int64)]
        word = np.full(len(ws), len(known))
        for k in range(deep):
            spot = np.minimum(at + k, len(known) - 1)
            np.copyto(word, spot, where=known[spot] == ws)
        return word

    def candidates(word: np.ndarray, starts: np.ndarray, of: np.ndarray):
        """(chunks, passage, item, cosine) of the passages, runs of chunks from each chunk on, near to an item."""
        sums, ends = np.empty((len(starts), basis.shape[1]), np.float32), np.append(starts, len(word))
        for k in range(0, len(starts), 4096):
            low, high = starts[k], ends[min(k + 4096, len(starts))]
            sums[k:k + 4096] = np.add.reduceat(rows_of[word[low:high]], starts[k:k + 4096] - low, axis=0)
        span = 1
        for chunks, own in classes:
            while span < chunks:  # a run of twice as many chunks, within the document
                same = np.flatnonzero(of[span:] == of[:-span])
                twice = sums.copy()
                twice[same] += sums[same + span]
                sums, span = twice, 2 * span
            towards = wanted[own].T.copy()
            for k in range(0, len(sums), 4096):
                part = sums[k:k + 4096]
                cosines = (part / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None] @ towards).ravel()
                near = np.flatnonzero(cosines >= (-2 if least_cosine is None else least_cosine))
                yield chunks, near // len(own) + k, own[near % len(own)], cosines[near]

    def searched(docs: list[np.ndarray]) -> dict[tuple[int, int], tuple]:
        """(document, item) -> share, answer's share, cosine, first and end word of the best passage."""
        words_of = np.concatenate(docs)
        edges = np.cumsum([0] + [len(d) for d in docs])
        starts = np.concatenate([np.arange(a, e, CHUNK) for a, e in zip(edges[:-1], edges[1:], strict=True)])
        of = np.searchsorted(edges, starts, "right") - 1
        word, flag = numbered(words_of), np.zeros(len(known) + 1, bool)
        best: dict[tuple[int, int], tuple] = {}
        for chunks, r, items_of, cosines in candidates(word, starts, of):
            order = np.argsort(items_of, kind="stable")
            cuts = np.flatnonzero(np.diff(items_of[order], prepend=-1, append=-1))
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                c = int(items_of[order[a]])
                flag[ids[c]] = True
                for k in range(a, e, 4096):
                    rows = order[k:min(k + 4096, e)]
                    compared(c, flag, word, edges, of[r[rows]], starts[r[rows]], chunks * CHUNK, cosines[rows], best)
                flag[ids[c]] = False
        return best

    def compared(c, flag, word, edges, of, starts, size, cosines, best) -> None:
        """Keep the best of the passages of an item; those with too few of its words around them cannot hold its share."""
        n = int(lengths[c])
        low, high = np.maximum(starts - n, edges[of]), np.minimum(starts + size + n, edges[of + 1])
        at = low[:, None] + np.arange(size + 2 * n)
        inside = at < high[:, None]
        hits = flag[word[np.minimum(at, len(word) - 1)]] & inside
        few = np.flatnonzero(hits.sum(1) >= LIKELY * n)
        own_words, times = np.unique(ids[c], return_counts=True)
        r, spot = np.nonzero(hits[few])
        counts = np.bincount(r * len(times) + np.searchsorted(own_words, word[at[few[r], spot]]), minlength=len(few) * len(times))
        few = few[np.minimum(counts.reshape(-1, len(times)), times).sum(1) >= LIKELY * n]  # words as often as the item has them
        done: dict[tuple[int, int], tuple[float, float]] = {}  # passages often hold the same of the item's words
        for i in few.tolist():
            spots = at[i][hits[i]].tolist()
            if (spots[0], spots[-1]) not in done:
                found = word[spots].tolist()
                share, answer = _in_order(n, [whole[c][w] for w in found]) / n, 0.0
                if share >= LIKELY:
                    answer = _answered(last[c], rare[c][-ANSWER:], spots, found) / least_weight[c]
                done[spots[0], spots[-1]] = share, answer
            share, answer = done[spots[0], spots[-1]]
            if share >= LIKELY:
                d = int(of[i])
                own = (share, answer, float(cosines[i]), int(low[i] - edges[d]), int(high[i] - edges[d]))
                best[d, c] = max(best.get((d, c), own), own)

    def run(batches):
        hashes = Hashes()
        for b in batches:
            out: list[tuple] = []
            names, docs, held = [], [], 0
            texts = binary(b, "text")
            for i, (doc_id, t) in enumerate(zip(column(b, "doc_id").to_pylist(), texts, strict=True)):
                ws = hashes(t)
                if len(ws):
                    names.append(doc_id)
                    docs.append(ws)
                    held += len(ws)
                if docs and (held >= SEARCH_WORDS or i == len(texts) - 1):
                    for (d, c), (share, answer, cos, a, e) in sorted(searched(docs).items()):
                        out.append((names[d], *items[c][:2], cos, share, answer, share >= SURE or answer >= ANSWERED, a, e))
                    names, docs, held = [], [], 0
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.bool_(), pa.int64(), pa.int64()]
            yield arrays(NAMES, [pa.array([*c], t) for c, t in zip(cols, types, strict=True)])

    return run


NAMES = ["doc_id", "item_id", "item_hash", "cosine", "lcs_share", "answer_share", "contaminated", "first_word", "end_word"]


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float | None = COSINE) -> DataFrame:
    """Candidate (doc_id, item) pairs of share ``LIKELY`` or more with cosine, LCS shares, verdict and the words of the
    document compared.  ``cosine`` is the least of a candidate passage; None makes every passage a candidate."""
    items = [(r.item_id, r.item_hash, words(r.text.encode())) for r in benchmark.where("text is not null")
             .select("item_id", F.xxhash64("text").alias("item_hash"), "text").distinct().orderBy("item_id", "text").toLocalIterator()]
    items = [x for x in items if x[2]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, item_id long, item_hash long, cosine double, lcs_share double, answer_share double, "
              "contaminated boolean, first_word long, end_word long")
    if not items:
        return docs.sparkSession.createDataFrame([], schema)
    model = fitted(docs)
    found = None
    for a in range(0, len(items), ITEM_BLOCK):
        part = docs.select("doc_id", "text").mapInArrow(_matched(items[a:a + ITEM_BLOCK], *model, cosine), schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all columns of ``docs``; rows of null doc_id are matched by text."""
    row, bad = free_names(docs, "row", "bad")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    hit = matches(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark).where("contaminated").select(
        F.col("doc_id").alias(bad)).distinct()
    return keyed.join(hit, F.col(row) == F.col(bad), "left_anti").drop(row)
