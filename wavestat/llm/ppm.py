"""Language-model scoring by prediction by partial matching (PPM).

The text's bytes (A-Z lower-cased) between end marks are coded with contexts
of up to five bytes.  A symbol seen in a context gets c / (t + d) of it
(t: the context's count, d: its distinct symbols); else the escape d / (t + d)
is paid and the next shorter context is asked, without the symbols already
excluded; at last all remaining bytes are equally likely.

Six-byte grams (five bytes of context and the next byte) hold the whole trie.
One pass cuts the documents into blocks of ``BLOCK_BYTES`` and writes them with
each block's distinct words and grams and their training uses, dealt over hash
buckets as compressed lists.  A bucket sums the uses of all blocks.  Each gram
gets its code length in the group of its last three context bytes, which is
handed the counts after its last two (256 at most; the order-1 table, 65,536
cells at most, goes to every task).  The buckets then give every block the
counts and code lengths of its own words and grams, in the order of the lists.
The buckets grow in number with the blocks, so no task holds the whole model or
vocabulary.

Null text is the empty text: one end token.  Repeated rows are each scored and
each counted.  With no training rows every word is unknown and all bytes are
equally likely.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, column, remainder, written  # noqa: F401

END = 255  # not a byte of UTF-8: start context and end symbol
ORDER = 5
BLOCK_BYTES, CHUNK_BYTES = 24 << 20, 2 << 20  # text of a block, and of the grams held at once
LEAST_BUCKETS = 256
_END_WORD = b"\xff"


def grams(text: bytes) -> np.ndarray:
    """Packed (five context bytes, next byte) of every position of the text and its end."""
    s = np.frombuffer(bytes([END] * ORDER) + text.lower() + bytes([END]), np.uint8).astype(np.int64)
    n = len(s) - ORDER
    packed = s[:n].copy()
    for k in range(1, ORDER + 1):
        packed = packed << 8 | s[k:n + k]
    return packed


def _packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def _coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of each word, number of each word, the distinct words), without the end tokens."""
    raw = pa.array(texts, pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(raw))
    words, at = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end gives an empty part
    coded = words.filter(real).dictionary_encode()
    return at[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(), coded.dictionary.view(pa.large_binary()).to_pylist()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the ascending keys by bucket, first place of each bucket and the end)"""
    own = _bucket(keys, buckets)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(buckets + 1))


def _dealt_words(words, buckets: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        out[zlib.crc32(w) % buckets].append(w)
    for ws in out:
        ws.sort()
    return out


def _sorted(texts: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([grams(t) for t in texts]))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the runs of equal values in sorted keys, the values)"""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return at, keys[at]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of all parts and their summed uses."""
    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    at, own = _runs(keys[order])
    n = np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])[order]
    return own, np.add.reduceat(n, at) if len(at) else n


class _Block:
    """Words and grams of the documents of a block, with their training uses."""

    def __init__(self):
        self.size, self.words, self.parts = 0, {}, []
        self.waiting: dict[bool, list] = {True: [], False: []}
        self.waits = {True: 0, False: 0}

    def add(self, text: bytes, trains: bool) -> None:
        self.size += len(text)
        self.waiting[trains].append(text)
        self.waits[trains] += len(text) + 1
        if self.waits[trains] >= CHUNK_BYTES:
            self.count(trains)

    def count(self, trains: bool) -> None:
        texts = self.waiting[trains]
        if texts:
            _, codes, words = _coded(texts)
            n = [*np.bincount(codes, minlength=len(words)).tolist(), len(texts)]
            for w, k in zip([*words, _END_WORD], n, strict=True):
                self.words[w] = self.words.get(w, 0) + (k if trains else 0)
            keys = _sorted(texts)
            at, own = _runs(keys)
            self.parts.append((own, np.diff(at, append=len(keys)) if trains else np.zeros(len(own), np.int64)))
        self.waiting[trains], self.waits[trains] = [], 0

    def lists(self, block: int, buckets: int, kind: pa.DataType) -> pa.RecordBatch:
        self.count(True)
        self.count(False)
        keys, n = _added(self.parts)
        order, starts = _dealt(keys, buckets)
        keys, n = keys[order], n[order]
        words = _dealt_words(self.words, buckets)
        cuts = [slice(a, e) for a, e in zip(starts[:-1], starts[1:], strict=True)]
        return arrays(_BLOCKS, [
            pa.nulls(buckets, kind), pa.nulls(buckets, pa.string()), pa.nulls(buckets, pa.bool_()),
            np.full(buckets, block, np.int64), np.arange(buckets, dtype=np.int64),
            pa.array([zstandard.compress(b" ".join(ws)) for ws in words], pa.binary()),
            pa.array([_packed(np.array([self.words[w] for w in ws], np.int64)) for ws in words], pa.binary()),
            pa.array([_packed(_steps(keys[c])) for c in cuts], pa.binary()),
            pa.array([_packed(n[c]) for c in cuts], pa.binary())])


_BLOCKS = ["doc_id", "text", "held_out", "block", "bucket", "words", "word_uses", "grams", "gram_uses"]


def _blocks(buckets: int, block_bytes: int):
    """The documents with their block (no bucket), and after them one row of lists for each block and bucket."""
    def run(batches):
        number, block, kind = TaskContext.get().partitionId() << 20, _Block(), None
        for b in batches:
            kind, at = column(b, "doc_id").type, []
            rows = zip(column(b, "text").cast(pa.binary()).to_pylist(), column(b, "held_out").to_pylist(), strict=True)
            for text, held_out in rows:
                text = text or b""
                if block.size and block.size + len(text) > block_bytes:
                    yield block.lists(number, buckets, kind)
                    number, block = number + 1, _Block()
                block.add(text, not held_out)
                at.append(number)
            yield arrays(_BLOCKS, [column(b, "doc_id"), column(b, "text"), column(b, "held_out"), np.array(at, np.int64),
                                   pa.nulls(len(at), pa.int64()), *(pa.nulls(len(at), pa.binary()) for _ in range(4))])
        if block.waiting[True] or block.waiting[False] or block.parts:
            yield block.lists(number, buckets, kind)

    return run


def _summed(key, table):
    """Of a bucket: the word counts for each block, and the distinct grams with their uses (no block)."""
    blocks, counts = table.column("block").to_pylist(), Counter()
    words = [zstandard.decompress(x).split() for x in table.column("words").to_pylist()]
    for ws, uses in zip(words, table.column("word_uses").to_pylist(), strict=True):
        for w, n in zip(ws, _unpacked(uses).tolist(), strict=True):
            counts[w] += n
    keys, n = _added([(np.cumsum(_unpacked(k)), _unpacked(u)) for k, u in
                      zip(table.column("grams").to_pylist(), table.column("gram_uses").to_pylist(), strict=True)])
    none = [None] * len(blocks)
    return pa.table({
        "bucket": pa.array([key[0].as_py()] * (len(blocks) + 1), pa.int64()), "block": pa.array([*blocks, None], pa.int64()),
        "counts": pa.array([*(_packed(np.array([counts[w] for w in ws], np.int64)) for ws in words), None], pa.binary()),
        "grams": pa.array([*none, _packed(_steps(keys))], pa.binary()), "gram_uses": pa.array([*none, _packed(n)], pa.binary()),
        "total": pa.array([*none, sum(counts.values())], pa.int64()),
        "vocabulary": pa.array([*none, sum(c > 0 for c in counts.values())], pa.int64())})


def _opened(batches):
    for b in batches:
        for keys, n in zip(column(b, "grams").to_pylist(), column(b, "gram_uses").to_pylist(), strict=True):
            yield arrays(["gram", "n"], [np.cumsum(_unpacked(keys)), _unpacked(n)])


def _delivered(key, uses, logs):
    """Of a bucket: the code lengths of the grams of each block."""
    gram = logs.column("gram").to_numpy()
    order = np.argsort(gram)
    gram, log = gram[order], logs.column("log").to_numpy()[order]
    values = [_packed(log[np.searchsorted(gram, np.cumsum(_unpacked(k)))]) for k in uses.column("grams").to_pylist()]
    return pa.table({"block": uses.column("block"), "bucket": uses.column("bucket"), "values": pa.array(values, pa.binary())})


def _estimate(order1: np.ndarray, buckets: int):
    """Code lengths of the grams that share the last three context bytes."""
    order0 = order1.sum(0)

    def run(key, table, shorter):
        gram = table.column("gram").to_numpy()
        if not len(gram):
            return pa.table({"bucket": pa.array([], pa.int64()), "gram": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        order = np.argsort(gram)
        gram, n = gram[order], table.column("n").to_numpy()[order]
        symbol = gram & 255
        own, at = np.unique(gram >> 8, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)[at]
        kinds = np.bincount(at, n > 0).astype(np.int64)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(n > 0, np.log10(n / (total + kinds)), np.where(total > 0, np.log10(kinds / (total + kinds)), 0.0))
        missed = np.flatnonzero(n == 0)
        if len(missed):
            four = gram >> 8 & 0xFFFFFFFF
            by_four = np.argsort(four, kind="stable")
            sorted_four = four[by_four]
            two = np.zeros(256, np.int64)
            for s, c in zip(shorter.column("symbols")[0].as_py(), shorter.column("counts")[0].as_py(), strict=True):
                two[s] = c
            below = (np.bincount(symbol, n, 256).astype(np.int64), two, order1[int(gram[0] >> 8 & 255)], order0)
            starts = np.searchsorted(at, np.arange(len(own) + 1))
            fours: dict[int, np.ndarray] = {}
            for i in missed.tolist():
                f = int(four[i])
                if f not in fours:
                    rows = by_four[np.searchsorted(sorted_four, f):np.searchsorted(sorted_four, f, "right")]
                    fours[f] = np.bincount(symbol[rows], n[rows], 256).astype(np.int64)
                gone = np.zeros(256, bool)
                rows = slice(starts[at[i]], starts[at[i] + 1])
                gone[symbol[rows][n[rows] > 0]] = True
                s = int(symbol[i])
                for counts in (fours[f], *below):
                    live = np.where(gone, 0, counts)
                    whole, distinct = int(live.sum()), int((live > 0).sum())
                    if live[s]:
                        logs[i] += math.log10(live[s] / (whole + distinct))
                        break
                    if whole:
                        logs[i] += math.log10(distinct / (whole + distinct))
                    gone |= counts > 0
                else:
                    logs[i] -= math.log10(256 - int(gone.sum()))
        return pa.table({"bucket": pa.array(_bucket(gram, buckets)), "gram": pa.array(gram), "log": pa.array(logs)})

    return run


def _scored(words_total: int, vocabulary: int, buckets: int):
    base = math.log10(words_total + vocabulary + 1)

    def run(key, docs, lists):
        texts = [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()]
        counts: list = [None] * buckets
        values: list = [None] * buckets
        for bucket, c, v in zip(*(lists.column(x).to_pylist() for x in ("bucket", "counts", "values")), strict=True):
            if c is not None:
                counts[bucket] = _unpacked(c)
            if v is not None:
                values[bucket] = _unpacked(v, np.float64)
        chunks, parts, a, size = [], [], 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= CHUNK_BYTES or i == len(texts) - 1:
                chunks.append((a, i + 1, *_coded(texts[a:i + 1])))
                parts.append(_runs(_sorted(texts[a:i + 1]))[1])
                a, size = i + 1, 0
        found = _dealt_words({_END_WORD}.union(*(c[4] for c in chunks)), buckets)
        count = {w: n for ws, uses in zip(found, counts, strict=True) for w, n in zip(ws, uses.tolist(), strict=True)}
        keys = _runs(np.sort(np.concatenate(parts)))[1]
        logs = np.empty(len(keys))
        logs[_dealt(keys, buckets)[0]] = np.concatenate(values)
        end = math.log10(count[_END_WORD] + 1)
        tokens, known, first, score = (np.empty(len(texts), t) for t in (np.int64, np.int64, float, float))
        for a, e, at, codes, words in chunks:
            uses = np.array([count[w] for w in words], np.int64)
            tokens[a:e] = np.bincount(at, minlength=e - a) + 1
            known[a:e] = np.bincount(at, uses[codes] > 0, e - a) + (count[_END_WORD] > 0)
            first[a:e] = np.bincount(at, np.log10(uses + 1.0)[codes], e - a) + end - tokens[a:e] * base
            gram, own = pd.factorize(np.concatenate([grams(t) for t in texts[a:e]]))
            starts = np.cumsum([0] + [len(t) + 1 for t in texts[a:e - 1]])
            score[a:e] = np.add.reduceat(logs[np.searchsorted(keys, own)][gram], starts)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([words_total] * len(tokens), pa.int64()),
            "base_score": pa.array(first, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def scored(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` is a boolean column."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    blocks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    buckets = max(LEAST_BUCKETS, blocks)
    cut = written(rows.coalesce(max(blocks, 2 * docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(
        _blocks(buckets, block_bytes), f"doc_id {kind}, text string, held_out boolean, block long, bucket long, words binary, word_uses binary, "
        "grams binary, gram_uses binary"), "ppm-blocks")
    uses = cut.where("bucket is not null")
    model = written(uses.select("bucket", "block", "words", "word_uses", "grams", "gram_uses").groupBy("bucket").applyInArrow(
        _summed, "bucket long, block long, counts binary, grams binary, gram_uses binary, total long, vocabulary long"), "ppm-model")
    total, vocabulary = model.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    grams_of = model.where("block is null").select("grams", "gram_uses").mapInArrow(_opened, "gram long, n long")
    order1 = np.zeros((256, 256), np.int64)  # at most 65,536 cells
    for pair, n in grams_of.groupBy(F.col("gram").bitwiseAND(65535)).agg(F.sum("n")).collect():
        order1[pair >> 8, pair & 255] = n
    context = F.shiftright("gram", 8)
    three = grams_of.select("gram", "n", context.bitwiseAND(0xFFFFFF).alias("three"))
    keys = grams_of.select(context.bitwiseAND(0xFFFFFF).alias("of_three")).distinct()
    two = (grams_of.groupBy(context.bitwiseAND(0xFFFF).alias("two"), F.col("gram").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n"))
           .where("n > 0").groupBy("two").agg(F.collect_list(F.struct("s", "n")).alias("cells")))  # 256 cells at most
    shorter = (keys.withColumn("two", F.col("of_three").bitwiseAND(0xFFFF)).join(two, "two", "left")
               .select("of_three", F.coalesce("cells.s", F.array().cast("array<long>")).alias("symbols"),
                       F.coalesce("cells.n", F.array().cast("array<long>")).alias("counts")))
    logs = three.groupBy("three").cogroup(shorter.groupBy("of_three")).applyInArrow(
        _estimate(order1, buckets), "bucket long, gram long, log double")
    values = uses.select("bucket", "block", "grams").groupBy("bucket").cogroup(logs.groupBy("bucket")).applyInArrow(
        _delivered, "block long, bucket long, values binary")
    nothing = F.lit(None).cast("binary")
    lists = (values.select("block", "bucket", nothing.alias("counts"), "values")
             .union(model.where("block is not null").select("block", "bucket", "counts", nothing)))
    return cut.where("bucket is null").select("doc_id", "text", "held_out", "block").groupBy("block").cogroup(
        lists.groupBy("block")).applyInArrow(
        _scored(int(total), int(vocabulary), buckets), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double")
