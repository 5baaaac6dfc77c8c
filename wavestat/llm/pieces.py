"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is cut into words before each run of spaces (no piece of the model has
an inner space mark) and at adjacent characters that no piece holds side by
side; the distinct new words of a batch are merged together in flat numpy
arrays: per round the minimum pair rank of each word (segmented minimum), one
leftmost merge per word, all words at once, and compaction, until no pair
remains.  One merge per word and round keeps the library's order exactly.
Words over ``LONG`` symbols take the same merges from a heap.

Null text is the empty text: no tokens, the hash of the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import arrays, column, strings

MARK = "▁"
LONG = 128
CACHE_BYTES, REMEMBERED = 64 << 20, 256  # memory for words of at most so many characters per task; when full it starts anew
_NONE = np.int64(2**40)


class Pieces:
    """The model's tables and the word encoder."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(len(self.names))]
        self.byte = {i: int(n[3:5], 16) for i, n in enumerate(self.names) if sp.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        self.ids = {n: i for i, n in enumerate(self.names) if not special[i]}
        self.bytes_of = [bytes([self.byte[i]]) if i in self.byte else b"" if sp.is_control(i) else
                         " \u2047 ".encode() if sp.is_unknown(i) else n.replace(MARK, " ").encode()
                         for i, n in enumerate(self.names)]
        rank = {n: -sp.get_score(i) for n, i in self.ids.items()}
        self.beside = {n[k:k + 2] for n in self.ids for k in range(len(n) - 1)}
        # each way to build a piece of two pieces: (left, right) -> (rank, piece)
        ways = [(self.ids[n[:k]], self.ids[n[k:]], rank[n], i) for n, i in self.ids.items()
                for k in range(1, len(n)) if n[:k] in self.ids and n[k:] in self.ids]
        self.pairs = np.array([a << 20 | b for a, b, _, _ in ways], np.int64)
        self.made = np.array([i for *_, i in ways], np.int64)
        levels = np.unique([r for _, _, r, _ in ways], return_inverse=True)[1].astype(np.int64)
        by = np.argsort(self.pairs)
        self.pairs, self.made, self.rank = self.pairs[by], self.made[by], levels[by]
        self.lookup = {int(p): (int(r), int(m)) for p, r, m in zip(self.pairs, self.rank, self.made, strict=True)}
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0
        #: by code point: the character's piece, or -1 - code point
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for n, i in self.ids.items():
            if len(n) == 1:
                self.of_char[ord(n)] = i
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def rounds(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words; ids: symbols of all words (-1: a character without a piece), word: their word number."""
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def pair_ranks(at):
            """Rank and table place of the pairs that start at the given symbols."""
            right = np.minimum(at + 1, len(ids) - 1)
            left, after = ids[at], ids[right]
            fits = (at < right) & (word[at] == word[right]) & (left >= 0) & (after >= 0)
            key = np.where(fits, left << 20 | np.maximum(after, 0), -1)
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            return np.where(self.pairs[place] == key, self.rank[place], _NONE), place

        rank, place = pair_ranks(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            hits = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < _NONE))
            first = hits[np.append(True, word[hits][1:] != word[hits][:-1])] if len(hits) else hits
            ids[first] = self.made[place[first]]
            keep = np.repeat(least < _NONE, sizes)
            done.append((ids[~keep], word[~keep]))
            keep[first + 1] = False
            moved = np.cumsum(keep)[first] - 1
            ids, word, rank, place = ids[keep], word[keep], rank[keep], place[keep]
            # only the pairs at a merge and just before it are new
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            if len(changed):
                rank[changed], place[changed] = pair_ranks(changed)
        if not done:
            return ids, word
        ids, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def heap(self, ids: list[int]) -> list[int]:
        """The same merges for one long word: best rank first, then leftmost."""
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        found = lambda i: self.lookup.get(ids[i] << 20 | ids[after[i]]) if ids[i] >= 0 and after[i] >= 0 and ids[after[i]] >= 0 else None
        queue = [(w[0], i, ids[i], ids[after[i]]) for i in range(len(ids)) if (w := found(i))]
        heapq.heapify(queue)
        gone = bytearray(len(ids))
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if gone[i] or ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i] = found(i)[1]
            gone[j], after[i] = 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (w := found(k)):
                    heapq.heappush(queue, (w[0], k, ids[k], ids[after[k]]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before and remember token count, ids as text and decoded bytes."""
        parts: list[tuple[int, str]] = []  # (word, stretch without a hard boundary)
        for n, w in enumerate(new):
            a = 0
            if len(w) > 64:
                for k in range(len(w) - 1):
                    if w[k:k + 2] not in self.beside:
                        parts.append((n, w[a:k + 1]))
                        a = k + 1
            parts.append((n, w[a:]))
        tokens: list[list[int]] = [[] for _ in new]
        short = [p for p in range(len(parts)) if len(parts[p][1]) <= LONG]
        text = "".join(parts[p][1] for p in short)
        ids = self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        part = np.repeat(np.array(short, np.int64), [len(parts[p][1]) for p in short]) if short else np.zeros(0, np.int64)
        ids, part = self.rounds(ids, part)
        ends = np.searchsorted(part, np.arange(len(parts) + 1))
        flat = ids.tolist()
        for p, (n, s) in enumerate(parts):
            got = flat[ends[p]:ends[p + 1]] if len(s) <= LONG else self.heap([self.ids.get(c, -1 - ord(c)) for c in s])
            if got and min(got) < 0:
                got = [y for x in got for y in ([x] if x >= 0 else [self.of_byte[b] for b in chr(-1 - x).encode()])]
            tokens[n] += got
        for w, t in zip(new, tokens, strict=True):
            known = len(t), ",".join(map(str, t)), self.raw(t)
            self.words[w] = known
            self.held += 300 + 2 * len(w) + len(known[1]) + len(known[2])  # with the objects around them

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.words.clear()
            self.held = 0
        new = list({w for ws in cut for w in ws if w not in self.words})
        for a in range(0, len(new), 50_000):
            self.learn(new[a:a + 50_000])
        out = []
        for ws in cut:
            got = [self.words[w] for w in ws]
            text = b"".join(t for _, _, t in got).decode("utf-8", "replace")
            out.append((sum(n for n, _, _ in got), ",".join(s for _, s, _ in got), text[1:]))
        for w in new:
            if len(w) > REMEMBERED:
                del self.words[w]
        return out

    def raw(self, ids) -> bytes:
        """Bytes of the ids: pieces with marks as spaces, byte pieces as their byte, control pieces as nothing."""
        return b"".join(self.bytes_of[i] for i in ids)

    def decode(self, ids) -> str:
        """Text of the ids of a whole text; the space put before the first word is dropped."""
        text = self.raw(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text (and the ids themselves)."""
    def run(batches):
        pieces = Pieces(model)
        for b in batches:
            texts = [t or "" for t in strings(b, "text")]
            counts, digests, ids = [], [], []
            for a in range(0, len(texts), 500):  # ids and texts of so many at once
                for n, joined, text in pieces.encode(texts[a:a + 500]):
                    counts.append(n)
                    digests.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                    if with_ids:
                        ids.append(np.array(joined.split(",") if joined else [], np.int32))
            cols = [column(b, "doc_id"), pa.array(counts, pa.int64()), [x for x, _ in digests], [y for _, y in digests]]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids])))
            yield arrays(names, [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cols])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
