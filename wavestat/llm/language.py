"""Language identification by compression with per-language zstandard dictionaries.

Each learned language has a raw-content dictionary of ``DICT_BYTES`` made of
sampled texts; texts are reduced to lower-case words of letters first.  Texts
under ``SHORT`` bytes are coded with zstandard's optimal parser, because a byte
decides there; longer ones with the fast one.  A text is
compressed with every dictionary; the smallest result names the language.
The decision is marked as rejected when the margin to the second is narrow.

Learned from at most ``PER_LANG`` texts of a language (smallest id hashes).
Null text or no letter: "und", score 0, rejected.  Ties: the language with
more sampled bytes, then by name.  With no learnable rows all is "und".  Of a
sampled text the dictionary takes the first ``DICT_BYTES`` characters; scored
texts are read whole.  Repeated rows are each scored; an empty table gives none.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrays, column, remainder, strings

PER_LANG, DICT_BYTES, MARGIN, SHORT = 300, 112 * 1024, 0.01, 2000
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """The text's words of letters, lower-cased, between single spaces; b"" if it has no letter."""
    found = _WORDS.findall(text.lower())
    if not text.isascii():  # the pattern also takes numerals like superscripts and fractions
        found = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in found]
        found = [w for w in found if w]
    return f" {' '.join(found)} ".encode() if found else b""


def dictionaries(docs: DataFrame, per_lang: int = PER_LANG, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language from (doc_id, text, lang) rows."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*")).collect()  # a row per dictionary
    if not counts:
        return {}
    rows_of = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, n)])
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    sampled = usable.where(draw * rows_of[F.col("lang")] <= 2 * per_lang)
    first = W.partitionBy("lang").orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id", F.xxhash64("text"))
    rows = (sampled.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_lang)
            .select("lang", "_r", F.substring("text", 1, size).alias("text")).collect())
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r._r)):
        have = out.get(r.lang, b"")
        if len(have) < size:
            out[r.lang] = (letters(r.text) + have)[-size:]
    return out


class Judge:
    def __init__(self, contents: dict[str, bytes]):
        self.names = sorted(contents, key=lambda k: (-len(contents[k]), k))
        self.fast, self.close = ([self._coder(contents[k], s) for k in self.names]
                                 for s in (zstandard.STRATEGY_GREEDY, zstandard.STRATEGY_BTOPT))

    @staticmethod
    def _coder(content: bytes, strategy: int) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(
            6, window_log=18, min_match=3, strategy=strategy, write_content_size=False, write_checksum=False,
            write_dict_id=False)
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=own)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)"""
        data = letters(text or "")
        if not self.names or not data:
            return "und", 0.0, False
        sizes = [len(c.compress(data)) for c in (self.close if len(data) < SHORT else self.fast)]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        return self.names[best], min(1.0, 0.5 + 5 * margin), margin >= MARGIN


def identified(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, from the text alone."""
    def run(batches):
        judge = Judge(contents)
        for b in batches:
            got = [judge(t) for t in strings(b, "text")]
            yield arrays(["doc_id", "held_out", "lang_pred", "score", "accepted"], [
                column(b, "doc_id"), column(b, "held_out"), pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
