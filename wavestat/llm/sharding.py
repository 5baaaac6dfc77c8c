"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within their source by a seeded hash, given the fractional
rank (rank + phase of the source) / (rows of the source), sorted by it, and
cut into runs whose lengths differ by at most one (law "rows").  Every stretch
of the fractional order holds the sources in their overall proportions, so
every shard matches the mixture.

Exact ranks without a task per source: rows are counted per (source, hash
prefix), the counts are summed to offsets, and rows are numbered within a
prefix only; the same is done for the global order with slices of the
fractional rank.  A hot source is thereby spread over all tasks.

Nulls: a null source is a stratum of its own, a null text has no bytes, a null
doc_id sorts first among equal hashes; equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEED = "stratified-1"
SLICES = 4096  # hash prefixes (3 hex digits) and slices of the fractional rank


def _numbered(rows: DataFrame, group: list[str], cell: str, order: list, name: str) -> DataFrame:
    """Exact 0-based position within ``group`` ordered by (cell, order), by offsets of the cells."""
    before = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    if not group:
        before = W.partitionBy(F.lit(0)).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = (rows.groupBy(*group, cell).agg(F.count("*").alias("_n"))
             .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(cell).alias("_c"),
                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                     F.sum("_n").over(whole).alias(f"{name}_of")))
    match = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col(cell) == F.col("_c")]
    cond = match[0]
    for m in match[1:]:
        cond &= m
    at = F.row_number().over(W.partitionBy(*group, cell).orderBy(*order)) - 1
    drop = [f"_g{i}" for i in range(len(group))] + ["_c", "_off", "_at"]
    return (rows.withColumn("_at", at).join(cells, cond)
            .withColumn(name, F.col("_off") + F.col("_at")).drop(*drop))


def sharded(docs: DataFrame, shards: int = 40, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source and the fractional rank of every row."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                      F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = (docs.select("doc_id", "source", (F.octet_length(raw) + 16).cast("long").alias("size"),
                        F.crc32(raw).alias("text_crc32"))
            .withColumn("_h", F.md5(key)).withColumn("_p", F.substring("_h", 1, 3)))
    ranked = _numbered(rows, ["source"], "_p", ["_h", "doc_id"], "_rank")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("-")))), 1, 6), 16, 10)
    fraction = (F.col("_rank") + phase.cast("double") / F.lit(16777216.0)) / F.col("_rank_of")
    placed = (ranked.withColumn("fraction", fraction)
              .withColumn("_s", F.floor(F.col("fraction") * SLICES)))
    placed = _numbered(placed, [], "_s", ["fraction", "source", "_h", "doc_id"], "_pos")
    shard = F.expr(f"(_pos * {shards}) div _pos_of")
    return (placed.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.expr(f"_pos - (shard * _pos_of + {shards - 1}) div {shards}"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source", "fraction"))
