"""Harmonise wave files as they arrive (Structured Streaming, stateless)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wavestat.operators.harmonize import HarmonizeRules, combine_waves, harmonize_wave


def harmonize_wave_stream(spark: SparkSession, folder: str, schema: T.StructType, sources: Sequence[str],
                          year: int, rules: HarmonizeRules = HarmonizeRules(), codebook=None,
                          codebook_keeps_text: Sequence[str] = (), fmt: str = "parquet",
                          max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of harmonised rows from wave files landing in ``folder``.

    File sources need an explicit schema (no inference on streams).
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(folder)
    return combine_waves([harmonize_wave(raw, sources, year, rules, codebook, codebook_keeps_text)],
                         rules.items)


def append_waves_stream(harmonised: DataFrame, combined_path: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Append harmonised rows to the combined table (Parquet, partitioned by
    year).  The file sink with a checkpoint folder is exactly-once across
    restarts; ``checkpoint`` must be on shared storage on a cluster."""
    writer = (harmonised.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", combined_path)
              .partitionBy("year"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


__all__ = ["harmonize_wave_stream", "append_waves_stream"]
