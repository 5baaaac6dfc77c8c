"""Wave files and the combined respondent table: readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_wave(spark: SparkSession, path: str, fmt: str = "parquet",
              schema: T.StructType | None = None, **options) -> DataFrame:
    """Read one wave file (Parquet, CSV, JSON, ORC); one table per path."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    return reader.load(path)


def read_waves(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Lazy reads of many waves (wave key -> DataFrame)."""
    return {key: read_wave(spark, path, fmt, **options) for key, path in paths.items()}


def write_combined(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the combined table as Parquet partitioned by year (year filters
    then prune whole directories).

    Rows are rebalanced by year first: a small year is one file, a large one is
    split at the session's advisory partition size, so neither many tasks write
    a sliver each of every year nor one task writes a whole large wave.
    """
    df = df.hint("rebalance", "year")
    df.write.mode(mode).partitionBy("year").parquet(path)


def read_combined(spark: SparkSession, path: str, years=None) -> DataFrame:
    """Scan the combined table; a year list becomes a partition filter."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    return df


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Result sink: write a product table (Parquet or CSV with header)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
