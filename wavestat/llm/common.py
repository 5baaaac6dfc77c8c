"""Helpers shared by the operators: Arrow batch access, hashing rules, written tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b"" (every operator here treats null text as empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column's text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % modulus


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrays(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ranks(values) -> np.ndarray:
    """Dense integer ids of the values (equal values share an id)."""
    ids: dict = {}
    return np.fromiter((ids.setdefault(v, len(ids)) for v in values), np.int64, len(values))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
