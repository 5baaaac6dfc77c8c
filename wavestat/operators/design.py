"""Model-design helpers: dummy columns, group-dependent set flags and the
wave-dependent complete-case rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestat.functions import all_not_null, eq_dummy, in_dummy

# A flag dimension is built from a driver-side configuration mapping; its size
# is the configuration's size, checked here before it is broadcast.
MAX_BROADCAST_FLAG_ROWS = 1_000_000


def add_dummies(df: DataFrame, spec: Sequence[tuple[str, str, Sequence[str], str]]) -> DataFrame:
    """Add indicator columns.

    ``spec``: ``(name, column, values, form)``; form ``"eq"`` is the equality
    dummy (NULL input -> NULL), ``"in"`` the membership dummy (NULL -> 0).
    """
    cols = {}
    for name, col, values, form in spec:
        if form == "eq":
            if len(values) != 1:
                raise ValueError(f"equality dummy {name} needs exactly one value")
            cols[name] = eq_dummy(col, values[0])
        elif form == "in":
            cols[name] = in_dummy(col, values)
        else:
            raise ValueError(f"unknown dummy form {form!r}")
    return df.withColumns(cols)


def flag_table(spark: SparkSession, sets_by_key: Mapping[object, Sequence[str]],
               key_col: str = "year", value_col: str = "state",
               key_type: T.DataType = T.IntegerType()) -> DataFrame:
    """Dimension ``(key, value)`` from a per-key set configuration."""
    rows = [(k, v) for k, vals in sets_by_key.items() for v in dict.fromkeys(vals)]
    schema = T.StructType([T.StructField(key_col, key_type, False),
                           T.StructField(value_col, T.StringType(), False)])
    return spark.createDataFrame(rows, schema)


def add_set_flag(df: DataFrame, flags: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1.0 when the row's ``keys`` appear in ``flags``, else 0.0 (NULL key -> 0.0).

    ``flags`` is a dimension (e.g. from ``flag_table``).  Its distinct keys are
    counted first: up to ``MAX_BROADCAST_FLAG_ROWS`` it is broadcast, so the
    large side is not shuffled; beyond that it is a plain left join (shuffle,
    planned by AQE).
    """
    marked = flags.select(*keys).distinct().withColumn("__flag", F.lit(1.0))
    small = marked.count() <= MAX_BROADCAST_FLAG_ROWS  # configuration-sized: a cheap job
    joined = df.join(F.broadcast(marked) if small else marked, list(keys), "left")
    return joined.withColumn(out, F.coalesce(F.col("__flag"), F.lit(0.0))).drop("__flag")


def complete_case_by_key(df: DataFrame, key_col: str, rules: Mapping[object, Sequence[str]],
                         default: Sequence[str]) -> DataFrame:
    """Keep rows complete on a column list that depends on the row's key.

    One filter predicate (no grouped map): ``CASE key WHEN k THEN all
    non-null(cols_k) ... ELSE all non-null(default) END``; only listed columns
    present in ``df`` count.
    """
    present = set(df.columns)
    pred = None
    for key, cols in rules.items():
        cond = all_not_null([c for c in cols if c in present])
        pred = F.when(F.col(key_col) == F.lit(key), cond) if pred is None else pred.when(
            F.col(key_col) == F.lit(key), cond)
    dflt = all_not_null([c for c in default if c in present])
    pred = dflt if pred is None else pred.otherwise(dflt)
    return df.filter(pred)
