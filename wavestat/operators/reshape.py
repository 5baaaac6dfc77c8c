"""Wide <-> long reshapes.

``unpivot_items`` is a Catalyst ``Expand``: it multiplies rows by the number of
items inside one stage, with no shuffle.  Long -> wide is written as
conditional aggregates over an explicit value list, so the output columns are
known before the job runs (no extra job to discover pivot values) and the
aggregate is partial/final like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_items(df: DataFrame, ids: Sequence[str], items: Sequence[str],
                  name_col: str = "item", value_col: str = "value") -> DataFrame:
    """Wide -> long over ``items``, carrying ``ids``; NULL values are kept."""
    return df.unpivot(list(ids), list(items), name_col, value_col)


def pivot_first(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence,
                value_cols: Sequence[str], name_fmt: str = "{value}_{pivot}") -> DataFrame:
    """Long -> wide keeping one value per (keys, pivot value).

    One aggregation; output column ``name_fmt.format(value=<value col>,
    pivot=<pivot value>)`` for each pivot value and value column.  Absent
    combinations are NULL.
    """
    aggs: list[Column] = []
    for p in values:
        for v in value_cols:
            aggs.append(F.first(F.when(F.col(pivot_col) == F.lit(p), F.col(v)), ignorenulls=True)
                        .alias(name_fmt.format(value=v, pivot=p)))
    return df.groupBy(*keys).agg(*aggs)


def pivot_counts(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Sequence,
                 name_fmt: str = "{pivot}") -> DataFrame:
    """Cross-tab counts with zero fill: one column per listed pivot value."""
    aggs = [F.count_if(F.col(pivot_col) == F.lit(p)).alias(name_fmt.format(pivot=p)) for p in values]
    return df.groupBy(*keys).agg(*aggs)


def unpivot_patterns(df: DataFrame, ids: Sequence[str], items: Sequence[str], sums: dict[str, Column],
                     item_col: str = "item", value_col: str = "value") -> DataFrame:
    """``unpivot_items`` of rows summed by (ids, all items) first: ids, item, value and the named sums.

    Answers have few values, so a row stands for every respondent of one
    answer pattern and only patterns are multiplied by the number of items.
    """
    grid = df.groupBy(*ids, *items).agg(*[e.alias(name) for name, e in sums.items()])
    return unpivot_items(grid, [*ids, *sums], items, item_col, value_col)


def with_columns_of(df: DataFrame, side: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with ``columns`` of the ``side`` row of the same keys (NULL equals NULL; one row per key)."""
    side = side.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *columns)
    same = [df[k].eqNullSafe(side[f"__k{i}"]) for i, k in enumerate(keys)]
    return df.join(side, same, "inner").drop(*[f"__k{i}" for i in range(len(keys))])
