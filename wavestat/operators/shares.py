"""Weighted shares, percent tables, cross-tab counts and NULL rates.

Every operator is one partial+final aggregation on its group keys; shares of a
group total are window sums over the (already aggregated, result-sized) rows,
partitioned by the total's keys, never an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavestat.operators.reshape import unpivot_items, unpivot_patterns


def weighted_counts(df: DataFrame, keys: Sequence[str], weight: str = "weight",
                    out: str = "weighted_n") -> DataFrame:
    """Sum of weights by keys; an all-NULL weight group sums to 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias(out))


def share_within(df: DataFrame, value: str, partition: Sequence[str], out: str) -> DataFrame:
    """``value / sum(value)`` within ``partition`` (NULL when the total is 0)."""
    w = Window.partitionBy(*partition)
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(w)))


def weighted_share(df: DataFrame, items: Sequence[str], by: Sequence[str] = (),
                   weight: str = "weight", value_label=None, item_col: str = "item",
                   value_col: str = "value", share_col: str = "proportion") -> DataFrame:
    """Weighted share of each answer of each item, within (by..., item).

    ``value_label(col) -> Column`` turns the answer into its display label; by
    default the answer value itself is the group key.  Rows whose answer is
    NULL are left out.
    """
    long = unpivot_patterns(df, by, items, {weight: F.sum(weight)}, item_col, value_col)
    long = long.filter(F.col(value_col).isNotNull())
    if value_label is not None:
        long = (long.withColumn(value_col, value_label(F.col(value_col)))
                .filter(F.col(value_col).isNotNull()))
    agg = weighted_counts(long, [item_col, *by, value_col], weight)
    return share_within(agg, "weighted_n", [item_col, *by], share_col)


def percent_table(df: DataFrame, sections: Sequence[tuple[str, str, Sequence[str]]],
                  weight: str = "weight") -> DataFrame:
    """Unweighted and weighted percent of each level, for several variables.

    ``sections`` lists ``(section name, column, level order)``.  Rows are
    counted by all variables together in one scan; those counts are stacked and
    added up per variable.  Output: section, feature, n_unweighted, n_weighted,
    unweighted_pct, weighted_pct, section_order, level_order.
    """
    cols = [c for _, c, _ in sections]
    long = unpivot_patterns(df, [], cols, {"n": F.count(F.lit(1)), weight: F.sum(weight)}, "variable", "feature")
    long = long.filter(F.col("feature").isNotNull())
    section_of = F.create_map(*[x for s, c, _ in sections for x in (F.lit(c), F.lit(s))])
    agg = (long.groupBy("variable", "feature")
           .agg(F.sum("n").alias("n_unweighted"),
                F.coalesce(F.sum(weight), F.lit(0.0)).cast("double").alias("n_weighted")))
    w = Window.partitionBy("variable")
    order_pairs = []
    for si, (_, c, levels) in enumerate(sections):
        for li, lev in enumerate(levels):
            order_pairs += [F.lit(f"{c}\u0000{lev}"), F.lit(li)]
    level_order = F.create_map(*order_pairs)[F.concat_ws("\u0000", "variable", "feature")]
    section_order = F.create_map(*[x for si, (_, c, _) in enumerate(sections)
                                   for x in (F.lit(c), F.lit(si))])[F.col("variable")]
    return agg.select(
        section_of[F.col("variable")].alias("section"),
        F.col("feature"),
        F.col("n_unweighted"),
        F.col("n_weighted"),
        (F.lit(100.0) * F.col("n_unweighted") / F.sum("n_unweighted").over(w)).alias("unweighted_pct"),
        (F.lit(100.0) * F.try_divide(F.col("n_weighted"), F.sum("n_weighted").over(w)))
        .alias("weighted_pct"),
        section_order.alias("section_order"),
        level_order.alias("level_order"),
    )


def count_share(df: DataFrame, keys: Sequence[str], share_partition: Sequence[str],
                count_col: str = "n", share_col: str = "prop") -> DataFrame:
    """Row counts by keys and their share within ``share_partition``."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    w = Window.partitionBy(*share_partition)
    return agg.withColumn(share_col, F.col(count_col) / F.sum(count_col).over(w))


def null_rates(df: DataFrame, items: Sequence[str], by: Sequence[str],
               item_col: str = "item") -> DataFrame:
    """Rows, NULL count and NULL share of each item by keys.

    Aggregates before reshaping: one pass computes ``count(*)`` and
    ``count(item)`` per key group for all items, then the per-group result
    (groups x items rows) is unpivoted.
    """
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count(F.col(c)).alias(f"nn__{c}") for c in items]
    agg = df.groupBy(*by).agg(*aggs)
    long = unpivot_items(agg, [*by, "total"], [f"nn__{c}" for c in items], item_col, "non_null")
    long = long.withColumn(item_col, F.regexp_replace(item_col, "^nn__", ""))
    return long.select(
        *by, item_col, "total",
        (F.col("total") - F.col("non_null")).alias("na_count"),
        ((F.col("total") - F.col("non_null")) / F.col("total")).alias("na_prop"),
    )
