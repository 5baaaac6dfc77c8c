"""Design-weighted domain means with linearised standard errors.

Design: every row is its own sampling unit, no strata, no finite-population
correction, weights = inverse inclusion probabilities.  For domain d of a
design group with n rows (NULL-outcome rows included: out-of-domain and
missing rows contribute zero), with W = sum_d w and m = sum_d w*y / W:

    u_i = w_i (y_i - m) / W,    Var(m) = n / (n - 1) * sum_d u_i^2

The first pass sums counts, weights and weighted outcomes of every outcome
side by side per (group keys, domain); the second reads the rows again beside
their domain's means and sums (w (y - m))^2, so nothing cancels however large
the mean.  Only those aggregated rows are unpivoted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavestat.operators.reshape import with_columns_of


def domain_mean(df: DataFrame, outcomes: Sequence[str], domain: str, design_keys: Sequence[str],
                weight: str = "weight", exclude: Column | None = None,
                item_col: str = "item") -> DataFrame:
    """Weighted mean and SE of each outcome by (design_keys..., domain).

    ``df`` holds the design rows of every design group (e.g. one survey year's
    respondents).  ``exclude`` (a predicate on design keys and ``item_col``)
    drops whole (group, outcome) pairs, e.g. items not asked in a year.
    Domains without any non-NULL outcome are not reported.
    Output: design keys, item, domain, mean, std_error, n (design rows),
    n_obs (non-NULL outcome rows in the domain), sum_w.
    """
    keys = list(design_keys)
    cell = [*keys, domain]
    index = range(len(outcomes))
    base = df.select(*cell, F.col(weight).cast("double").alias("w"),
                     *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(outcomes)])
    first = base.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.expr(e.format(i=i)) for i in index for e in (
            "count(y{i}) AS n_obs{i}", "sum(CASE WHEN y{i} IS NOT NULL THEN w END) AS sum_w{i}", "sum(w * y{i}) AS s_wy{i}")])
    means = first.select(*cell, "n_rows", *[c for i in index for c in (
        F.col(f"n_obs{i}"), F.col(f"sum_w{i}"), F.try_divide(f"s_wy{i}", f"sum_w{i}").alias(f"m{i}"))])
    held = [c for c in means.columns if c not in cell]
    # a cell's first-pass figures are the same on all its rows
    second = with_columns_of(base, means, cell, held).groupBy(*cell).agg(
        *[F.max(c).alias(c) for c in held],
        *[F.expr(f"sum((w * (y{i} - m{i})) * (w * (y{i} - m{i}))) AS ss{i}") for i in index])
    parts = F.array(*[F.struct(
        F.lit(c).alias(item_col), F.col(f"m{i}").alias("mean"), F.col(f"ss{i}").alias("ss"),
        F.col(f"n_obs{i}").alias("n_obs"), F.col(f"sum_w{i}").alias("sum_w")) for i, c in enumerate(outcomes)])
    long = second.select(*cell, "n_rows", F.explode(parts).alias("c")).select(*cell, "n_rows", "c.*")
    if exclude is not None:
        long = long.filter(~exclude)
    n = F.sum("n_rows").over(Window.partitionBy(*keys, item_col))
    var = F.try_divide(F.try_divide(n, n - F.lit(1)) * F.col("ss"), F.col("sum_w") * F.col("sum_w"))
    out = long.select(*keys, item_col, domain, "mean", F.sqrt(var).alias("std_error"), n.alias("n"), "n_obs", "sum_w")
    return out.filter(F.col("n_obs") > 0)
