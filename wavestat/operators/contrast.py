"""Survey-weighted logit on a single 0/1 predictor, in closed form.

With one binary regressor the logit is saturated: the fitted probability in
group g is the weighted mean p_g, the slope is logit p_1 - logit p_0, and the
design-based (sandwich) variance of each group logit is

    Var(logit p_g) = n/(n-1) * sum_g w^2 (y - p_g)^2 / (sum_g w * p_g (1 - p_g))^2

with n the design rows; the two group logits are uncorrelated.  The average
marginal effect on the response scale (derivative form, averaged without
weights over the rows used) is AME = beta * m, m = (n_0 v_0 + n_1 v_1) / n,
v_g = p_g (1 - p_g); its delta-method gradient with respect to the group
logits is (-m + beta n_0/n v_0 (1 - 2 p_0), m + beta n_1/n v_1 (1 - 2 p_1)).

All of it is one aggregation by (model keys, flag), the outcomes summed side
by side, and column arithmetic on the aggregated rows, so every (year,
outcome) model is fitted in the same job.

A model with a row without weight has no design.  It gets the plain weighted
logit of the rows with a weight instead, Var(logit p_g) = 1 / (sum_g w v_g);
the standard error pools those of the rows' own effects beta v_g (root mean
square), the estimate is their mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK = "ok"
SMALL_CELL = "small_cell"
NO_VARIATION = "no_variation"
SEPARATED = "separated"
FALLBACK = "fallback"


def _logit(p):
    return F.log(F.try_divide(p, F.lit(1.0) - p))


def _flag_sums(df: DataFrame, outcomes: Sequence[str], flag: str, by: list[str], weight: str, item_col: str) -> DataFrame:
    """Per (by, outcome): row counts and weight sums of the flag's two levels."""
    base = df.filter(F.col(flag).isNotNull()).select(
        *by, F.col(flag).cast("double").alias("__g"), F.col(weight).cast("double").alias("w"),
        *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(outcomes)])
    sums = {"n": "count({y})", "nw": "count_if({y} IS NOT NULL AND w IS NOT NULL)",
            "sw": "sum(CASE WHEN {y} IS NOT NULL THEN w END)", "swy": "sum(w * {y})",
            "sw2": "sum(CASE WHEN {y} IS NOT NULL THEN w * w END)", "sw2y": "sum(w * w * {y})",
            "sw2yy": "sum(w * w * {y} * {y})"}
    grid = base.groupBy(*by, "__g").agg(*[F.expr(f"{e.format(y=f'y{i}')} AS {name}_{i}")
                                          for i in range(len(outcomes)) for name, e in sums.items()])
    cells = F.array(*[F.struct(F.lit(c).alias(item_col), *[F.col(f"{name}_{i}").alias(name) for name in sums])
                      for i, c in enumerate(outcomes)])
    long = grid.select(*by, "__g", F.explode(cells).alias("c")).filter("c.n > 0").select(*by, "__g", "c.*")
    level = [F.when(F.col("__g") == F.lit(float(g)), F.col(name)) for g in (0, 1) for name in sums]
    names = [f"{name}{g}" for g in (0, 1) for name in sums]
    return long.groupBy(*by, item_col).agg(*[
        (F.coalesce(F.sum(e), F.lit(0)) if name[:-1] in ("n", "nw") else F.sum(e)).alias(name)
        for e, name in zip(level, names)])


def binary_contrast(df: DataFrame, outcomes: Sequence[str], flag: str, by: Sequence[str] = ("year",),
                    weight: str = "weight", item_col: str = "item", min_cell: int = 5,
                    keep_no_variation: bool = False) -> DataFrame:
    """Logit slope and average marginal effect of a 0/1 ``flag`` per (by, outcome).

    Model rows are those with a non-NULL outcome; the flag must be non-NULL
    (a NULL flag row is left out of both the fit and n).  Models whose flag
    has one level are dropped (``keep_no_variation`` keeps them with status
    ``no_variation``).  Status ``small_cell`` marks a level with fewer than
    ``min_cell`` rows (estimates kept); ``separated`` marks a group share of
    exactly 0 or 1 (no finite estimate); ``fallback`` a model with a row
    without weight (plain weighted-GLM variance, pooled; n counts its weighted
    rows).
    Output: by..., item, term, estimate (AME), std_error, beta, beta_se,
    p0, p1, n, n0, n1, status.
    """
    by = list(by)
    agg = _flag_sums(df, outcomes, flag, by, weight, item_col)
    one, two = F.lit(1.0), F.lit(2.0)
    unweighted = (F.col("nw0") < F.col("n0")) | (F.col("nw1") < F.col("n1"))
    n0, n1 = F.col("nw0").cast("double"), F.col("nw1").cast("double")
    n = n0 + n1
    p = {k: F.try_divide(F.col(f"swy{k}"), F.col(f"sw{k}")) for k in (0, 1)}
    v = {k: p[k] * (one - p[k]) for k in (0, 1)}
    ss = {k: F.col(f"sw2yy{k}") - two * p[k] * F.col(f"sw2y{k}") + p[k] * p[k] * F.col(f"sw2{k}") for k in (0, 1)}
    design = {k: F.try_divide(F.try_divide(n, n - one) * F.greatest(ss[k], F.lit(0.0)),
                              (F.col(f"sw{k}") * v[k]) * (F.col(f"sw{k}") * v[k])) for k in (0, 1)}
    plain = {k: F.try_divide(one, F.col(f"sw{k}") * v[k]) for k in (0, 1)}
    var_eta = {k: F.when(unweighted, plain[k]).otherwise(design[k]) for k in (0, 1)}
    beta = _logit(p[1]) - _logit(p[0])
    m = F.try_divide(n0 * v[0] + n1 * v[1], n)
    skew = {k: beta * v[k] * (one - two * p[k]) for k in (0, 1)}
    d0 = -m + F.try_divide(n0, n) * skew[0]
    d1 = m + F.try_divide(n1, n) * skew[1]
    # squared standard error of a row's own effect in either group
    row0 = (skew[0] - v[0]) * (skew[0] - v[0]) * var_eta[0] + v[0] * v[0] * var_eta[1]
    row1 = v[1] * v[1] * var_eta[0] + (skew[1] + v[1]) * (skew[1] + v[1]) * var_eta[1]
    variance = F.when(unweighted, F.try_divide(n0 * row0 + n1 * row1, n)).otherwise(d0 * d0 * var_eta[0] + d1 * d1 * var_eta[1])

    varied = (n0 > 0) & (n1 > 0)
    separated = (v[0] == F.lit(0.0)) | (v[1] == F.lit(0.0))
    status = (F.when(~varied, F.lit(NO_VARIATION))
              .when(separated, F.lit(SEPARATED))
              .when(unweighted, F.lit(FALLBACK))
              .when(F.least(n0, n1) < F.lit(min_cell), F.lit(SMALL_CELL))
              .otherwise(F.lit(OK)))
    fine = varied & ~separated

    out = agg.select(
        *by, item_col,
        F.lit(flag).alias("term"),
        F.when(fine, beta * m).alias("estimate"),
        F.when(fine, F.sqrt(variance)).alias("std_error"),
        F.when(fine, beta).alias("beta"),
        F.when(fine, F.sqrt(var_eta[0] + var_eta[1])).alias("beta_se"),
        F.when(n0 > 0, p[0]).alias("p0"),
        F.when(n1 > 0, p[1]).alias("p1"),
        n.cast("long").alias("n"),
        n0.cast("long").alias("n0"),
        n1.cast("long").alias("n1"),
        status.alias("status"),
    )
    if not keep_no_variation:
        out = out.filter(F.col("status") != F.lit(NO_VARIATION))
    return out


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per key group (slope, intercept, n)."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"),
                                 F.regr_intercept(y, x).alias("intercept"),
                                 F.regr_count(y, x).alias("n_points"))
