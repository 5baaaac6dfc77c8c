"""Batched survey-weighted GLMs (logit, linear) with design-based variance.

Plan
----
1. **Cells.**  Rows are compressed to cells ``(model keys, x...)`` carrying
   ``n`` and sums of ``w``, ``w^2``, ``w y``, ``w^2 y``, ``w^2 y^2`` (linear
   model: also ``w y^2``, of outcomes less the model's mean): score,
   information, deviance and sandwich are exact functions of those sums, so
   there are no more cells than covariate patterns, whatever the outcome.
   Several outcomes on the same predictors are summed side by side, one row per
   pattern, and unpivoted afterwards (``item_cells``).  Incomplete rows (any NULL
   outcome/predictor/weight) collapse into one cell per model; they count
   towards the design size n but not the fit.  This is the only pass over the
   rows; the cells are written once to the shared checkpoint folder and deleted
   when the fit is done.
2. **IRLS, all models at once.**  A state table has one row per model:
   coefficients, last step, status.  Each iteration joins it to the cells,
   aggregates the upper triangle of X'WX, the score X'W(y - mu) and the
   deviance per model, and solves the p x p systems where those rows are
   (``mapInArrow``).  The new state is written and reread; the driver learns
   only how many models are still active.
3. **Separation.**  In a separated model the Newton step keeps a length of about
   one along a direction that no cell opposes: cells with both answers do not
   move along it, cells with one answer move towards it.  Every pass measures
   how far the last step moves any cell and how far it moves one the wrong
   way, so such models stop early as ``separated``, without estimates.
4. **Variance.**  V = A^-1 B A^-1 with A = X'WX and B = n/(n-1) * meat, n the
   design rows (every row its own sampling unit, no strata).  With
   ``fallback=True`` models whose design cannot be built (a row without weight,
   fewer than two rows, no finite sandwich) get the plain weighted-GLM variance
   A^-1 and the status ``fallback``; one more pass over their cells alone pools
   the standard errors of their row-wise effects.
5. **Aliasing.**  Columns that are linear combinations of earlier columns
   (pivoting in column order on the scaled Gram matrix) get no estimate.

No per-model result reaches the driver: coefficients and effects are computed
from the state table by tasks.  The join is left to Spark, which broadcasts the
state while its files are small and shuffles it beyond.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavestat.functions import all_not_null
from wavestat.operators.reshape import with_columns_of
from wavestat.session import materialize_with_path, release

INTERCEPT = "(Intercept)"

OK = "ok"
NO_DATA = "no_data"
NOT_CONVERGED = "not_converged"
RANK_DEFICIENT = "rank_deficient"
SEPARATED = "separated"
FALLBACK = "fallback"

SEPARATION_FROM = 5      # first iteration whose step is tested for separation
SEPARATION_REACH = 0.5   # a step that still moves some linear predictor by this much
SEPARATION_SLACK = 1e-4  # ... and moves no cell the wrong way by more than this share of it


# ----------------------------------------------------------------------------
# t distribution (two-sided p-values for <= a few dozen terms, on the driver)
# ----------------------------------------------------------------------------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def reg_incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float | None:
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    if t is None or df is None or not np.isfinite(t) or df <= 0:
        return None
    return reg_incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


# ----------------------------------------------------------------------------
# Results
# ----------------------------------------------------------------------------

def _map_rows(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    """Rows of ``df`` (small: one per model) through ``make(dict) -> iterable of tuples``."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in make(row)]
            columns = list(zip(*rows)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


class GlmFit:
    """Fitted batch of models; results are DataFrames computed from its state table.

    ``state``: one row per model (keys, n_design, n_fit, iterations, status,
    deviance, coef, vcov, effect sums), read from the shared checkpoint folder.
    """

    def __init__(self, state: DataFrame, model_keys: list[str], terms: list[str], family: str,
                 difference_terms: Sequence[int]):
        self.state = state
        self.model_keys = model_keys
        self.terms = terms
        self.family = family
        self.difference_terms = list(difference_terms)

    def _schema(self, fields) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.state.schema[:len(self.model_keys)]]
                            + [T.StructField(n, t) for n, t in fields])

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """One row per (model, term): estimate, std_error, statistic, p_value,
        aliased, n_design, n_fit, df_resid, iterations, status."""
        keys, terms, p = self.model_keys, self.terms, len(self.terms)

        def rows(m):
            coef, vcov = m["coef"], m["vcov"]
            df_resid = m["n_fit"] - sum(b is not None for b in coef) if coef else None
            for j, term in enumerate(terms):
                est = se = stat = pval = None
                if coef and coef[j] is not None:
                    est = coef[j]
                    v = vcov[j * p + j]
                    if v is not None and v >= 0:
                        se = math.sqrt(v)
                        stat = est / se if se > 0 else None
                        pval = t_two_sided_p(stat, df_resid) if stat is not None else None
                yield (*[m[k] for k in keys], term, j, est, se, stat, pval, bool(coef) and coef[j] is None,
                       m["n_design"], m["n_fit"], df_resid, m["iterations"], m["status"])

        return _map_rows(self.state, self._schema([
            ("term", T.StringType()), ("term_index", T.IntegerType()), ("estimate", T.DoubleType()),
            ("std_error", T.DoubleType()), ("statistic", T.DoubleType()), ("p_value", T.DoubleType()),
            ("aliased", T.BooleanType()), ("n_design", T.LongType()), ("n_fit", T.LongType()),
            ("df_resid", T.LongType()), ("iterations", T.IntegerType()), ("status", T.StringType())]), rows)

    def marginal_effects(self, spark: SparkSession, terms: Sequence[str], kind: str = "derivative") -> DataFrame:
        """Average marginal effect on the response scale of numeric ``terms``.

        ``kind="derivative"``: averaged (unweighted) over the rows used by the
        fit, AME_j = beta_j mean(mu (1 - mu)) for the logit.
        ``kind="difference"`` (0/1 regressors; the terms must have been listed
        in ``fit_glm(difference_terms=...)``): mean of mu(x_j = 1) - mu(x_j = 0).
        The linear model gives beta_j either way.  Delta-method standard error
        with the fit's covariance; a ``fallback`` model's is the root mean
        square of the standard errors of its rows' effects (derivative form).
        """
        if kind not in ("derivative", "difference"):
            raise ValueError("kind must be 'derivative' or 'difference'")
        index = [self.terms.index(t) for t in terms]
        logit, p, keys = self.family == "binomial", len(self.terms), self.model_keys
        listed = self.difference_terms
        if logit and kind == "difference" and not set(index) <= set(listed):
            raise ValueError("every term must be listed in difference_terms")

        def rows(m):
            coef = m["coef"]
            v = np.array([np.nan if x is None else x for x in m["vcov"]]).reshape(p, p) if coef else None
            for j, term in zip(index, terms):
                est = se = None
                if coef and coef[j] is not None and m["n_fit"]:
                    n, kept = m["n_fit"], [i for i, b in enumerate(coef) if b is not None]
                    if logit and kind == "difference":
                        at = listed.index(j) * (p + 1)
                        est, g = m["diff"][at] / n, np.array(m["diff"][at + 1:at + 1 + p]) / n
                    elif logit:
                        s1 = m["ame_sum"] / n
                        est, g = coef[j] * s1, coef[j] * np.array(m["ame_grad"]) / n
                        g[j] += s1
                    else:
                        est, g = coef[j], np.eye(p)[j]
                    if logit and kind == "derivative" and m["status"] == FALLBACK:
                        var = m["pooled"][j] / n if m["pooled"] and m["pooled"][j] is not None else np.nan
                    else:
                        var = float(g[kept] @ v[np.ix_(kept, kept)] @ g[kept])
                    se = math.sqrt(var) if np.isfinite(var) and var >= 0 else None
                yield (*[m[k] for k in keys], term, est, se, m["n_design"], m["n_fit"], m["status"])

        return _map_rows(self.state, self._schema([
            ("term", T.StringType()), ("estimate", T.DoubleType()), ("std_error", T.DoubleType()),
            ("n_design", T.LongType()), ("n_fit", T.LongType()), ("status", T.StringType())]), rows)


# ----------------------------------------------------------------------------
# Cells and the per-iteration aggregate
# ----------------------------------------------------------------------------

#: Sums of a cell by name, over complete rows (w: weight, y: outcome).
CELL_SUMS = {"sw": "w", "sw2": "w * w", "swy": "w * y", "sw2y": "w * w * y", "sw2yy": "w * w * y * y"}


def glm_cells(df: DataFrame, model_keys: Sequence[str], outcome: str, predictors: Sequence[str],
              weight: str = "weight") -> DataFrame:
    """Compress design rows to cells (keys, complete, x_1..x_k) -> n,
    n_no_weight, sw, sw2, swy, sw2y, sw2yy, swyy.

    Incomplete rows (any NULL outcome, predictor or weight) form one cell per
    model with ``complete = false`` and NULL x and sums.
    """
    ok = all_not_null([outcome, *predictors, weight])
    base = df.select(*model_keys, ok.alias("complete"), F.col(weight).isNull().alias("no_weight"),
                     F.when(ok, F.col(outcome).cast("double")).alias("y"),
                     *[F.when(ok, F.col(c).cast("double")).alias(f"x{i + 1}") for i, c in enumerate(predictors)],
                     F.when(ok, F.col(weight).cast("double")).alias("w"))
    return base.groupBy(*model_keys, "complete", *[f"x{i + 1}" for i in range(len(predictors))]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("no_weight").alias("n_no_weight"),
        *[F.expr(f"sum({e}) AS {name}") for name, e in CELL_SUMS.items()], F.expr("sum(w * y * y) AS swyy"))


def item_cells(df: DataFrame, model_keys: Sequence[str], outcomes: Sequence[str], predictors: Sequence[str],
               weight: str = "weight", item_col: str = "item", keep_null_outcome: bool = True) -> DataFrame:
    """``glm_cells`` of several outcomes on the same predictors: one model per (keys, outcome).

    Every outcome is summed conditionally in one aggregation per covariate
    pattern; only those aggregated rows are unpivoted.  ``keep_null_outcome``:
    rows with a NULL outcome count in that outcome's design size.
    """
    xs = [f"x{i + 1}" for i in range(len(predictors))]
    base = df.select(*model_keys, *[F.col(c).cast("double").alias(x) for c, x in zip(predictors, xs)],
                     F.col(weight).cast("double").alias("w"),
                     *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(outcomes)])
    aggs = [F.count(F.lit(1)).alias("rows"), F.expr("count_if(w IS NULL) AS rows_no_weight")]
    for i in range(len(outcomes)):
        aggs += [F.expr(f"count(y{i}) AS n_{i}"), F.expr(f"count_if(y{i} IS NOT NULL AND w IS NULL) AS nw_{i}")]
        aggs += [F.expr(f"sum({e.replace('y', f'y{i}')}) AS {name}_{i}") for name, e in CELL_SUMS.items() if "y" in name]
        aggs += [F.expr(f"sum(CASE WHEN y{i} IS NOT NULL THEN {CELL_SUMS[name]} END) AS {name}_{i}") for name in ("sw", "sw2")]
    grid = base.groupBy(*model_keys, *xs).agg(*aggs).withColumn("whole", all_not_null(xs))
    parts = []
    for i, c in enumerate(outcomes):
        used = F.when(F.col("whole"), F.col(f"n_{i}") - F.col(f"nw_{i}")).otherwise(F.lit(0))
        all_rows = F.col("rows") if keep_null_outcome else F.col(f"n_{i}")
        no_weight = F.col("rows_no_weight") if keep_null_outcome else F.col(f"nw_{i}")
        for complete, n in ((True, used), (False, all_rows - used)):
            parts.append(F.struct(
                F.lit(c).alias(item_col), F.lit(complete).alias("complete"), n.alias("n"),
                (F.lit(0).cast("long") if complete else no_weight).alias("n_no_weight"),
                *[(F.col(f"{name}_{i}") if complete else F.lit(None).cast("double")).alias(name) for name in CELL_SUMS]))
    long = grid.select(*model_keys, *xs, F.explode(F.array(*parts)).alias("cell")).filter("cell.n > 0")
    long = long.select(*model_keys, f"cell.{item_col}", "cell.complete",
                       *[F.when(F.col("cell.complete"), F.col(x)).alias(x) for x in xs], "cell.n", "cell.n_no_weight",
                       *[f"cell.{name}" for name in CELL_SUMS])
    return long.groupBy(*model_keys, item_col, "complete", *xs).agg(
        F.sum("n").alias("n"), F.sum("n_no_weight").alias("n_no_weight"), *[F.sum(name).alias(name) for name in CELL_SUMS])


def _linear(prefix: str, p: int):
    eta = F.col(f"{prefix}0")
    for i in range(1, p):
        eta = eta + F.col(f"{prefix}{i}") * F.col(f"x{i}")
    return eta


def _pass_aggregate(cells: DataFrame, state: DataFrame, model_keys: list[str], p: int, family: str,
                    final: bool, diff_terms: Sequence[int] = ()) -> DataFrame:
    """One pass over the cells at the current coefficients, per model.

    Every pass: upper triangle of X'WX, score X'W(y - mu), deviance, and for
    the logit how far the last step moves a cell (``reach``) and one the wrong way
    (``wrong``).  The final pass has, for the score, the sandwich meat
    sum w^2 (y - mu)^2 x x' and the marginal-effect sums (derivative form; for
    ``diff_terms`` also mu(x_j = 1) - mu(x_j = 0) and its gradient).
    The sums come back beside their model's state columns.
    """
    one = F.lit(1.0)
    x = [one] + [F.col(f"x{i}") for i in range(1, p)]
    joined = with_columns_of(cells, state, model_keys, [f"{c}{i}" for c in ("bs" if family == "binomial" else "b") for i in range(p)])
    eta = _linear("b", p)
    n, sw, sw2 = F.col("n").cast("double"), F.col("sw"), F.col("sw2")
    swy, sw2y, sw2yy = F.col("swy"), F.col("sw2y"), F.col("sw2yy")
    if family == "binomial":
        mu = one / (one + F.exp(-eta))
        var_mu = mu * (one - mu)
        muc = F.least(F.greatest(mu, F.lit(1e-300)), F.lit(1.0 - 1e-16))
        dev = F.lit(-2.0) * (swy * F.log(muc) + (sw - swy) * F.log(one - muc))
    else:
        mu, var_mu = eta, one
        dev = F.col("swyy") - F.lit(2.0) * mu * swy + mu * mu * sw
    cols = [*model_keys, *[xi.alias(f"__x{i}") for i, xi in enumerate(x)], (sw * var_mu).alias("__wt"), dev.alias("__dev")]
    aggs = [F.expr("sum(__dev) AS dev")]
    if family == "binomial":
        move = _linear("s", p)
        cols += [F.when(sw > 0, F.abs(move)).alias("__reach"),
                 F.when(sw > 0, F.greatest(F.when(swy > 0, -move), F.when(swy < sw, move))).alias("__wrong")]
        aggs += [F.expr("max(__reach) AS reach"), F.expr("max(__wrong) AS wrong")]
    if final:
        resid_w2 = sw2yy - F.lit(2.0) * mu * sw2y + mu * mu * sw2  # sum w^2 (y - mu)^2
        cols += [resid_w2.alias("__m"), (n * var_mu).alias("__a1"),
                 (n * var_mu * (one - F.lit(2.0) * mu)).alias("__a2")]
        for j in diff_terms:
            bj, xj = F.col(f"b{j}"), x[j]
            mu1 = one / (one + F.exp(-(eta + bj * (one - xj))))
            mu0 = one / (one + F.exp(-(eta - bj * xj)))
            cols += [(n * (mu1 - mu0)).alias(f"__d{j}"), (n * mu1 * (one - mu1)).alias(f"__v1_{j}"),
                     (n * mu0 * (one - mu0)).alias(f"__v0_{j}")]
        aggs.append(F.expr("sum(__a1) AS a_sum"))
        for j in diff_terms:
            aggs.append(F.expr(f"sum(__d{j}) AS d{j}"))
            for k in range(p):
                term = f"__v1_{j}" if k == j else f"(__v1_{j} - __v0_{j}) * __x{k}"
                aggs.append(F.expr(f"sum({term}) AS d{j}_{k}"))
    else:
        cols.append((swy - sw * mu).alias("__r"))  # sum w (y - mu)
    # one SQL expression per sum: a single JVM round trip each
    for j in range(p):
        for k in range(j, p):
            aggs.append(F.expr(f"sum(__wt * __x{j} * __x{k}) AS g{j}_{k}"))
            if final:
                aggs.append(F.expr(f"sum(__m * __x{j} * __x{k}) AS m{j}_{k}"))
        aggs.append(F.expr(f"sum(__a2 * __x{j}) AS a{j}") if final else F.expr(f"sum(__r * __x{j}) AS r{j}"))
    sums = joined.select(*cols).groupBy(*model_keys).agg(*aggs)
    return with_columns_of(sums, state, model_keys, [c for c in state.columns if c not in model_keys])


def _sym(row, prefix: str, p: int) -> np.ndarray:
    out = np.empty((p, p))
    for j in range(p):
        for k in range(j, p):
            v = row[f"{prefix}{j}_{k}"]
            out[j, k] = out[k, j] = np.nan if v is None else v
    return out


def _alias_columns(gram: np.ndarray, tol: float) -> list[int]:
    """Columns kept by pivoting in order on the scaled Gram matrix."""
    d = np.sqrt(np.clip(np.diag(gram), 0, None))
    kept: list[int] = []
    for j in range(gram.shape[0]):
        if d[j] <= 0:
            continue
        gs = gram / np.outer(np.where(d > 0, d, 1), np.where(d > 0, d, 1))
        if not kept:
            kept.append(j)
            continue
        gkk = gs[np.ix_(kept, kept)]
        gkj = gs[kept, j]
        try:
            resid = gs[j, j] - gkj @ np.linalg.solve(gkk, gkj)
        except np.linalg.LinAlgError:
            continue
        if resid > tol:
            kept.append(j)
    return kept


def _solve_scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(a))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.solve(a / np.outer(d, d), b / d) / d


def _inv_scaled(a: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(a))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)


def _is_separated(sums) -> bool:
    reach = sums.get("reach") or 0.0
    return reach >= SEPARATION_REACH and (sums["wrong"] or 0.0) <= SEPARATION_SLACK * reach


def _advance(m: dict, p: int, family: str, tol: float, alias_tol: float) -> dict:
    """A model's next state from its sums at the current coefficients."""
    sums = m
    m = dict(m, iterations=m["iterations"] + 1)
    gram = _sym(sums, "g", p)
    if m["iterations"] == 1:
        kept = _alias_columns(gram, alias_tol)
        m["kept"] = [j in kept for j in range(p)]
    kept = [j for j in range(p) if m["kept"][j]]
    dev, last = sums["dev"], m["deviance"]
    m["deviance"] = dev
    if family == "binomial":
        if m["iterations"] > SEPARATION_FROM and _is_separated(sums):
            return dict(m, active=False, status=SEPARATED)
        if last is not None and abs(dev - last) / (abs(dev) + 0.1) < tol:
            m.update(active=False, status=OK if len(kept) == p else RANK_DEFICIENT)  # and takes this step, too
    try:
        step = _solve_scaled(gram[np.ix_(kept, kept)], np.array([sums[f"r{j}"] for j in kept], dtype=float))
    except np.linalg.LinAlgError:
        return dict(m, active=False)
    for j in range(p):
        m[f"s{j}"] = 0.0
    for j, value in zip(kept, step.tolist()):
        m[f"s{j}"] = value
        m[f"b{j}"] += value
    if family == "gaussian":  # one weighted least-squares solve is exact
        m.update(active=False, status=OK if len(kept) == p else RANK_DEFICIENT)
    return m


def _finish(m: dict, p: int, family: str, variance: str, fallback: bool, diff_terms: Sequence[int]) -> dict:
    """A model's results from the final pass."""
    sums = m
    out = dict(m, coef=None, vcov=None, ame_sum=None, ame_grad=None, diff=None)
    if not m["iterations"]:
        return out
    if family == "binomial" and (m["status"] == SEPARATED or _is_separated(sums)):
        return dict(out, status=SEPARATED)
    kept = [j for j in range(p) if m["kept"][j]]
    at = np.ix_(kept, kept)
    try:
        ainv = _inv_scaled(_sym(sums, "g", p)[at])
    except np.linalg.LinAlgError:
        ainv = np.full((len(kept), len(kept)), np.nan)
    dfr = m["n_fit"] - len(kept)
    plain = ainv if family == "binomial" else ainv * (sums["dev"] / dfr if dfr > 0 else np.nan)
    nd = m["n_design"]
    v = plain
    if variance == "sandwich":
        v = ainv @ ((nd / (nd - 1.0) if nd > 1 else np.nan) * _sym(sums, "m", p)[at]) @ ainv
        if fallback and (m["n_no_weight"] or not np.isfinite(v).all()):
            v = plain
            out["status"] = FALLBACK
    full = np.full((p, p), np.nan)
    full[at] = v
    shift = m["shift"] or 0.0
    out["coef"] = [(m[f"b{j}"] + (shift if j == 0 else 0.0)) if m["kept"][j] else None for j in range(p)]
    out["vcov"] = [x if math.isfinite(x) else None for x in full.ravel().tolist()]
    out["deviance"] = sums["dev"]
    out["ame_sum"] = sums["a_sum"]
    out["ame_grad"] = [sums[f"a{j}"] for j in range(p)]
    out["diff"] = [x for j in diff_terms for x in (sums[f"d{j}"], *[sums[f"d{j}_{k}"] for k in range(p)])]
    return out


def _pooled(cells: DataFrame, state: DataFrame, keys: list[str], p: int) -> DataFrame:
    """State rows of the fallback models with ``pooled``: sums over their rows of each effect's squared standard error.

    Row effect of term j: beta_j v, v = mu (1 - mu), with gradient
    v e_j + beta_j v (1 - 2 mu) x, so the square is
    v^2 V_jj + 2 v beta_j v (1 - 2 mu) (V x)_j + (beta_j v (1 - 2 mu))^2 x'V x.
    """
    failed = state.filter(F.col("status") == F.lit(FALLBACK))
    held = [c for c in state.columns if c not in keys]
    x = [F.lit(1.0)] + [F.col(f"x{i}") for i in range(1, p)]
    rows = with_columns_of(cells, failed, keys, held)
    entry = [[F.coalesce(F.col("vcov")[j * p + k], F.lit(0.0)) for k in range(p)] for j in range(p)]
    b = [F.coalesce(F.col("coef")[j], F.lit(0.0)) for j in range(p)]

    def total(parts):
        out = parts[0]
        for part in parts[1:]:
            out = out + part
        return out

    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-total([b[j] * x[j] for j in range(p)])))
    staged = rows.select(*keys, "n", *held, *[c.alias(f"__x{i}") for i, c in enumerate(x)], mu.alias("mu"),
                         *[total([entry[j][k] * x[k] for k in range(p)]).alias(f"vx{j}") for j in range(p)])
    v = F.col("mu") * (F.lit(1.0) - F.col("mu"))
    slope = v * (F.lit(1.0) - F.lit(2.0) * F.col("mu"))
    xvx = total([F.col(f"vx{j}") * F.col(f"__x{j}") for j in range(p)])
    squares = [F.sum(F.when(F.col("coef")[j].isNotNull(), F.col("n") * (
        v * v * entry[j][j] + F.lit(2.0) * v * b[j] * slope * F.col(f"vx{j}") + b[j] * slope * b[j] * slope * xvx)))
        for j in range(p)]
    return staged.groupBy(*keys, *held).agg(F.array(*squares).alias("pooled"))


def fit_glm(df: DataFrame, model_keys: Sequence[str], outcome: str, predictors: Sequence[str],
            weight: str = "weight", family: str = "binomial", **options) -> GlmFit:
    """Fit one weighted GLM per model-key group, all groups in the same jobs.

    ``df`` holds the design rows of every model (long form: one row per model
    and respondent).  Rows with a NULL outcome, predictor or weight are left
    out of the fit but count in the design size used by the variance.
    ``family``: ``"binomial"`` (logit link) or ``"gaussian"`` (identity).
    ``options``: see ``fit_cells``.
    """
    keys = list(model_keys)
    if family != "gaussian":
        return fit_cells(glm_cells(df, keys, outcome, predictors, weight), keys, predictors, family, **options)
    # sums of squares about the model's mean, not about zero
    means = df.groupBy(*keys).agg(F.avg(F.col(outcome).cast("double")).alias("shift"))
    centred = with_columns_of(df.select(*keys, weight, outcome, *predictors), means, keys, ["shift"])
    centred = centred.withColumn(outcome, F.col(outcome).cast("double") - F.col("shift"))
    return fit_cells(glm_cells(centred, keys, outcome, predictors, weight), keys, predictors, family,
                     shift=means, **options)


def fit_glm_items(df: DataFrame, model_keys: Sequence[str], outcomes: Sequence[str], predictors: Sequence[str],
                  weight: str = "weight", item_col: str = "item", keep_null_outcome: bool = True, **options) -> GlmFit:
    """Logit of every outcome column on the same predictors, per model-key group (see ``item_cells``)."""
    cells = item_cells(df, model_keys, outcomes, predictors, weight, item_col, keep_null_outcome)
    return fit_cells(cells, [*model_keys, item_col], predictors, "binomial", **options)


def fit_cells(cells: DataFrame, model_keys: Sequence[str], predictors: Sequence[str], family: str = "binomial",
              max_iter: int = 25, tol: float = 1e-8, alias_tol: float = 1e-9, variance: str = "sandwich",
              difference_terms: Sequence[str] = (), fallback: bool = False, shift: DataFrame | None = None) -> GlmFit:
    """Fit the models of a cell table.

    ``difference_terms``: 0/1 predictors whose discrete-change marginal
    effect ``GlmFit.marginal_effects(kind="difference")`` will report.
    ``variance``: ``"sandwich"`` (design-based, every row its own sampling
    unit) or ``"model"`` (weights as frequency weights: (X'WX)^-1, times the
    residual variance for the linear model).  ``fallback``: the latter for
    models whose design-based variance cannot be had.  ``shift``: what was taken
    off the outcome per model.
    """
    if family not in ("binomial", "gaussian"):
        raise ValueError("family must be 'binomial' or 'gaussian'")
    if variance not in ("sandwich", "model"):
        raise ValueError("variance must be 'sandwich' or 'model'")
    spark = cells.sparkSession
    keys, terms = list(model_keys), [INTERCEPT, *predictors]
    p = len(terms)
    diff_idx = [terms.index(t) for t in difference_terms] if family == "binomial" else []
    key_fields = [T.StructField(k, cells.schema[k].dataType, True) for k in keys]
    fixed = [T.StructField(n, t) for n, t in (
        ("n_design", T.LongType()), ("n_fit", T.LongType()), ("n_no_weight", T.LongType()), ("shift", T.DoubleType()),
        ("active", T.BooleanType()), ("status", T.StringType()), ("iterations", T.IntegerType()),
        ("deviance", T.DoubleType()), ("kept", T.ArrayType(T.BooleanType())))]
    numbers = [T.StructField(f"{c}{i}", T.DoubleType()) for c in "bs" for i in range(p)]
    schema = T.StructType(key_fields + fixed + numbers)
    array = T.ArrayType(T.DoubleType())
    results = T.StructType(key_fields + fixed[:4] + fixed[5:8] + [
        T.StructField("coef", array), T.StructField("vcov", array), T.StructField("ame_sum", T.DoubleType()),
        T.StructField("ame_grad", array), T.StructField("diff", array)])

    cells, cells_path = materialize_with_path(cells, "glm-cells")
    paths = [cells_path]
    # the passes re-read these cells: keep them in memory (a lost block is
    # re-read from the written cell files, not recomputed from the raw data)
    fit_rows = cells.filter(F.col("complete")).drop("complete", "n_no_weight").persist()
    try:
        sizes = cells.groupBy(*keys).agg(
            F.sum("n").alias("n_design"), F.coalesce(F.sum(F.when(F.col("complete"), F.col("n"))), F.lit(0)).alias("n_fit"),
            F.sum("n_no_weight").alias("n_no_weight"))
        if shift is None:
            sizes = sizes.withColumn("shift", F.lit(None).cast("double"))
        else:
            sizes = with_columns_of(sizes, shift, keys, ["shift"])
        start = sizes.select(
            *keys, "n_design", "n_fit", "n_no_weight", "shift", (F.col("n_fit") > 0).alias("active"),
            F.when(F.col("n_fit") > 0, F.lit(NOT_CONVERGED)).otherwise(F.lit(NO_DATA)).alias("status"),
            F.lit(0).alias("iterations"), F.lit(None).cast("double").alias("deviance"),
            F.lit(None).cast(T.ArrayType(T.BooleanType())).alias("kept"),
            *[F.lit(0.0).alias(f.name) for f in numbers])
        state, active = _written(start, paths)
        names = schema.fieldNames()
        for _ in range(max_iter):
            if not active:
                break
            sums = _pass_aggregate(fit_rows, state.filter("active"), keys, p, family, final=False)
            moved = _map_rows(sums, schema, lambda m: [tuple(map(_advance(m, p, family, tol, alias_tol).__getitem__, names))])
            state, active = _written(moved.unionByName(state.filter("NOT active")), paths)
        sums = _pass_aggregate(fit_rows, state.filter("iterations > 0"), keys, p, family, final=True, diff_terms=diff_idx)
        found = results.fieldNames()
        fitted = _map_rows(sums, results, lambda m: [tuple(
            map(_finish(m, p, family, variance, fallback, diff_idx).__getitem__, found))])
        empty = _map_rows(state.filter("iterations = 0"), results, lambda m: [tuple(
            map(_finish(m, p, family, variance, fallback, diff_idx).__getitem__, found))])
        state, failed = _written(fitted.unionByName(empty), paths, F.col("status") == F.lit(FALLBACK))
        if failed and family == "binomial":
            others = state.filter(F.col("status") != F.lit(FALLBACK)).withColumn("pooled", F.lit(None).cast(array))
            state, _ = _written(_pooled(fit_rows, state, keys, p).unionByName(others), paths)
        else:
            state = state.withColumn("pooled", F.lit(None).cast(array))
        paths.pop()  # the last state table stays: results are read from it
    finally:
        fit_rows.unpersist()
        for path in paths:
            release(spark, path)
    return GlmFit(state, keys, terms, family, diff_idx)


def _written(state: DataFrame, paths: list[str], counted=None) -> tuple[DataFrame, int]:
    """Write and reread a state table; with it the number of its active (``counted``) models."""
    seen = Observation()
    watched = state.observe(seen, F.count_if(F.col("active") if counted is None else counted).alias("n")) \
        if counted is not None or "active" in state.columns else state
    out, path = materialize_with_path(watched, "glm-state")
    paths.append(path)
    return out, (seen.get["n"] if watched is not state else 0)
