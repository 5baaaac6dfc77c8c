"""Statuses of the batched models: separation, fallback, many models, large means."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavestat.operators.contrast import binary_contrast
from wavestat.operators.glm import fit_glm, fit_glm_items, glm_cells, item_cells


def _frame(spark, x, y, w=None, key="k"):
    """One model: predictors x (rows x p), outcome y, weight w (None entries are NULL)."""
    w = np.ones(len(y)) if w is None else w
    rows = [(key, *[float(v) for v in x[i]], float(y[i]), None if w[i] is None else float(w[i])) for i in range(len(y))]
    names = ", ".join(f"x{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"key string, {names}, y double, weight double")


def test_separated_group_as_in_closed_form(spark):
    g = np.array([1.0] * 25 + [0.0] * 25)[:, None]
    y = np.array([1.0] * 25 + [1.0] * 10 + [0.0] * 15)
    df = _frame(spark, g, y)
    fit = fit_glm(df, ["key"], "y", ["x0"])
    effect = fit.marginal_effects(spark, ["x0"]).first()
    closed = binary_contrast(df, ["y"], "x0", by=["key"]).first()
    assert effect.status == closed.status == "separated"
    assert (effect.estimate, effect.std_error, closed.estimate, closed.std_error) == (None,) * 4
    assert all(r.estimate is None and r.status == "separated" for r in fit.coefficients(spark).collect())


def _models(rng):
    """name -> (x, y, separated): complete, quasi-complete, all one answer, and hard models that are not separated."""
    n = 400
    line = rng.normal(size=n)
    two = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    noisy = (rng.random(n) < 1 / (1 + np.exp(-(two[:, 0] - 0.5)))).astype(float)
    both = noisy.copy()
    both[(two == 1).all(1)] = 1.0  # one corner of four has one answer: three parameters, not separated
    corner = noisy.copy()
    corner[two[:, 1] == 1] = 0.0
    rare = np.zeros(n)
    rare[:2] = 1
    steep = (rng.random(n) < 1 / (1 + np.exp(-9 * line))).astype(float)
    touch = (line > 0).astype(float)
    near = np.abs(line)
    touch[[np.argmin(np.where(line > 0, near, 9)), np.argmin(np.where(line < 0, near, 9))]] = 0, 1  # one pair overlaps
    lone = np.zeros((n, 1))
    lone[7] = 1
    return {"complete": (line[:, None], (line > 0.1).astype(float), True), "corner": (two, corner, True),
            "constant": (line[:, None], np.ones(n), True), "lone": (lone, noisy, True), "both": (two, both, False),
            "rare": (two[:, :1] * 0 + line[:, None], rare, None), "steep": (line[:, None], steep, False),
            "touch": (line[:, None], touch, False), "plain": (two, noisy, False)}


@pytest.mark.parametrize("name", ["complete", "corner", "constant", "lone", "both", "steep", "touch", "plain"])
def test_separation_is_found_and_only_it(spark, name):
    x, y, separated = _models(np.random.default_rng(4))[name]
    rows = fit_glm(_frame(spark, x, y), ["key"], "y", [f"x{j}" for j in range(x.shape[1])]).coefficients(spark).collect()
    assert {r.status for r in rows} == {"separated" if separated else "ok"}
    assert all((r.estimate is None) == separated for r in rows)


def test_separated_models_beside_others(spark):
    models = _models(np.random.default_rng(4))
    long = None
    for name, (x, y, _) in models.items():
        if x.shape[1] == 1:
            part = _frame(spark, x, y, key=name)
            long = part if long is None else long.unionByName(part)
    got = {r.key: r.status for r in fit_glm(long, ["key"], "y", ["x0"]).marginal_effects(spark, ["x0"]).collect()}
    assert got["complete"] == got["constant"] == got["lone"] == "separated" and got["steep"] == got["touch"] == "ok"


def _weighted_glm(x, y, w):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        a = x.T @ (x * (w * mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(a, x.T @ (w * (y - mu)))
    return beta, np.linalg.inv(a), 1 / (1 + np.exp(-x @ beta))


def test_fallback_has_plain_variance_and_pooled_effects(spark):
    rng = np.random.default_rng(8)
    n = 300
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 3, n)]).astype(float)
    y = (rng.random(n) < 0.3 + 0.2 * x[:, 0]).astype(float)
    w = rng.uniform(0.5, 2, n)
    missing = w.astype(object)
    missing[[3, 50]] = None
    df = _frame(spark, x, y, missing).unionByName(_frame(spark, x, y, w, key="whole"))
    fit = fit_glm(df, ["key"], "y", ["x0", "x1"], fallback=True)
    status = {r.key: r.status for r in fit.state.collect()}
    assert status == {"k": "fallback", "whole": "ok"}
    use = np.array([v is not None for v in missing])
    design = np.column_stack([np.ones(use.sum()), x[use]])
    beta, v, mu = _weighted_glm(design, y[use], w[use])
    coefs = [r for r in fit.coefficients(spark).collect() if r.key == "k"]
    assert np.allclose([r.estimate for r in coefs], beta) and np.allclose([r.std_error for r in coefs], np.sqrt(np.diag(v)))
    effects = {r.term: r for r in fit.marginal_effects(spark, ["x0", "x1"]).collect() if r.key == "k"}
    for j, term in ((1, "x0"), (2, "x1")):
        s = mu * (1 - mu)
        rows = design * (beta[j] * s * (1 - 2 * mu))[:, None]
        rows[:, j] += s
        errors = np.sqrt(np.einsum("ij,jk,ik->i", rows, v, rows))
        assert math.isclose(effects[term].estimate, (beta[j] * s).mean(), rel_tol=1e-7)
        assert math.isclose(effects[term].std_error, math.sqrt((errors ** 2).mean()), rel_tol=1e-7)
    # the closed form gives the same for one flag
    one = fit_glm(df, ["key"], "y", ["x0"], fallback=True).marginal_effects(spark, ["x0"])
    engine = {r.key: r for r in one.collect()}
    closed = {r.key: r for r in binary_contrast(df, ["y"], "x0", by=["key"]).collect()}
    for key in ("k", "whole"):
        assert engine[key].status == closed[key].status == status[key]
        assert math.isclose(engine[key].estimate, closed[key].estimate, rel_tol=1e-6)
        assert math.isclose(engine[key].std_error, closed[key].std_error, rel_tol=1e-6)
    assert closed["k"].n == use.sum()


def test_party_effects_fall_back_without_a_weight(spark):
    from wavestat.operators.design import flag_table
    from wavestat.plans import estimates as X
    rng = np.random.default_rng(1)
    rows = [(2020, "A" if rng.random() < 0.4 else "B", ["REPUBLICAN", "DEMOCRAT", "INDEPENDENT"][i % 3],
             None if i == 5 else 1.0 + (i % 4), *[float(rng.random() < 0.4) for _ in range(2)]) for i in range(400)]
    rows = [(*r, r[4] if i != 5 else None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "year int, state string, party string, weight double, a double, b double, c double")
    got = {(r.item, r.term): r for r in X.party_effects(df, flag_table(spark, {2020: ["A"]}), items=["a", "b", "c"], labels={c: c for c in "abc"}).collect()}
    assert {k[0]: r.status for k, r in got.items()} == {"a": "fallback", "b": "fallback", "c": "ok"}  # c has no answer in that row
    assert all(r.std_error > 0 for r in got.values())


def test_item_cells_equal_long_cells(spark):
    rng = np.random.default_rng(2)

    def some(value, share=0.15):
        return None if rng.random() < share else float(value)

    rows = [(int(i % 2), some(rng.integers(0, 2)), some(rng.integers(0, 3)), some(rng.uniform(1, 2)),
             some(rng.integers(0, 2)), some(rng.integers(0, 2), 0.5)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, u double, v double, weight double, p double, q double")
    long = df.unpivot(["k", "u", "v", "weight"], ["p", "q"], "item", "y")
    for keep in (True, False):
        want = glm_cells(long if keep else long.filter("y IS NOT NULL"), ["k", "item"], "y", ["u", "v"]).drop("swyy")
        got = item_cells(df, ["k"], ["p", "q"], ["u", "v"], keep_null_outcome=keep).select(*want.columns)
        names = [F.round(c, 9).alias(c) if c[0] == "s" else c for c in want.columns]
        assert sorted(map(str, want.select(names).collect())) == sorted(map(str, got.select(names).collect()))


def test_five_thousand_models_without_driver_results(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from wavestat.operators import glm
    df = spark.range(0, 5000 * 24).select(
        F.expr("id % 5000").alias("m"), F.expr("cast(id div 5000 % 2 as double)").alias("g"),
        F.expr("cast(pmod(xxhash64(id), 3) = 0 as double)").alias("y"), F.lit(1.0).alias("weight"))
    collected = []
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(self))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: collected.append(self))
    fit = fit_glm(df, ["m"], "y", ["g"])
    assert not collected  # what the driver learns are counts of active models
    monkeypatch.undo()
    assert not hasattr(glm, "MAX_MODELS")
    status = {r.status: r["count"] for r in fit.state.groupBy("status").count().collect()}
    assert sum(status.values()) == 5000 and set(status) <= {"ok", "separated"}
    closed = binary_contrast(df, ["y"], "g", by=["m"], min_cell=0)
    both = closed.alias("c").join(fit.marginal_effects(spark, ["g"]).alias("e"), "m")
    bad = both.filter("c.status != e.status OR abs(c.estimate - e.estimate) > 1e-6 OR abs(c.std_error - e.std_error) > 1e-5")
    assert both.count() == 5000 and bad.count() == 0


def test_linear_model_far_from_zero_and_by_pattern(spark):
    rng = np.random.default_rng(6)
    n = 2000
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 3, n)]).astype(float)
    y = 1e6 + 0.5 * x[:, 0] - 0.25 * x[:, 1] + rng.normal(size=n)
    w = rng.uniform(0.5, 2, n)
    df = _frame(spark, x, y, w)
    assert glm_cells(df, ["key"], "y", ["x0", "x1"]).count() == 6  # covariate patterns, not outcomes
    rows = fit_glm(df, ["key"], "y", ["x0", "x1"], family="gaussian").coefficients(spark).collect()
    design = np.column_stack([np.ones(n), x])
    a = design.T @ (design * w[:, None])
    beta = np.linalg.solve(a, design.T @ (w * (y - 1e6)))
    u = design * (w * (y - 1e6 - design @ beta))[:, None]
    v = np.linalg.inv(a) @ (n / (n - 1) * u.T @ u) @ np.linalg.inv(a)
    assert np.allclose([r.estimate for r in rows], beta + np.array([1e6, 0, 0]), rtol=1e-12, atol=1e-8)
    assert np.allclose([r.std_error for r in rows], np.sqrt(np.diag(v)), rtol=1e-8)


def test_models_without_rows_or_answers(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0), (None, 1.0, 0.0, 2.0), (None, 0.0, 0.0, 1.0), (2, 1.0, None, 1.0)],
                               "k int, g double, y double, weight double")
    got = {r.k: r for r in fit_glm(df, ["k"], "y", ["g"]).marginal_effects(spark, ["g"]).collect()}
    assert got[None].status == "ok" and got[None].estimate is not None  # a NULL key is a model, too
    assert got[2].status == "no_data" and got[2].estimate is None
    assert fit_glm(df.limit(0), ["k"], "y", ["g"]).coefficients(spark).count() == 0
    assert fit_glm_items(df.limit(0), [], ["y"], ["g"]).coefficients(spark).count() == 0
