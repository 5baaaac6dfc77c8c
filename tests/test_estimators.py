"""Estimator cross-checks against closed forms, Spark ML and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavestat.operators.contrast import binary_contrast
from wavestat.operators.domain import domain_mean
from wavestat.operators.glm import fit_glm, t_two_sided_p


@pytest.fixture(scope="module")
def sim(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = rng.integers(0, 2, n).astype(float)
    x1 = rng.integers(0, 2, n).astype(float)
    x2 = rng.normal(size=n).round(1)
    w = rng.uniform(0.2, 3.0, n).round(3)
    eta = -0.3 + 0.8 * g - 0.5 * x1 + 0.4 * x2
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    key = np.where(rng.random(n) < 0.5, "a", "b")
    rows = [(str(key[i]), float(g[i]), float(x1[i]), float(x2[i]), float(w[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, g double, x1 double, x2 double, weight double, y double")
    return df, dict(k=key, g=g, x1=x1, x2=x2, w=w, y=y)


def numpy_logit(X, y, w, iters=50):
    beta = np.zeros(X.shape[1])
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-X @ beta))
        beta = beta + np.linalg.solve(X.T @ (X * (w * mu * (1 - mu))[:, None]), X.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-X @ beta))
    a = X.T @ (X * (w * mu * (1 - mu))[:, None])
    u = X * (w * (y - mu))[:, None]
    n = len(y)
    b = n / (n - 1) * (u - u.mean(0)).T @ (u - u.mean(0))
    ai = np.linalg.inv(a)
    return beta, ai @ b @ ai, mu


def test_glm_matches_closed_form_binary_contrast(spark, sim):
    df, _ = sim
    fit = fit_glm(df.withColumnRenamed("k", "key"), ["key"], "y", ["g"])
    me = {r.key: r for r in fit.marginal_effects(spark, ["g"]).collect()}
    co = {r.key: r for r in fit.coefficients(spark).filter("term = 'g'").collect()}
    cf = {r.key: r for r in binary_contrast(df.withColumnRenamed("k", "key"), ["y"], "g", by=["key"]).collect()}
    for k in ("a", "b"):
        assert math.isclose(co[k].estimate, cf[k].beta, rel_tol=1e-6)
        assert math.isclose(co[k].std_error, cf[k].beta_se, rel_tol=1e-6)
        assert math.isclose(me[k].estimate, cf[k].estimate, rel_tol=1e-6)
        assert math.isclose(me[k].std_error, cf[k].std_error, rel_tol=1e-6)


def test_glm_matches_row_level_sandwich(spark, sim):
    df, d = sim
    fit = fit_glm(df, ["k"], "y", ["g", "x1", "x2"])
    coefs = {(r.k, r.term): r for r in fit.coefficients(spark).collect()}
    for key in ("a", "b"):
        m = d["k"] == key
        X = np.column_stack([np.ones(m.sum()), d["g"][m], d["x1"][m], d["x2"][m]])
        beta, v, _ = numpy_logit(X, d["y"][m], d["w"][m])
        for j, t in enumerate(["(Intercept)", "g", "x1", "x2"]):
            assert math.isclose(coefs[(key, t)].estimate, beta[j], rel_tol=1e-6, abs_tol=1e-9)
            assert math.isclose(coefs[(key, t)].std_error, math.sqrt(v[j, j]), rel_tol=1e-6)


def test_glm_coefficients_match_spark_ml(spark, sim):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    df, _ = sim
    one = df.filter("k = 'a'")
    fit = fit_glm(one, ["k"], "y", ["g", "x1", "x2"])
    ours = {r.term: r.estimate for r in fit.coefficients(spark).collect()}
    vec = VectorAssembler(inputCols=["g", "x1", "x2"], outputCol="features").transform(one)
    ml = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", labelCol="y",
                                     tol=1e-10, maxIter=50).fit(vec)
    assert math.isclose(ours["(Intercept)"], ml.intercept, rel_tol=1e-5)
    for j, t in enumerate(["g", "x1", "x2"]):
        assert math.isclose(ours[t], float(ml.coefficients[j]), rel_tol=1e-5)


def test_ame_delta_method_matches_numeric_gradient(spark, sim):
    df, d = sim
    fit = fit_glm(df.filter("k = 'a'"), ["k"], "y", ["g", "x1", "x2"])
    me = fit.marginal_effects(spark, ["x2"]).collect()[0]
    m = d["k"] == "a"
    X = np.column_stack([np.ones(m.sum()), d["g"][m], d["x1"][m], d["x2"][m]])
    beta, v, _ = numpy_logit(X, d["y"][m], d["w"][m])

    def ame(b):
        mu = 1 / (1 + np.exp(-X @ b))
        return b[3] * np.mean(mu * (1 - mu))

    grad = np.array([(ame(beta + h) - ame(beta - h)) / 2e-6 for h in np.eye(4) * 1e-6])
    assert math.isclose(me.estimate, ame(beta), rel_tol=1e-6)
    assert math.isclose(me.std_error, math.sqrt(grad @ v @ grad), rel_tol=1e-5)


def test_aliased_column_gets_no_estimate(spark):
    rows = []
    rng = np.random.default_rng(3)
    for i in range(400):
        lvl = i % 3
        rows.append((float(lvl == 0), float(lvl == 1), float(lvl == 2), float(rng.random() < 0.4 + 0.1 * lvl),
                     1.0 + (i % 5) / 10))
    df = spark.createDataFrame(rows, "d0 double, d1 double, d2 double, y double, weight double") \
        .withColumn("m", F.lit(1))
    full = {r.term: r for r in fit_glm(df, ["m"], "y", ["d0", "d1", "d2"]).coefficients(spark).collect()}
    reduced = {r.term: r for r in fit_glm(df, ["m"], "y", ["d0", "d1"]).coefficients(spark).collect()}
    assert full["d2"].estimate is None and full["d2"].aliased
    assert full["d2"].status == "rank_deficient"
    for t in ("(Intercept)", "d0", "d1"):
        assert math.isclose(full[t].estimate, reduced[t].estimate, rel_tol=1e-8)
        assert math.isclose(full[t].std_error, reduced[t].std_error, rel_tol=1e-8)


def test_linear_model_matches_weighted_least_squares(spark, sim):
    df, d = sim
    fit = fit_glm(df.filter("k = 'b'"), ["k"], "x2", ["g", "x1"], family="gaussian")
    coefs = {r.term: r for r in fit.coefficients(spark).collect()}
    m = d["k"] == "b"
    X = np.column_stack([np.ones(m.sum()), d["g"][m], d["x1"][m]])
    w, y = d["w"][m], d["x2"][m]
    a = X.T @ (X * w[:, None])
    beta = np.linalg.solve(a, X.T @ (w * y))
    u = X * (w * (y - X @ beta))[:, None]
    n = len(y)
    v = np.linalg.inv(a) @ (n / (n - 1) * u.T @ u) @ np.linalg.inv(a)
    for j, t in enumerate(["(Intercept)", "g", "x1"]):
        assert math.isclose(coefs[t].estimate, beta[j], rel_tol=1e-8, abs_tol=1e-12)
        assert math.isclose(coefs[t].std_error, math.sqrt(v[j, j]), rel_tol=1e-8)
        assert coefs[t].df_resid == n - 3


def test_t_p_values():
    assert math.isclose(t_two_sided_p(2.0, 10), 0.0733880347, rel_tol=1e-7)
    assert math.isclose(t_two_sided_p(1.96, 1e7), 0.0499957902, rel_tol=1e-5)
    assert math.isclose(t_two_sided_p(0.0, 5), 1.0)


def test_domain_mean_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 500
    dom = rng.choice(["D", "R"], n)
    y = np.where(rng.random(n) < 0.15, np.nan, (rng.random(n) < 0.4).astype(float))
    w = rng.uniform(0.5, 2.0, n)
    rows = [(2020, str(dom[i]), None if np.isnan(y[i]) else float(y[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "year int, party string, y double, weight double")
    got = {r.party: r for r in domain_mean(df, ["y"], "party", ["year"]).collect()}
    for d_ in ("D", "R"):
        m = (dom == d_) & ~np.isnan(y)
        W = w[m].sum()
        mean = (w[m] * y[m]).sum() / W
        u = w[m] * (y[m] - mean) / W
        se = math.sqrt(n / (n - 1) * (u ** 2).sum())
        assert math.isclose(got[d_].mean, mean, rel_tol=1e-12)
        assert math.isclose(got[d_].std_error, se, rel_tol=1e-9)
        assert got[d_].n == n


def test_weight_scaling_leaves_estimates_unchanged(spark, sim):
    df, _ = sim
    a = {r.term: r for r in fit_glm(df, ["k"], "y", ["g", "x2"]).coefficients(spark).filter("k='a'").collect()}
    b = {r.term: r for r in fit_glm(df.withColumn("weight", F.col("weight") * 3), ["k"], "y", ["g", "x2"])
         .coefficients(spark).filter("k='a'").collect()}
    for t in a:
        assert math.isclose(a[t].estimate, b[t].estimate, rel_tol=1e-7)
        assert math.isclose(a[t].std_error, b[t].std_error, rel_tol=1e-7)


def test_separated_group_is_flagged(spark):
    rows = [(1.0, 1.0, 1.0)] * 20 + [(0.0, 1.0, 1.0)] * 10 + [(0.0, 0.0, 1.0)] * 10
    df = spark.createDataFrame(rows, "g double, y double, weight double").withColumn("year", F.lit(2020))
    r = binary_contrast(df, ["y"], "g").collect()[0]
    assert r.status == "separated" and r.estimate is None


def test_model_based_variance_matches_spark_ml(spark, sim):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    df, _ = sim
    one = df.filter("k = 'b'")
    fit = fit_glm(one, ["k"], "y", ["g", "x1", "x2"], variance="model")
    ours = {r.term: r for r in fit.coefficients(spark).collect()}
    vec = VectorAssembler(inputCols=["g", "x1", "x2"], outputCol="features").transform(one)
    ml = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", labelCol="y",
                                     tol=1e-10, maxIter=50).fit(vec)
    se = ml.summary.coefficientStandardErrors  # coefficients..., intercept
    for j, t in enumerate(["g", "x1", "x2"]):
        assert math.isclose(ours[t].std_error, se[j], rel_tol=1e-4)
    assert math.isclose(ours["(Intercept)"].std_error, se[-1], rel_tol=1e-4)


def test_discrete_change_marginal_effect(spark, sim):
    df, d = sim
    fit = fit_glm(df.filter("k = 'a'"), ["k"], "y", ["g", "x1", "x2"], difference_terms=["g"])
    me = fit.marginal_effects(spark, ["g"], kind="difference").collect()[0]
    m = d["k"] == "a"
    X = np.column_stack([np.ones(m.sum()), d["g"][m], d["x1"][m], d["x2"][m]])
    beta, v, _ = numpy_logit(X, d["y"][m], d["w"][m])

    def change(b):
        x1, x0 = X.copy(), X.copy()
        x1[:, 1], x0[:, 1] = 1.0, 0.0
        return np.mean(1 / (1 + np.exp(-x1 @ b)) - 1 / (1 + np.exp(-x0 @ b)))

    grad = np.array([(change(beta + h) - change(beta - h)) / 2e-6 for h in np.eye(4) * 1e-6])
    assert math.isclose(me.estimate, change(beta), rel_tol=1e-6)
    assert math.isclose(me.std_error, math.sqrt(grad @ v @ grad), rel_tol=1e-5)


def test_domain_mean_far_from_zero(spark):
    rng = np.random.default_rng(12)
    n = 3000
    y = np.column_stack([1e6 + rng.normal(size=n), rng.normal(size=n)])
    w = rng.uniform(0.5, 2, n)
    far = rng.random(n) < 0.5
    y[far, 0] -= 1e6  # one domain near zero, one far from it
    rows = [("far" if far[i] else None, float(y[i, 0]), float(y[i, 1]) if i % 7 else None, float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "d string, a double, b double, weight double").withColumn("year", F.lit(2020))
    got = {(r.item, r.d): r for r in domain_mean(df, ["a", "b"], "d", ["year"]).collect()}
    for j, item in enumerate("ab"):
        for d_, here in (("far", far), (None, ~far)):
            m = here & (np.arange(n) % 7 > 0) if item == "b" else here
            total = w[m].sum()
            mean = (w[m] * y[m, j]).sum() / total
            se = math.sqrt(n / (n - 1) * ((w[m] * (y[m, j] - mean) / total) ** 2).sum())
            assert math.isclose(got[item, d_].mean, mean, rel_tol=1e-12, abs_tol=1e-9)
            assert math.isclose(got[item, d_].std_error, se, rel_tol=1e-9)
            assert got[item, d_].n == n and got[item, d_].n_obs == m.sum()
