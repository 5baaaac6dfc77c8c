"""Correlation, PCA and 2PL IRT checks."""

import math

import numpy as np
import pandas as pd
import pytest

from wavestat.operators.irt import attach_scores, fit_2pl, maximise, pattern_scores, posterior, quadrature
from wavestat.operators.multivar import pairwise_correlation, pca_fit, pca_loadings, pca_scores


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(9)
    n = 400
    a = rng.normal(size=n)
    b = 0.6 * a + rng.normal(size=n)
    c = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n) - 0.3 * a)
    const = np.ones(n)
    pdf = pd.DataFrame({"a": a, "b": np.where(rng.random(n) < 0.1, np.nan, b), "c": c, "k": const})
    rows = [tuple(None if (isinstance(v, float) and math.isnan(v)) else float(v) for v in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "a double, b double, c double, k double"), pdf


def test_pairwise_correlation_matches_pandas(spark, mixed):
    df, pdf = mixed
    got = {(r.row_var, r.col_var): r.r for r in pairwise_correlation(df, ["a", "b", "c", "k"]).collect()}
    ref = pdf.corr(min_periods=2)
    assert len(got) == 16
    for x in "abc":
        for y in "abc":
            assert math.isclose(got[(x, y)], ref.loc[x, y], rel_tol=1e-9, abs_tol=1e-12)
            assert got[(x, y)] == got[(y, x)]
        assert math.isclose(got[(x, x)], 1.0, rel_tol=1e-12)
        assert got[(x, "k")] is None  # zero variance -> NULL, no error


def test_pca_matches_svd_and_is_orthonormal(spark, mixed):
    df, pdf = mixed
    cc = df.select("a", "b", "c").dropna()
    fit = pca_fit(cc, ["a", "b", "c"])
    x = pdf[["a", "b", "c"]].dropna().to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    rot = fit["rotation"]
    assert np.allclose(rot.T @ rot, np.eye(3), atol=1e-10)
    for k in range(3):
        assert np.allclose(np.abs(rot[:, k]), np.abs(vt[k]), atol=1e-8)
        assert math.isclose(math.sqrt(fit["eigenvalues"][k]), s[k] / math.sqrt(len(x) - 1), rel_tol=1e-8)
    load = pca_loadings(spark, fit).collect()
    assert len(load) == 9
    scores = pca_scores(cc, fit).toPandas().to_numpy()
    assert np.allclose(np.abs(scores), np.abs(z @ vt.T), atol=1e-8)


def test_2pl_recovers_parameters(spark):
    rng = np.random.default_rng(2024)
    a_true = np.array([1.5, 0.8, 1.2, 2.0, 1.0, 0.6])
    d_true = np.array([-0.5, 0.3, 0.0, -1.0, 0.8, -0.2])
    th = rng.standard_normal(20000)
    x = (rng.random((20000, 6)) < 1 / (1 + np.exp(-(np.outer(th, a_true) + d_true)))).astype(float)
    items = [f"i{j}" for j in range(6)]
    pdf = pd.DataFrame(x, columns=items)
    pdf.insert(0, "rid", np.arange(len(pdf)))
    df = spark.createDataFrame(pdf)
    fit = fit_2pl(df, items)
    assert np.max(np.abs(fit["a"] - a_true)) < 0.15
    assert np.max(np.abs(fit["d"] - d_true)) < 0.1
    assert fit["patterns"].count() <= 2 ** 6
    scores = pattern_scores(spark, fit, "score")
    scored = attach_scores(df, scores, items, "score")
    assert scored.count() == 20000 and scored.filter("score is null").count() == 0
    # EAP correlates with the true ability
    s = np.array([r.score for r in scored.select("rid", "score").orderBy("rid").collect()])
    assert np.corrcoef(s, th)[0, 1] > 0.7


def _plain_em(x, n, steps=3000, tol=1e-7):
    """EM on one pattern table, without extrapolation."""
    nodes, prior = quadrature()
    k = x.shape[1]
    p = (n @ x) / n.sum()
    a, d = np.ones(k), np.log(p / (1 - p)) * np.sqrt(1 + 1 / 1.7 ** 2)
    for _ in range(steps):
        post, _ = posterior(x, a, d, nodes, prior)
        new = maximise(n @ post, ((post * n[:, None]).T @ x).T, nodes, a, d)
        change = max(np.max(np.abs(new[0] - a)), np.max(np.abs(new[1] - d)))
        a, d = new
        if change < tol:
            return a, d
    return a, d


def test_2pl_equals_plain_em_on_64_patterns(spark):
    rng = np.random.default_rng(5)
    a_true, d_true = np.array([1.4, 0.7, 1.1, 1.9, 0.9, 1.2]), np.array([-0.4, 0.2, 0.1, -0.9, 0.6, 0.0])
    th = rng.standard_normal(4000)
    x = (rng.random((4000, 6)) < 1 / (1 + np.exp(-(np.outer(th, a_true) + d_true)))).astype(float)
    pats, n = np.unique(x, axis=0, return_counts=True)
    want = _plain_em(pats, n.astype(float))
    items = [f"i{j}" for j in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=items)).repartition(5)
    fit = fit_2pl(df, items, tol=1e-6)
    assert np.allclose(fit["a"], want[0], atol=2e-4) and np.allclose(fit["d"], want[1], atol=2e-4)
    nodes, prior = quadrature()
    eap = {tuple(r[:6]): r.score for r in pattern_scores(spark, fit, "score").collect()}
    post, _ = posterior(pats, *want, nodes, prior)
    assert np.allclose([eap[tuple(p)] for p in pats], post @ nodes, atol=1e-3)


def test_2pl_recovers_20_items(spark):
    rng = np.random.default_rng(77)
    k, n = 20, 12000
    a_true, d_true = rng.uniform(0.6, 2.0, k), rng.uniform(-1.2, 1.2, k)
    th = rng.standard_normal(n)
    x = (rng.random((n, k)) < 1 / (1 + np.exp(-(np.outer(th, a_true) + d_true)))).astype(float)
    items = [f"i{j}" for j in range(k)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=items))
    fit = fit_2pl(df, items)
    assert fit["patterns"].count() > 2 ** 6  # nearly a pattern per respondent, none of them on the driver
    assert np.max(np.abs(fit["a"] - a_true)) < 0.2 and np.max(np.abs(fit["d"] - d_true)) < 0.15
    scored = attach_scores(df, pattern_scores(spark, fit, "score"), items, "score")
    assert scored.filter("score IS NULL").count() == 0 and scored.count() == n


def test_2pl_rejects_other_answers(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="0/1"):
        fit_2pl(df, ["a", "b"])
    with pytest.raises(ValueError, match="no complete"):
        fit_2pl(df.limit(0), ["a", "b"])


def test_correlation_is_one_generated_scan_under_default_settings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)) + 1e6 * (np.arange(12) == 3)
    x[:, 5] = x[:, 4] * 2 + 1
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(12)]))
    limit = spark.conf.get("spark.sql.codegen.maxFields")
    spark.conf.set("spark.sql.codegen.maxFields", "100")  # a plain session's setting
    try:
        out = pairwise_correlation(df, df.columns)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.codegen.maxFields", limit)
    want = np.corrcoef(x.T)
    got = {(r.row_var, r.col_var): r.r for r in rows}
    assert len(got) == 144 and all(math.isclose(got[f"c{i}", f"c{j}"], want[i, j], abs_tol=1e-9) for i in range(12) for j in range(12))
    final = plan.split("Initial Plan")[0]
    partial = [line for line in final.splitlines() if "HashAggregate" in line and "partial_covar_samp" in line]
    assert len(partial) == 1 and "*(" in partial[0]  # one aggregation over one scan, generated
    assert all(r.r is None for r in pairwise_correlation(df.limit(0), ["c0", "c1"]).collect())
    assert all(r.r is None for r in pairwise_correlation(df.limit(1), ["c0", "c1"]).collect())
