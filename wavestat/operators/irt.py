"""Two-parameter logistic item response model (one factor) and EAP scores.

Plan: ``response_patterns`` (a ``groupBy(items).count()``) is the only pass
over respondent rows; the pattern table is written once and every EM step
reads it.  A step is one job: tasks compute the posterior of their patterns on
the quadrature nodes (a literal array) and sum the expected counts by node and
the expected correct answers by (item, node).  Only those sums, (items + 1) x
nodes numbers a task (a task reads a whole split of the pattern table), reach
the driver, which adds them and updates slope and intercept per item (Bock &
Aitkin 1981).  The pattern table stays distributed,
so the number of items and of patterns is not bounded; with k items there are
at most 2^k patterns, and never more than respondents.

EM steps are extrapolated in pairs (SQUAREM): a jump along the two last steps
is kept where it does not lower the likelihood, so a fit takes tens of jobs.
Each respondent's expected-a-posteriori score comes from joining the pattern
scores back on the item values.

Model: P(x_i = 1 | theta) = 1 / (1 + exp(-(a_i theta + d_i))), theta ~ N(0, 1),
fixed quadrature on [-6, 6].  The sign is identified by making the slopes sum
positive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavestat.session import materialize_with_path

BLOCK = 4096  # patterns whose posterior is held at once


def response_patterns(df: DataFrame, items: Sequence[str], count_col: str = "n") -> DataFrame:
    """Distinct answer patterns over ``items`` and their frequencies."""
    return df.groupBy(*items).agg(F.count(F.lit(1)).alias(count_col))


def quadrature(n_nodes: int = 61, theta_lim: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and normalised standard normal weights."""
    nodes = np.linspace(-theta_lim, theta_lim, n_nodes)
    prior = np.exp(-0.5 * nodes ** 2)
    return nodes, prior / prior.sum()


def posterior(x: np.ndarray, a: np.ndarray, d: np.ndarray, nodes: np.ndarray, prior: np.ndarray):
    """(patterns x nodes posterior, log-likelihood per pattern)."""
    z = np.outer(nodes, a) + d                      # Q x k
    logp = -np.logaddexp(0.0, -z)                   # log P
    logq = -np.logaddexp(0.0, z)                    # log (1 - P)
    lw = x @ logp.T + (1.0 - x) @ logq.T + np.log(prior)
    mx = lw.max(axis=1, keepdims=True)
    w = np.exp(lw - mx)
    tot = w.sum(axis=1, keepdims=True)
    return w / tot, np.log(tot[:, 0]) + mx[:, 0]


def maximise(nq: np.ndarray, rq: np.ndarray, nodes: np.ndarray, a: np.ndarray, d: np.ndarray):
    """Slopes and intercepts from expected counts per node (nq) and correct answers per item and node (rq): Newton per item."""
    a, d = a.copy(), d.copy()
    for i in range(len(a)):
        for _ in range(20):
            p = 1.0 / (1.0 + np.exp(-np.clip(a[i] * nodes + d[i], -700, 700)))
            resid, wgt = rq[i] - nq * p, nq * p * (1 - p)
            h11, h12, h22 = wgt @ nodes ** 2, wgt @ nodes, wgt.sum()
            det = h11 * h22 - h12 * h12
            if not det > 0:
                break
            g1, g2 = resid @ nodes, resid.sum()
            step = np.array([h22 * g1 - h12 * g2, h11 * g2 - h12 * g1]) / det
            a[i], d[i] = a[i] + step[0], d[i] + step[1]
            if np.max(np.abs(step)) < 1e-10:
                break
    return a, d


def _expected(patterns: DataFrame, items: Sequence[str], a, d, nodes, prior):
    """(expected counts per node, correct answers per item and node, log-likelihood): one job over the patterns."""
    k, q = len(items), len(nodes)

    def count(batches):
        total = np.zeros((k + 1, q))
        loglik = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
                n = part.column(k).to_numpy(zero_copy_only=False)
                post, ll = posterior(x, a, d, nodes, prior)
                post *= n[:, None]
                total[0] += post.sum(0)
                total[1:] += x.T @ post
                loglik += float(n @ ll)
        yield pa.RecordBatch.from_arrays([pa.array([[loglik, *total.ravel()]])], ["sums"])

    sums = np.zeros(1 + (k + 1) * q)
    for r in patterns.mapInArrow(count, "sums array<double>").collect():  # one row of sums per task
        sums += np.array(r.sums)
    counts = sums[1:].reshape(k + 1, q)
    return counts[0], counts[1:], sums[0]


def fit_2pl(df: DataFrame, items: Sequence[str], n_nodes: int = 61, theta_lim: float = 6.0,
            max_steps: int = 2000, tol: float = 1e-4, gain: float = 1e-9) -> dict:
    """Marginal maximum likelihood of the 2PL on complete 0/1 answers in ``df``.

    Stops when an EM step moves no parameter by ``tol``, or when a round adds
    less than ``gain`` of the log-likelihood (a slope that grows without bound,
    where one item decides another, ends so).  Result: items, a, d,
    nodes, prior, steps, loglik and ``patterns``, the written pattern table.
    """
    items = list(items)
    numbers = [F.col(c).cast("double").alias(c) for c in items]
    patterns, _ = materialize_with_path(response_patterns(df.select(*numbers), items), "irt-patterns")
    wrong = F.lit(False)
    for c in items:
        wrong = wrong | F.col(c).isNull() | ~F.col(c).isin(0.0, 1.0)
    start = patterns.agg(F.sum("n").alias("n"), F.count_if(wrong).alias("wrong"),
                         *[F.sum(F.col(c) * F.col("n")).alias(f"s{i}") for i, c in enumerate(items)]).first()
    if not start["n"]:
        raise ValueError("no complete response patterns")
    if start["wrong"]:
        raise ValueError("2PL items must be complete 0/1 answers")
    nodes, prior = quadrature(n_nodes, theta_lim)
    k = len(items)
    pbar = np.clip(np.array([start[f"s{i}"] for i in range(k)]) / start["n"], 1e-4, 1 - 1e-4)
    theta = np.concatenate([np.ones(k), np.log(pbar / (1 - pbar)) * np.sqrt(1 + 1 / 1.7 ** 2)])

    def step(at):
        nq, rq, loglik = _expected(patterns, items, at[:k], at[k:], nodes, prior)
        return np.concatenate(maximise(nq, rq, nodes, at[:k], at[k:])), loglik

    steps, before = 0, -np.inf
    while steps < max_steps:
        first, level = step(theta)
        second, _ = step(first)
        steps += 2
        r, v = first - theta, second - 2 * first + theta
        theta = second
        if np.max(np.abs(v + r)) < tol or level - before < gain * abs(level):
            break
        before = level
        length = max(1.0, np.linalg.norm(r) / max(np.linalg.norm(v), 1e-300))
        while length > 1:  # no parameter more than doubles at once
            jump = first - r + 2 * length * r + length ** 2 * v
            if np.max(np.abs(jump - second) / (1 + np.abs(second))) <= 1:
                landed, reached = step(jump)
                steps += 1
                theta = landed if reached >= level else second
                break
            length = length / 2 if length > 2 else 1.0
    a, d = theta[:k], theta[k:]
    if a.sum() < 0:
        a = -a
    return {"items": items, "a": a, "d": d, "nodes": nodes, "prior": prior, "steps": steps, "patterns": patterns,
            "loglik": float(_expected(patterns, items, a, d, nodes, prior)[2])}


def pattern_scores(spark, fit: dict, score_col: str = "score") -> DataFrame:
    """EAP score and posterior SD for every observed pattern.  Output: items, n, score, score_sd."""
    items, a, d, nodes, prior = (fit[name] for name in ("items", "a", "d", "nodes", "prior"))
    k = len(items)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
                post, _ = posterior(x, a, d, nodes, prior)
                eap = post @ nodes
                sd = np.sqrt(np.clip(post @ nodes ** 2 - eap ** 2, 0, None))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(eap), pa.array(sd)],
                                                 [*part.schema.names, score_col, f"{score_col}_sd"])

    schema = ", ".join([*[f"`{c}` double" for c in items], "n long", f"`{score_col}` double", f"`{score_col}_sd` double"])
    return fit["patterns"].select(*items, "n").mapInArrow(score, schema)


def item_parameters(spark, fit: dict) -> DataFrame:
    """Slope a, intercept d and difficulty b = -d/a per item."""
    rows = [(c, float(fit["a"][i]), float(fit["d"][i]), float(-fit["d"][i] / fit["a"][i]))
            for i, c in enumerate(fit["items"])]
    return spark.createDataFrame(rows, "item string, a double, d double, b double")


def attach_scores(df: DataFrame, scores: DataFrame, items: Sequence[str], score_col: str = "score") -> DataFrame:
    """Join each row to its pattern's score (by broadcast or shuffle, as Spark sizes the written score table)."""
    kept, _ = materialize_with_path(scores.select(*[F.col(c).alias(f"__p_{c}") for c in items], score_col), "irt-scores")
    cond = None
    for c in items:
        e = F.col(c).cast("double") == F.col(f"__p_{c}")
        cond = e if cond is None else cond & e
    return df.join(kept, cond, "left").drop(*[f"__p_{c}" for c in items])
