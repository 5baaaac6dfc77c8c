"""Pairwise correlation and principal components.

Both reduce the data in one distributed aggregation to p x p moments; PCA's
p x p matrix is decomposed on the driver, and per-row scores are plain column arithmetic, so they stay in codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns whose type is numeric, in schema order, minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


PAIRS_PER_BLOCK = 9  # ten moments a pair: a block's aggregation buffer stays under Spark's limit of 100 generated fields


def pairwise_correlation(df: DataFrame, cols: Sequence[str], row_col: str = "row_var",
                         col_col: str = "col_var", value_col: str = "r") -> DataFrame:
    """Pearson r for every ordered pair on pairwise-complete rows.

    One scan: the pairs are cut into blocks, each row is laid out once per
    block (its pairs side by side, inside the scan stage), and one aggregation
    by block keeps the centred, mergeable moments of every pair.  However many
    columns there are, the aggregate stays inside whole-stage code generation;
    one row per task and block is shuffled.  Zero variance or fewer than two
    complete rows gives NULL.  Output: (row_var, col_var, r) for all
    len(cols)^2 ordered pairs.
    """
    cols, spark = list(cols), df.sparkSession
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    none = F.lit(None).cast("double")
    blocks = []
    for b in range(0, len(pairs), PAIRS_PER_BLOCK):
        part = [(F.when(F.col(f"x{j}").isNotNull(), F.col(f"x{i}")), F.when(F.col(f"x{i}").isNotNull(), F.col(f"x{j}")))
                for i, j in pairs[b:b + PAIRS_PER_BLOCK]]
        part += [(none, none)] * (PAIRS_PER_BLOCK - len(part))
        blocks.append(F.struct(F.lit(b // PAIRS_PER_BLOCK).alias("block"),
                               *[c.alias(f"{side}{k}") for k, pair in enumerate(part) for side, c in zip("uv", pair)]))
    laid = x.select(F.explode(F.array(*blocks)).alias("b")).select("b.*")
    moments = laid.groupBy("block").agg(*[F.expr(e.format(k=k)) for k in range(PAIRS_PER_BLOCK) for e in (
        "covar_samp(u{k}, v{k}) AS c{k}", "var_samp(u{k}) AS p{k}", "var_samp(v{k}) AS q{k}")])
    found = moments.select(
        "block", F.posexplode(F.array(*[
            F.try_divide(F.col(f"c{k}"), F.sqrt(F.col(f"p{k}")) * F.sqrt(F.col(f"q{k}"))) for k in range(PAIRS_PER_BLOCK)
        ])).alias("k", value_col)).select((F.col("block") * PAIRS_PER_BLOCK + F.col("k")).alias("pair"), value_col)
    names = [(cols[i], cols[j], at) for at, (i, j) in enumerate(pairs)]
    names += [(cols[j], cols[i], at) for at, (i, j) in enumerate(pairs) if i != j]
    table = spark.createDataFrame(names, f"`{row_col}` string, `{col_col}` string, pair int")
    return table.join(found, "pair", "left").select(row_col, col_col, value_col)


def _standardise_moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Count, means, sample sds and correlation matrix of complete rows (one job)."""
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            aggs.append(F.covar_samp(F.col(cols[i]), F.col(cols[j])).alias(f"c{i}_{j}"))
    row = df.agg(*aggs).collect()[0]  # one row of p(p+1)/2 + 2p + 1 moments
    p = len(cols)
    means = np.array([np.nan if row[f"m{i}"] is None else row[f"m{i}"] for i in range(p)], dtype=float)
    sds = np.array([np.nan if row[f"s{i}"] is None else row[f"s{i}"] for i in range(p)], dtype=float)
    corr = np.eye(p)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(p):
            for j in range(i + 1, p):
                cov = row[f"c{i}_{j}"]
                corr[i, j] = corr[j, i] = (np.nan if cov is None else cov / (sds[i] * sds[j]))
    return int(row["n"]), means, sds, corr


def pca_fit(df: DataFrame, cols: Sequence[str]) -> dict:
    """Principal components of standardised, complete-case columns.

    Equivalent to the SVD of the centred and scaled data: the rotation is the
    eigenvectors of the correlation matrix, ordered by eigenvalue; each
    component's sign is fixed so its largest-magnitude loading is positive.
    Input rows must be complete (filter NULLs first); zero-variance columns
    are rejected.
    """
    n, means, sds, corr = _standardise_moments(df, cols)
    if n < 2:
        raise ValueError("PCA needs at least two complete rows")
    if np.any(~np.isfinite(sds)) or np.any(sds == 0):
        raise ValueError("PCA on a constant column is undefined")
    vals, vecs = np.linalg.eigh(corr)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for k in range(vecs.shape[1]):
        big = np.argmax(np.abs(vecs[:, k]))
        if vecs[big, k] < 0:
            vecs[:, k] = -vecs[:, k]
    return {"cols": list(cols), "n": n, "means": means, "sds": sds,
            "eigenvalues": np.clip(vals, 0.0, None), "rotation": vecs}


def pca_loadings(spark: SparkSession, fit: dict) -> DataFrame:
    """Rotation as a DataFrame: variable, component, loading, sdev, variance share."""
    cols, rot, vals = fit["cols"], fit["rotation"], fit["eigenvalues"]
    total = float(vals.sum())
    rows = [(c, f"PC{k + 1}", k + 1, float(rot[i, k]), float(np.sqrt(vals[k])),
             float(vals[k] / total) if total > 0 else None)
            for i, c in enumerate(cols) for k in range(len(cols))]
    schema = "variable string, component string, component_index int, loading double, " \
             "sdev double, variance_share double"
    return spark.createDataFrame(rows, schema)


def pca_scores(df: DataFrame, fit: dict, keep: Sequence[str] = (), n_components: int | None = None) -> DataFrame:
    """Per-row component scores of the standardised columns (codegen'd arithmetic)."""
    cols, rot, means, sds = fit["cols"], fit["rotation"], fit["means"], fit["sds"]
    k = n_components or len(cols)
    z = [(F.col(c).cast("double") - F.lit(float(means[i]))) / F.lit(float(sds[i]))
         for i, c in enumerate(cols)]
    scores = []
    for comp in range(k):
        expr = None
        for i in range(len(cols)):
            term = z[i] * F.lit(float(rot[i, comp]))
            expr = term if expr is None else expr + term
        scores.append(expr.alias(f"PC{comp + 1}"))
    return df.select(*keep, *scores)
