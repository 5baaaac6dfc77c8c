"""Whitening of embeddings through the singular values of the centred vectors.

1. Vectors become whole numbers ``floor(SCALE * entry)``; the fit list has each
   different one once, written to the shared folder and read by every pass.
2. Count and exact sums per dimension give the mean.
3. Every task reduces its centred rows block by block to a triangular R (QR of
   the last R over the next block); R's of ``FAN`` tasks are stacked and
   reduced again until one is left.  V = R'R / n is never formed.
4. Householder reflections from both sides make R bidiagonal (``bidiagonal``).
5. The differential qd algorithm with shifts finds the squares of its singular
   values, each to high relative accuracy (``dqds``).
6. The directions are eigenvectors of the tridiagonal B'B, from twisted
   factorisations: forward and backward qd transforms at the eigenvalue meet
   where they fit best (``direction``).  Values too close to tell directions
   apart are solved again within their cluster, orthogonal to those before.
7. A pass over the fit list measures the covariance of the whitened vectors;
   one over all rows projects them.

Only d numbers per sum, one d x d R and the k x k covariance reach the driver,
d being the length of a vector.

Rows whose vector is null, empty or holds null or non-finite entries are left
out, as are those whose length is not the most frequent one (ties: the
longer), as no covariance is defined for them.  Repeated rows count once in
the fit and each keep their own result rows; null ids are kept.  Components
without variance (fewer different vectors than dimensions) have null
``whitened``; with one vector alone ``explained`` is null too.  A deviation
beyond a long is null.  An empty table gives no rows.  Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, written

SCALE, BLOCK, FAN = 256, 2048, 8
EPS = np.finfo(float).eps

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("vec_id", T.LongType()), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
    ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])


# -- the d x d solver ---------------------------------------------------------

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v and value a with (I - 2 v v') x = a e1."""
    size = np.linalg.norm(x)
    if size == 0:
        return np.zeros_like(x), 0.0
    v = x.copy()
    a = -math.copysign(size, x[0])
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor Q of a square r: r = P B Q'."""
    m = r.astype(float).copy()
    d = len(m)
    q = np.eye(d)
    for j in range(d):
        v, _ = _reflector(m[j:, j])
        m[j:, j:] -= 2 * np.outer(v, v @ m[j:, j:])
        if j < d - 2:
            v, _ = _reflector(m[j, j + 1:])
            m[j:, j + 1:] -= 2 * np.outer(m[j:, j + 1:] @ v, v)
            q[:, j + 1:] -= 2 * np.outer(q[:, j + 1:] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), q


def _sweep(q: list[float], e: list[float], shift: float):
    """One differential qd step with a shift: new q and e, or None where the shift was too large."""
    nq, ne = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        nq.append(d + e[i])
        t = q[i + 1] / nq[i]
        ne.append(e[i] * t)
        d = d * t - shift
    return (nq + [d], ne) if d >= 0 else None


def _shift(q: list[float], e: list[float]) -> float:
    """Lesser eigenvalue of the last two rows of B'B less their tie to the row before, at least 0."""
    before = e[-2] if len(q) > 2 else 0.0
    first, last, tie = q[-2] + before, q[-1] + e[-1], q[-2] * e[-1]
    half = (first + last) / 2 + math.sqrt(((first - last) / 2) ** 2 + tie)
    low = (q[-2] * q[-1] + before * last) / half  # determinant over the greater eigenvalue
    return max(0.0, low - (math.sqrt(q[-3] * before) if before else 0.0)) * (1 - 4 * EPS)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    Values leave at the end of the array as its last off-diagonal entry fades;
    an entry that fades within parts the array.  A shift that is too large is
    taken back and divided by four.
    """
    found: list[float] = []
    parts = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while parts:
        q, e, base = parts.pop()
        sweeps = 0
        while len(q) > 1:
            gone = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (q[i] + base)), None)
            if gone is not None:
                parts.append((q[gone + 1:], e[gone + 1:], base))
                q, e = q[:gone + 1], e[:gone]
                continue
            if 4 * q[0] < q[-1]:  # the same values from the other end, so that small ones gather last
                q, e = q[::-1], e[::-1]
            shift = _shift(q, e) if sweeps > 1 else 0.0
            step = _sweep(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > EPS * (base + q[-1]) else 0.0
                step = _sweep(q, e, shift)
            q, e = step
            base += shift
            sweeps += 1
        found.append(q[0] + base)
    return np.sort(np.array(found))[::-1]


def direction(diagonal: np.ndarray, above: np.ndarray, value: float, rhs: np.ndarray | None = None) -> np.ndarray:
    """Unit eigenvector of B'B at an eigenvalue, by the twisted factorisation that fits best.

    ``rhs``: the direction of the solution of (B'B - value) x = rhs instead.
    """
    n = len(diagonal)
    tiny = EPS * EPS * max(float(np.max(diagonal ** 2)), float(np.max(above ** 2, initial=0.0)))
    d = [max(float(a) ** 2, tiny) for a in diagonal]
    ratio = [math.copysign(float(b), a * b) / math.sqrt(di) for a, b, di in zip(diagonal, above, d)]

    def pivot(x):
        return x if abs(x) > tiny else math.copysign(tiny, x)

    plus, down, s = [], [], [-value]  # forward: B'B - value = L D L'
    for i in range(n - 1):
        plus.append(pivot(s[i] + d[i]))
        down.append(d[i] * ratio[i] / plus[i])
        s.append(down[i] * ratio[i] * s[i] - value)
    minus, up, p = [0.0] * n, [0.0] * n, [0.0] * n  # backward: U D U'
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus[i + 1] = pivot(d[i] * ratio[i] ** 2 + p[i + 1])
        t = d[i] / minus[i + 1]
        up[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    meet = [s[i] + p[i] + value for i in range(n)]
    k = min(range(n), key=lambda i: abs(meet[i]))
    y = np.zeros(n)
    if rhs is None:
        y[k] = 1.0
    else:
        y = rhs.astype(float).copy()
        for i in range(1, k):
            y[i] -= down[i - 1] * y[i - 1]
        for i in range(n - 2, k, -1):
            y[i] -= up[i] * y[i + 1]
        y[k] -= (down[k - 1] * y[k - 1] if k else 0.0) + (up[k] * y[k + 1] if k < n - 1 else 0.0)
        y /= np.array(plus[:k] + [pivot(meet[k])] + minus[k + 1:])
    for i in range(k - 1, -1, -1):
        y[i] -= down[i] * y[i + 1]
    for i in range(k + 1, n):
        y[i] -= up[i - 1] * y[i - 1]
    y /= np.max(np.abs(y))
    return y / np.linalg.norm(y)


def components(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of r'r, falling, all; the first ``count`` unit eigenvectors as columns)."""
    d, size = len(r), np.max(np.abs(r), initial=0.0)
    if size == 0:
        return np.zeros(d), np.eye(d)[:, :count]
    a, b, q = bidiagonal(r / size)
    b = np.where(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])), 0.0, b)
    cuts = [0, *(np.flatnonzero(b == 0) + 1).tolist(), d]  # blocks that do not touch
    values = sorted(((float(v), lo, hi) for lo, hi in zip(cuts, cuts[1:]) for v in dqds(a[lo:hi], b[lo:hi - 1])), reverse=True)
    rng = np.random.default_rng(7)
    out = np.zeros((d, min(count, d)))
    for j, (value, lo, hi) in enumerate(values[:count]):
        near = [i for i in range(j) if values[i][1] == lo
                and values[i][0] - value <= max(1e-3 * values[i][0], d * EPS * values[0][0])]
        others = out[lo:hi, near]
        z = direction(a[lo:hi], b[lo:hi - 1], value)
        for _ in range(8):  # orthogonal within the cluster; solved anew where little is left
            left = z - others @ (others.T @ z)
            if not near or np.linalg.norm(left) > 0.7:
                break
            start = rng.standard_normal(hi - lo)
            z = direction(a[lo:hi], b[lo:hi - 1], value, start - others @ (others.T @ start))
        left -= others @ (others.T @ left)
        out[lo:hi, j] = left / np.linalg.norm(left)
    return np.array([v for v, _, _ in values]) * size ** 2, q @ out


# -- the passes ---------------------------------------------------------------

def whole(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, x) with x the vector in whole numbers; rows without a usable vector left out."""
    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = F.transform(vec, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    out = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    size = out.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.where(F.size("x") == size.d) if size else out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = column(batch, "x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _blocks(batches):
    """The rows of the batches as matrices of at most ``BLOCK`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.slice(at, BLOCK))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension (a row of sums per task is shuffled)."""
    def add(batches):
        n, total = 0, 0
        for x in _blocks(batches):
            wide = int(np.abs(x).max()) >= 2 ** 62 // BLOCK
            total = total + (x.astype(object).sum(0) if wide else x.sum(0).astype(object))
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(v) for v in total]])], ["n", "sums"])

    parts = fit.select("x").mapInArrow(add, "n long, sums array<string>")
    rows = (parts.select("n", F.posexplode("sums").alias("at", "value"))
            .groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
            .orderBy("at").collect())  # one row per dimension
    return (int(rows[0].n), [int(r.total) for r in rows]) if rows else (0, [])


def _triangle(rows: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    d = rows.shape[1]
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _triangular(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred fit list: QR per block and task, then over ``FAN`` tasks' R at a time."""
    d = len(mean)

    def reduce_task(batches):
        from pyspark import TaskContext
        r = np.zeros((0, d))
        for x in _blocks(batches):
            r = _triangle(np.vstack([r, x - mean]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([r.ravel()])], ["task", "r"])

    def reduce_group(table):
        stacked = np.array(table.column("r").to_pylist()).reshape(-1, d)
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // FAN]), "r": pa.array([_triangle(stacked).ravel()])})

    shape = "task long, r array<double>"
    parts = written(fit.select("x").mapInArrow(reduce_task, shape), "whitening-r")
    left = parts.count()  # a row per task
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("task") / FAN)).applyInArrow(reduce_group, shape)
        parts = written(parts, "whitening-r")
        left = parts.count()
    return np.array(parts.first().r).reshape(d, d)


def _covariance(fit: DataFrame, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Covariance of the whitened fit list, centred first (sums of centred products per task)."""
    k = turn.shape[1]

    def add(batches):
        total = np.zeros((k, k))
        for x in _blocks(batches):
            z = (x - mean) @ turn
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["products"])

    rows = (fit.select("x").mapInArrow(add, "products array<double>").select(F.posexplode("products").alias("at", "value"))
            .groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect())  # k x k rows
    return np.array([r.value for r in rows]).reshape(k, k)


def whitened(vectors: DataFrame, wanted: int | None = None) -> DataFrame:
    """Whitened coordinates of every usable row on the first ``wanted`` directions (all where None)."""
    spark = vectors.sparkSession
    rows = whole(vectors)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    d = len(sums)
    count = min(wanted or d, d)
    mean = np.array([s / n for s in sums])
    values, directions = components(_triangular(fit, mean), count)
    e = values / n
    trace = float(e.sum())
    live = e[:count] > d * EPS * e[0] if trace > 0 else np.zeros(count, bool)
    turn = directions[:, :count] / np.sqrt(np.where(live, e[:count], 1.0))
    error = None
    if live.any():
        seen = _covariance(fit, mean, turn[:, live]) / n
        error = float(np.max(np.abs(seen - np.eye(int(live.sum())))))
    share = [float(v) / trace if trace > 0 else None for v in e[:count]]
    total, most = np.array(sums, dtype=object), max(abs(s) for s in sums)

    def project(batches):
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            x, m = _matrix(batch), batch.num_rows
            z = (x - mean) @ turn
            reach = n * int(np.abs(x).max(initial=0)) + most
            if d * reach * reach < 2 ** 63:
                off = n * x - total.astype(np.int64)
                deviation = (off * off).sum(1).tolist()
            else:
                deviation = [int(v) for v in ((n * x.astype(object) - total) ** 2).sum(1)]
                deviation = [v if v < 2 ** 63 else None for v in deviation]
            z = pa.array(z.ravel(), mask=np.tile(~live, m))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id").take(pa.array(np.repeat(np.arange(m), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n)),
                 pa.array(np.repeat(np.array(deviation, dtype=object), count), pa.int64()), z,
                 pa.array(share * m, pa.float64()), pa.array([error] * (m * count), pa.float64())], SCHEMA.fieldNames())

    return rows.mapInArrow(project, SCHEMA)
