"""DuckDB SQL of the iterated models: Newton steps of the logits and Jacobi rotations as recursive CTEs.

Matrices are lists (row after row); a p x p system is solved by Gauss-Jordan
elimination as a ``list_reduce`` over the pivots.  Every statement runs a fixed
number of steps, past convergence.
"""

from __future__ import annotations

from wavestat import study as S
from wavestat.plans.oracle import _all_nn, _dummy_sql, _standin_sql, swing_values_sql, with_resp
from wavestat.plans.sqltext import case_map, ident, in_list, q, r6, union_long

NEWTON_STEPS = 14


def _recursive(sql: str) -> str:
    return sql.replace("WITH resp", "WITH RECURSIVE resp", 1)


def _eliminated(m: str, p: int) -> str:
    """Gauss-Jordan of the p x 2p list ``m`` (matrix beside the identity)."""
    w = 2 * p
    pivots = ", ".join(f"[{k}.0]" for k in range(1, p + 1))
    row, col, k = f"((t - 1) // {w})", f"((t - 1) % {w} + 1)", "CAST(k[1] AS INT)"
    pivot = f"m[({k} - 1) * {w} + {k}]"
    above = f"m[({k} - 1) * {w} + {col}]"
    return (f"list_reduce([{pivots}]::DOUBLE[][], lambda m, k: list_transform(range(1, {p * w + 1}), lambda t: "
            f"CASE WHEN {row} + 1 = {k} THEN m[t] / {pivot} ELSE m[t] - m[{row} * {w} + {k}] * {above} / {pivot} END), {m})")


def _times(m: str, v: str, p: int, width: int, skip: int = 0) -> str:
    """Matrix (rows of ``width``, the last p after ``skip``) times the list ``v``."""
    return (f"list_transform(range(1, {p + 1}), lambda i: "
            f"list_dot_product({m}[(i - 1) * {width} + {skip} + 1 : (i - 1) * {width} + {skip} + {p}], {v}))")


def _newton(keys: list[str], p: int) -> str:
    """CTEs it, fit from cells(keys, x1.., n, sw, sw2, swy, sw2y, sw2yy): coefficients b, inverse information
    (p x 2p, right half), meat, a_sum, a_vec, n_fit per model."""
    ks = "".join(f"{k}, " for k in keys)
    both = " AND ".join([f"c.{k} = it.{k}" for k in keys]) or "true"
    x = ["1.0", *[f"c.x{i}" for i in range(1, p)]]
    eta = " + ".join(f"it.b[{i + 1}] * {x[i]}" for i in range(p))
    grid = ", ".join(f"sum(wt * {x[i]} * {x[j]})" if j < p else f"CAST({1.0 if j - p == i else 0.0} AS DOUBLE)"
                     for i in range(p) for j in range(2 * p)).replace("c.", "")
    score = ", ".join(f"sum((swy - sw * mu) * {xi})" for xi in x).replace("c.", "")
    meat = ", ".join(f"sum((sw2yy - 2 * mu * sw2y + mu * mu * sw2) * {x[i]} * {x[j]})"
                     for i in range(p) for j in range(p)).replace("c.", "")
    grad = ", ".join(f"sum(n * v * (1 - 2 * mu) * {xi})" for xi in x).replace("c.", "")
    at = (f"SELECT *, mu * (1 - mu) AS v, sw * mu * (1 - mu) AS wt FROM (SELECT it.k, {', '.join([f'it.{k}' for k in keys] + ['it.b'])}, "
          f"c.* EXCLUDE ({', '.join(keys) or 'none_'}), 1 / (1 + exp(-({eta}))) AS mu FROM it JOIN cells c ON {both} WHERE ")
    at = at.replace("c.* EXCLUDE (none_)", "c.*")
    step = (f"SELECT k + 1, {ks}list_transform(range(1, {p + 1}), lambda i: b[i] + d[i]) FROM ("
            f"SELECT k, {ks}b, {_times('inv', 's', p, 2 * p, p)} AS d FROM ("
            f"SELECT k, {ks}b, s, {_eliminated('g', p)} AS inv FROM ("
            f"SELECT k, {ks}any_value(b) AS b, [{grid}] AS g, [{score}] AS s FROM ({at}it.k < {NEWTON_STEPS})) "
            f"GROUP BY k{''.join(', ' + k for k in keys)})))")
    zeros = ", ".join(["CAST(0 AS DOUBLE)"] * p)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    start = f"SELECT DISTINCT 0 AS k, {ks}[{zeros}] AS b FROM cells"
    return f"""it(k, {ks}b) AS ({start} UNION ALL {step}),
fit0 AS (SELECT {ks}any_value(b) AS b, [{grid}] AS g, [{meat}] AS meat, sum(n * v) AS a_sum, [{grad}] AS a_vec,
  CAST(sum(n) AS BIGINT) AS n_fit FROM ({at}it.k = {NEWTON_STEPS})) {group}),
fit AS (SELECT *, {_eliminated('g', p)} AS inv FROM fit0)"""


def _cells(source: str, keys: list[str], xs: list[str]) -> str:
    """CTEs cells and sizes from long design rows (keys, y, weight, predictors)."""
    ks = "".join(f"{k}, " for k in keys)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ["y", "weight", *xs])
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS x{i + 1}" for i, c in enumerate(xs))
    names = ", ".join(f"x{i + 1}" for i in range(len(xs)))
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""cells AS (SELECT {ks}{names}, count(*) AS n, sum(weight) AS sw, sum(weight * weight) AS sw2, sum(weight * y) AS swy,
  sum(weight * weight * y) AS sw2y, sum(weight * weight * y * y) AS sw2yy
  FROM (SELECT {ks}y, weight, {cols} FROM {source} WHERE {whole}) GROUP BY {ks}{names}),
sizes AS (SELECT {ks}count(*) AS n_design FROM {source} {group})"""


PARTY_TERMS = list(S.PARTY_EFFECT_TERMS)


def _party_effects_ctes() -> str:
    from wavestat.sources.respondents import ADAPTER_SWING_BY_YEAR
    p, ids = 4, ["year", "weight", "rep_party", "dem_party", "swing_state"]
    parts = []
    for term in PARTY_TERMS:
        j = ["(Intercept)", "rep_party", "dem_party", "swing_state"].index(term)
        g = f"list_transform(range(1, {p + 1}), lambda i: (b[{j + 1}] * a_vec[i] + CASE WHEN i = {j + 1} THEN a_sum ELSE 0 END) / n_fit)"
        parts.append(f"SELECT year, item, {q(term)} AS term, b[{j + 1}] * a_sum / n_fit AS est, inv, meat, n_fit, {g} AS g FROM fit")
    return f"""sw AS ({swing_values_sql(ADAPTER_SWING_BY_YEAR)}),
d AS (SELECT r.*, CAST(party = 'REPUBLICAN' AS DOUBLE) AS rep_party, CAST(party = 'DEMOCRAT' AS DOUBLE) AS dem_party,
             CAST(CASE WHEN sw.year IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS swing_state
      FROM resp r LEFT JOIN sw ON r.year = sw.year AND r.state = sw.state),
long0 AS ({union_long('d', ids, S.CORE_ITEMS, 'item', 'y')}),
long AS (SELECT * FROM long0 WHERE y IS NOT NULL),
{_cells('long', ['year', 'item'], ids[2:])},
{_newton(['year', 'item'], p)},
terms AS ({' UNION ALL '.join(parts)}),
h AS (SELECT *, {_times('inv', 'g', p, 2 * p, p)} AS h FROM terms),
e AS (SELECT year, item, term, est, n_design, n_fit,
  sqrt(n_design / (n_design - 1.0) * list_dot_product(h, {_times('meat', 'h', p, p)})) AS se FROM h JOIN sizes USING (year, item))"""


def party_effects() -> str:
    return _recursive(with_resp(f"""SELECT year, item, {case_map('item', S.EFFECT_LABELS)} AS fraud_label, term,
  {case_map('term', S.PARTY_EFFECT_TERMS)} AS party, {r6('est', 'estimate')}, {r6('se', 'std_error')},
  {r6('est - 1.96 * se', 'ci_lower')}, {r6('est + 1.96 * se', 'ci_upper')}, n_design, n_fit, 'ok' AS status FROM e""",
                                _party_effects_ctes()))


def party_effect_trend() -> str:
    idx = case_map("year", {y: i + 1 for i, y in enumerate(S.SURVEY_YEARS)})
    return _recursive(with_resp(f"""SELECT item, term, {r6(f'regr_slope(est, {idx})', 'slope')},
  {r6(f'regr_intercept(est, {idx})', 'intercept')}, CAST(regr_count(est, {idx}) AS BIGINT) AS n_points FROM e GROUP BY item, term""",
                                _party_effects_ctes()))


def _coefficients(keys: list[str], terms: list[str]) -> str:
    """CTE coef(keys, term, est, se, p) from fit and sizes."""
    p = len(terms)
    ks = "".join(f"{k}, " for k in keys)
    parts = [f"SELECT {ks}{q(t)} AS term, b[{j + 1}] AS est, inv[{j * 2 * p + p + 1}:{(j + 1) * 2 * p}] AS h, meat, n_fit FROM fit"
             for j, t in enumerate(terms)]
    sizes = f"JOIN sizes USING ({', '.join(keys)})" if keys else "CROSS JOIN sizes"
    half = "(df + 1) / 2.0"
    density = f"exp(lgamma({half}) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + x * x / df, -{half})"
    weight = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = density.replace("x * x", "(i * t / 400.0) * (i * t / 400.0)")
    return f"""hs AS ({' UNION ALL '.join(parts)}),
se AS (SELECT {ks}term, est, n_fit - {p} AS df,
  sqrt(n_design / (n_design - 1.0) * list_dot_product(h, {_times('meat', 'h', p, p)})) AS se FROM hs {sizes}),
ts AS (SELECT *, least(abs(est / se), 12.0) AS t FROM se),
coef AS (SELECT {ks}term, est, se,
  1 - 2 * (t / 400.0 / 3) * list_sum(list_transform(range(0, 401), lambda i: ({weight}) * ({inner}))) AS p FROM ts)"""


def _r3(expr: str, alias: str) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE), 3) + CAST(0.0 AS DOUBLE)) AS {ident(alias)}"


def _demographic_ctes() -> str:
    xs = S.DEMOGRAPHIC_PREDICTORS
    dummies = ", ".join(_dummy_sql(*d) for d in S.DEMOGRAPHIC_DUMMIES if d[0] in xs)
    return f"""d AS (SELECT *, {dummies} FROM resp WHERE year IN {in_list(S.DEMOGRAPHIC_LOGIT_YEARS)} AND {_all_nn(S.COMPLETE_CASE_FULL)}),
long AS ({union_long('d', ['year', 'weight', *xs], S.CORE_ITEMS, 'item', 'y')}),
{_cells('long', ['year', 'item'], xs)},
{_newton(['year', 'item'], len(xs) + 1)},
{_coefficients(['year', 'item'], ['(Intercept)', *xs])}"""


def _order(terms) -> str:
    return case_map("term", {t: i for i, t in enumerate(terms)})


def logit_coefficients() -> str:
    terms = S.DEMOGRAPHIC_TERM_LABELS
    return _recursive(with_resp(f"""SELECT year, {case_map('item', S.ITEM_LABELS)} AS model, term, {case_map('term', terms)} AS label,
  {_order(terms)} AS term_order, {_r3('est', 'Estimate')}, {_r3('se', 'Std_Error')}, {_r3('p', 'p_value')}, 'ok' AS status FROM coef""",
                                _demographic_ctes()))


def logit_tables_wide() -> str:
    terms = S.DEMOGRAPHIC_TERM_LABELS
    cols = ", ".join(_r3(f"max(CASE WHEN item = {q(i)} THEN {e} END)", f"{S.ITEM_LABELS[i]}__{name}")
                     for i in S.CORE_ITEMS for e, name in (("est", "Estimate"), ("se", "Std_Error")))
    return _recursive(with_resp(f"SELECT year, {case_map('term', terms)} AS label, {_order(terms)} AS term_order, {cols} "
                                "FROM coef GROUP BY year, term", _demographic_ctes()))


def logit_table_2008() -> str:
    """The education dummies add up to the intercept: the last of them in column order (nohs) has no estimate."""
    raw, _ = _standin_sql("spae_2008")
    raw = raw.replace(" FROM resp", ", CASE WHEN caseid % 4 = 0 THEN 'phone' ELSE 'internet' END AS mode FROM resp", 1)
    answers = ", ".join(f"CASE WHEN {i} IN {in_list(S.RAW2008_TEXT_ONE)} THEN 1.0 WHEN {i} IN {in_list(S.RAW2008_TEXT_ZERO)} THEN 0.0 END AS {i}"
                        for i in S.RAW2008_ITEMS)

    def grouped(col, groups):
        return "CASE " + " ".join(f"WHEN {col} IN {in_list(v)} THEN {q(t)}" for t, v in groups) + f" END AS {col}"

    xs = [x for x in S.RAW2008_PREDICTORS if x != "nohs"]
    dummies = ", ".join(f"CAST({ident(c)} = {q(v)} AS DOUBLE) AS {name}" for name, c, v in S.RAW2008_DUMMIES if name in xs)
    keep = " AND ".join([*[f"{i} IS NOT NULL" for i in (*S.RAW2008_ITEMS, "gender", "race", "educ", "pid3")],
                         f"gender NOT IN {in_list(S.RAW2008_GENDER_DROP)}", f"pid3 NOT IN {in_list(S.RAW2008_PARTY_DROP)}"])
    terms = S.RAW2008_TERM_LABELS
    cols = ", ".join(_r3(f"max(CASE WHEN item = {q(i)} THEN {e} END)", f"{prefix}_{name}")
                     for i, name in S.RAW2008_MODEL_NAMES.items() for e, prefix in (("est", "Estimate"), ("se", "SE")))
    ctes = f"""raw AS ({raw}),
r1 AS (SELECT caseid, weight, mode, gender, pid3, birthyr, {answers}, {grouped('race', S.RAW2008_RACE)}, {grouped('educ', S.RAW2008_EDUC)} FROM raw),
d AS (SELECT weight, birthyr, {', '.join(S.RAW2008_ITEMS)}, {dummies} FROM r1 WHERE {keep}),
long AS ({union_long('d', ['weight', *xs], S.RAW2008_ITEMS, 'item', 'y')}),
{_cells('long', ['item'], xs)},
{_newton(['item'], len(xs) + 1)},
{_coefficients(['item'], ['(Intercept)', *xs])},
every AS (SELECT * FROM (SELECT item, term, est, se FROM coef UNION ALL SELECT item, 'nohs', NULL, NULL FROM fit))"""
    return _recursive(with_resp(f"SELECT {case_map('term', terms)} AS label, term, {_order(terms)} AS term_order, {cols} "
                                "FROM every GROUP BY term", ctes))


# ----------------------------------------------------------------------------
# Principal components: cyclic Jacobi rotations of the correlation matrix
# ----------------------------------------------------------------------------

JACOBI_SWEEPS = 12


def _pca_ctes() -> str:
    items = S.CORE_ITEMS
    n = len(items)
    nn = _all_nn(items)
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    corr = ", ".join("CAST(1 AS DOUBLE)" if i == j else f"corr({ident(items[i])}, {ident(items[j])})" for i in range(n) for j in range(n))
    eye = ", ".join(f"CAST({int(i == j)} AS DOUBLE)" for i in range(n) for j in range(n))
    at_p = f"[{', '.join(str(p) for p, _ in pairs)}][k % {len(pairs)} + 1]"
    at_q = f"[{', '.join(str(r) for _, r in pairs)}][k % {len(pairs)} + 1]"
    row, col = f"((t - 1) // {n} + 1)", f"((t - 1) % {n} + 1)"

    def cell(m, i, j):
        return f"{m}[({i} - 1) * {n} + {j}]"

    turned = lambda m: (f"list_transform(range(1, {n * n + 1}), lambda t: CASE WHEN {col} = p THEN c * {cell(m, row, 'p')} - s * {cell(m, row, 'q')} "
                        f"WHEN {col} = q THEN s * {cell(m, row, 'p')} + c * {cell(m, row, 'q')} ELSE {m}[t] END)")
    sides = (f"list_transform(range(1, {n * n + 1}), lambda t: CASE WHEN {row} = p THEN c * {cell('m', 'p', col)} - s * {cell('m', 'q', col)} "
             f"WHEN {row} = q THEN s * {cell('m', 'p', col)} + c * {cell('m', 'q', col)} ELSE m[t] END)")
    step = f"""SELECT k + 1, {sides}, v FROM (SELECT k, p, q, c, s, {turned('a')} AS m, {turned('v')} AS v FROM (
  SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (SELECT *, CASE WHEN apq = 0 THEN 0 ELSE
    (CASE WHEN th < 0 THEN -1 ELSE 1 END) / (abs(th) + sqrt(1 + th * th)) END AS t FROM (
    SELECT *, CASE WHEN apq = 0 THEN 0 ELSE ({cell('a', 'q', 'q')} - {cell('a', 'p', 'p')}) / (2 * apq) END AS th FROM (
      SELECT *, {cell('a', 'p', 'q')} AS apq FROM (SELECT *, {at_p} AS p, {at_q} AS q FROM jac WHERE k < {JACOBI_SWEEPS * len(pairs)}))))))"""
    comps = " UNION ALL ".join(f"SELECT a[{(j - 1) * n + j}] AS value, [{', '.join(f'v[{(i - 1) * n + j}]' for i in range(1, n + 1))}] AS vec FROM last"
                               for j in range(1, n + 1))
    return f"""d AS (SELECT caseid, year, {', '.join(ident(c) for c in items)} FROM resp WHERE year >= 2012 AND {nn}),
jac(k, a, v) AS (SELECT 0, [{corr}], [{eye}] FROM d UNION ALL {step}),
last AS (SELECT * FROM jac WHERE k = {JACOBI_SWEEPS * len(pairs)}),
comps AS ({comps}),
tops AS (SELECT *, list_max(list_transform(vec, lambda x: abs(x))) AS top FROM comps),
signed AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS nr, list_transform(vec, lambda x: x *
  CASE WHEN list_filter(vec, lambda y: abs(y) = top)[1] < 0 THEN -1 ELSE 1 END) AS vec FROM tops)"""


def pca_loadings() -> str:
    n = len(S.CORE_ITEMS)
    names = ", ".join(q(c) for c in S.CORE_ITEMS)
    return _recursive(with_resp(f"""SELECT [{names}][i] AS variable, 'PC' || nr AS component, CAST(nr AS INT) AS component_index,
  {r6('vec[i]', 'loading')}, {r6('sqrt(greatest(value, 0))', 'sdev')}, {r6('value / (SELECT sum(value) FROM signed)', 'variance_share')}
FROM signed, range(1, {n + 1}) r(i)""", _pca_ctes()))


def pca_scores() -> str:
    items = S.CORE_ITEMS
    stats = ", ".join(f"avg({ident(c)}) AS m{i}, stddev_samp({ident(c)}) AS s{i}" for i, c in enumerate(items))
    z = ", ".join(f"({ident(c)} - m{i}) / s{i}" for i, c in enumerate(items))
    vecs = ", ".join(f"max(CASE WHEN nr = {j + 1} THEN vec END) AS v{j + 1}" for j in range(len(items)))
    scores = ", ".join(r6(f"list_dot_product([{z}], v{j + 1})", f"PC{j + 1}") for j in range(len(items)))
    return _recursive(with_resp(f"SELECT caseid, year, {scores} FROM d, stats, turn",
                                f"{_pca_ctes()},\nstats AS (SELECT {stats} FROM d),\nturn AS (SELECT {vecs} FROM signed)"))


MODEL_ORACLES = {f.__name__: f for f in (party_effects, party_effect_trend, logit_coefficients, logit_tables_wide, logit_table_2008,
                                         pca_loadings, pca_scores)}
