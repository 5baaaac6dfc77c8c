"""DuckDB oracle SQL for the registered queries.

Each statement runs on the driver's pre-registered table views and restates
the product in plain SQL, independent of the Spark code.  Doubles are rounded
to 6 decimals on both sides.
"""

from __future__ import annotations

from wavestat import study as S
from wavestat.plans.sqltext import case_in, case_map, ident, in_list, q, r6, union_long

# The respondent adapter (same column rules as sources/respondents.py).
RESPONDENTS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS caseid,
       CAST(CASE year(l_shipdate) WHEN 1995 THEN 2008 WHEN 1996 THEN 2012 WHEN 1997 THEN 2014
            WHEN 1998 THEN 2016 WHEN 1999 THEN 2020 WHEN 2000 THEN 2022 ELSE 2024 END AS INT) AS year,
       CAST((l_quantity + 10) / 35 AS DOUBLE) AS weight,
       CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_discount > 0.055 THEN 1 ELSE 0 END AS DOUBLE) AS voting_more_than_once,
       CAST(CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_tax > 0.045 THEN 1 ELSE 0 END AS DOUBLE) AS ballot_tampering,
       CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END AS DOUBLE) AS impersonation,
       CAST(CASE WHEN year(l_shipdate) = 1995 OR l_suppkey % 11 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS non_citizen_voting,
       CAST(CASE WHEN year(l_shipdate) = 1995 OR l_suppkey % 13 = 0 THEN NULL WHEN l_discount + l_tax > 0.095 THEN 1 ELSE 0 END AS DOUBLE) AS mail_ballot_fraud,
       CAST(CASE WHEN year(l_shipdate) = 1995 OR l_suppkey % 17 = 0 THEN NULL WHEN l_extendedprice > 60000 THEN 1 ELSE 0 END AS DOUBLE) AS officials_changing_results,
       CAST(CASE WHEN year(l_shipdate) < 2000 THEN NULL WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS DOUBLE) AS vote_counting_software,
       CAST(CASE WHEN year(l_shipdate) < 2000 THEN NULL WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS DOUBLE) AS paid_to_vote,
       CAST(CASE WHEN year(l_shipdate) < 2000 THEN NULL WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS fraudulent_registration,
       CAST(CASE WHEN year(l_shipdate) < 2000 THEN NULL WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS drop_box_fraud,
       CASE l_suppkey % 6 WHEN 0 THEN 'VERY CONFIDENT' WHEN 1 THEN 'SOMEWHAT CONFIDENT' WHEN 2 THEN 'NOT TOO CONFIDENT'
            WHEN 3 THEN 'NOT AT ALL CONFIDENT' WHEN 4 THEN 'I DON''T KNOW' ELSE NULL END AS confidence,
       CAST(1930 + l_partkey % 75 AS INT) AS birth_year,
       CASE l_linestatus WHEN 'F' THEN 'FEMALE' ELSE 'MALE' END AS gender,
       CASE l_partkey % 7 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'HISPANIC' WHEN 2 THEN 'ASIAN' WHEN 3 THEN 'MIXED' WHEN 4 THEN NULL ELSE 'WHITE' END AS race,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'NO HS' WHEN '2-HIGH' THEN 'HS GRAD' WHEN '3-MEDIUM' THEN '2-YEAR'
            WHEN '4-NOT SPECIFIED' THEN '4-YEAR DEGREE' ELSE 'POST-GRAD' END AS education,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DEMOCRAT' WHEN 'BUILDING' THEN 'REPUBLICAN' WHEN 'FURNITURE' THEN 'INDEPENDENT' ELSE NULL END AS party,
       upper(n_name) AS state,
       CASE l_suppkey % 5 WHEN 0 THEN 'VERY LIBERAL' WHEN 1 THEN 'LIBERAL' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'CONSERVATIVE' ELSE 'VERY CONSERVATIVE' END AS ideology
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def with_resp(body: str, extra_ctes: str = "") -> str:
    ctes = f"resp AS ({RESPONDENTS_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def _pct_label(share: str) -> str:
    """Whole-percent label, half-to-even, e.g. '12%'."""
    return f"(CAST(CAST(round_even(CAST({share} AS DOUBLE) * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


def belief_share_by_item() -> str:
    items = S.FRAUD_ITEMS
    long = union_long("resp", ["weight"], items, "fraud_type", "value")
    ctes = f"""long AS ({long}),
agg AS (
  SELECT fraud_type,
         CASE WHEN value = 1 THEN 'Belief in Fraud' ELSE 'No Belief in Fraud' END AS belief,
         coalesce(sum(weight), 0) AS weighted_n
  FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT *, weighted_n / sum(weighted_n) OVER (PARTITION BY fraud_type) AS proportion FROM agg)"""
    body = f"""SELECT fraud_type, {case_map('fraud_type', S.SHARE_LABELS)} AS fraud_label, belief,
  {r6('weighted_n', 'weighted_n')}, {r6('proportion', 'proportion')}, {_pct_label('proportion')} AS label,
  {r6("max(CASE WHEN belief = 'Belief in Fraud' THEN proportion END) OVER (PARTITION BY fraud_type)",
      'belief_proportion')}
FROM sh"""
    return with_resp(body, ctes)


def _party_label_sql(col: str = "party") -> str:
    whens = " ".join(f"WHEN {col} = {q(k)} THEN {q(v)}" for k, v in S.PARTY_LABELS.items())
    return f"(CASE WHEN {col} IS NULL THEN NULL {whens} ELSE {q(S.OTHER_MISSING)} END)"


def _belief_by_party(where: str) -> str:
    items = S.CORE_ITEMS
    parties = list(S.PARTY_LABELS.values())
    long = union_long("d", ["party_label", "weight"], items, "fraud_key", "value")
    ctes = f"""d AS (SELECT *, {_party_label_sql()} AS party_label FROM resp WHERE {where}),
long AS ({long}),
lab AS (SELECT fraud_key, party_label, weight,
               CASE WHEN value = 1 THEN 'Common' WHEN value = 0 THEN 'Not Common' END AS belief
        FROM long WHERE value IS NOT NULL AND party_label IN {in_list(parties)}),
agg AS (SELECT fraud_key, party_label, belief, coalesce(sum(weight), 0) AS weighted_n
        FROM lab WHERE belief IS NOT NULL GROUP BY 1, 2, 3)"""
    body = f"""SELECT {case_map('fraud_key', S.ITEM_LABELS)} AS fraud_type, party_label, belief,
  {r6('weighted_n', 'weighted_n')},
  {r6('weighted_n / sum(weighted_n) OVER (PARTITION BY fraud_key, party_label)', 'percentage')},
  (regexp_replace(CAST(round_even(weighted_n / sum(weighted_n) OVER (PARTITION BY fraud_key, party_label) * 100, 1)
                       AS VARCHAR), '\\.0$', '') || '%') AS label
FROM agg"""
    return with_resp(body, ctes)


def belief_share_by_party_year() -> str:
    return _belief_by_party("year = 2024")


def belief_share_by_party_pooled() -> str:
    return _belief_by_party("year BETWEEN 2012 AND 2024 AND weight IS NOT NULL")


def _sum_items(items) -> str:
    return " + ".join(ident(c) for c in items)


def _not_dk(col: str) -> str:
    return " AND ".join(f"NOT coalesce(regexp_matches({col}, {q('(?i)' + p)}), false)"
                        for p in S.DONT_KNOW_PATTERNS)


def _conf_label(col: str) -> str:
    return case_map(col, dict(zip(S.CONFIDENCE_LEVELS, S.CONFIDENCE_LABELS)))


def count_by_confidence() -> str:
    items = S.CORE_ITEMS
    nn = " AND ".join(f"{ident(c)} IS NOT NULL" for c in ["year", *items, "confidence"])
    ctes = f"""d AS (SELECT * FROM resp WHERE year >= 2012 AND {_not_dk('confidence')} AND {nn}),
c AS (SELECT {_conf_label('confidence')} AS confidence, CAST({_sum_items(items)} AS INTEGER) AS fraud_count FROM d),
agg AS (SELECT confidence, fraud_count, count(*) AS n FROM c GROUP BY 1, 2)"""
    body = f"""SELECT confidence, fraud_count, n,
  {r6('n / sum(n) OVER (PARTITION BY confidence)', 'prop')},
  {_pct_label('n / sum(n) OVER (PARTITION BY confidence)')} AS label FROM agg"""
    return with_resp(body, ctes)


def count_by_confidence_party() -> str:
    items = S.CORE_ITEMS
    nn = " AND ".join(f"{ident(c)} IS NOT NULL" for c in ["year", "party", *items, "confidence"])
    title = "(upper(substr(party, 1, 1)) || lower(substr(party, 2)))"
    ctes = f"""d AS (SELECT * FROM resp WHERE year >= 2012 AND {_not_dk('confidence')} AND {nn}),
c AS (SELECT CASE WHEN {title} IN {in_list(S.PARTY_TITLE_LEVELS)} THEN {title} END AS party,
             {_conf_label('confidence')} AS confidence,
             CAST({_sum_items(items)} AS INTEGER) AS fraud_count FROM d),
agg AS (SELECT party, confidence, fraud_count, count(*) AS n FROM c GROUP BY 1, 2, 3)"""
    body = f"""SELECT party, confidence, fraud_count, n,
  {r6('n / sum(n) OVER (PARTITION BY party, confidence)', 'prop')},
  {_pct_label('n / sum(n) OVER (PARTITION BY party, confidence)')} AS label FROM agg"""
    return with_resp(body, ctes)


def confidence_crosstab() -> str:
    items = S.CORE_ITEMS
    cnt = " + ".join(f"coalesce(CAST({ident(c)} = 1 AS INTEGER), 0)" for c in items)
    nas = " + ".join(f"CAST({ident(c)} IS NULL AS INTEGER)" for c in items)
    order = case_map("confidence", {lev: i for i, lev in enumerate(S.CONFIDENCE_LEVELS)})
    ctes = f"""c AS (SELECT {cnt} AS fraud_count, {nas} AS fraud_any_na, confidence FROM resp),
f AS (SELECT {_conf_label('confidence')} AS "Confidence", {order} AS confidence_order, fraud_count
      FROM c WHERE fraud_any_na = 0 AND confidence IN {in_list(S.CONFIDENCE_LEVELS)})"""
    counts = ", ".join(f'count(*) FILTER (WHERE fraud_count = {k}) AS "{k}"' for k in range(len(items) + 1))
    body = f'SELECT "Confidence", confidence_order, {counts} FROM f GROUP BY 1, 2'
    return with_resp(body, ctes)


def _pct_tenths(count: str, total: str) -> str:
    num = f"(({count}) * 1000)"
    qq = f"({num} // ({total}))"
    rr = f"({num} % ({total}))"
    up = f"(CASE WHEN 2 * {rr} > ({total}) OR (2 * {rr} = ({total}) AND {qq} % 2 = 1) THEN 1 ELSE 0 END)"
    t = f"({qq} + {up})"
    return f"(CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%')"


def _null_long() -> str:
    items = S.CORE_ITEMS
    nn = ", ".join(f"count({ident(c)}) AS {ident('nn__' + c)}" for c in items)
    parts = [f"SELECT year, total, {q(c)} AS item, {ident('nn__' + c)} AS non_null FROM agg" for c in items]
    return f"""agg AS (SELECT year, count(*) AS total, {nn} FROM resp GROUP BY year),
long AS ({' UNION ALL '.join(parts)})"""


def null_rate_by_item_year() -> str:
    ctes = _null_long() + f""",
l2 AS (SELECT year, {case_map('item', S.ITEM_LABELS)} AS "Question",
       format('{{:,}}', total - non_null) || ' (' || {_pct_tenths('total - non_null', 'total')} || ')' AS combined_val
       FROM long)"""
    cols = ", ".join(f'max(CASE WHEN year = {y} THEN combined_val END) AS "{y}"' for y in S.SURVEY_YEARS)
    order = case_map('"Question"', {lab: i for i, lab in enumerate(S.TABLE_ITEM_ORDER)})
    body = f'SELECT "Question", {cols}, {order} AS question_order FROM l2 GROUP BY "Question"'
    return with_resp(body, ctes)


def null_counts_by_item_year() -> str:
    body = f"""SELECT year, {case_map('item', S.ITEM_LABELS)} AS "Question", total,
  total - non_null AS na_count, {r6('(total - non_null) / total', 'na_prop')} FROM long"""
    return with_resp(body, _null_long())


def demographics_percent() -> str:
    def rec(col, mapping):
        return case_in(f"upper(CAST({col} AS VARCHAR))", mapping)
    age = "(CAST(year AS DOUBLE) - TRY_CAST(CAST(birth_year AS VARCHAR) AS DOUBLE))"
    bins = " ".join(f"WHEN {age} >= {lo} AND {age} <= {hi} THEN {q(lab)}" for lo, hi, lab in S.AGE_BINS_TABLE)
    bins += f" WHEN {age} >= {S.AGE_TABLE_TOP[0]} THEN {q(S.AGE_TABLE_TOP[1])}"
    cols = [c for _, c, _ in S.DEMO_SECTIONS]
    ctes = f"""d AS (SELECT TRY_CAST(CAST(weight AS VARCHAR) AS DOUBLE) AS weight,
       CASE {bins} ELSE NULL END AS age_group,
       {rec('gender', S.DEMO_GENDER)} AS gender_clean,
       {rec('education', S.DEMO_EDUCATION)} AS educ_clean,
       {rec('party', S.DEMO_PARTY)} AS party_clean,
       {rec('ideology', S.DEMO_IDEOLOGY)} AS ideo_clean FROM resp),
long AS ({union_long('d', ['weight'], cols, 'variable', 'feature')}),
agg AS (SELECT variable, feature, count(*) AS n_unweighted, coalesce(sum(weight), 0) AS n_weighted
        FROM long WHERE feature IS NOT NULL GROUP BY 1, 2)"""
    section = case_map("variable", {c: s for s, c, _ in S.DEMO_SECTIONS})
    sorder = case_map("variable", {c: i for i, (_, c, _) in enumerate(S.DEMO_SECTIONS)})
    lorder = " ".join(f"WHEN variable = {q(c)} AND feature = {q(lev)} THEN {li}"
                      for _, c, levels in S.DEMO_SECTIONS for li, lev in enumerate(levels))
    body = f"""SELECT {section} AS section, feature, n_unweighted, {r6('n_weighted', 'n_weighted')},
  {r6('100.0 * n_unweighted / sum(n_unweighted) OVER (PARTITION BY variable)', 'unweighted_pct')},
  {r6('100.0 * n_weighted / sum(n_weighted) OVER (PARTITION BY variable)', 'weighted_pct')},
  {sorder} AS section_order, (CASE {lorder} ELSE NULL END) AS level_order
FROM agg"""
    return with_resp(body, ctes)


def availability_matrix() -> str:
    items = S.FRAUD_ITEMS
    cnt = ", ".join(f"count({ident(c)}) AS {ident(c)}" for c in items)
    ctes = f"""py AS (SELECT year, {cnt} FROM resp GROUP BY year),
long AS ({union_long('py', ['year'], items, 'item', 'n_answers')})"""
    mark = q(S.CHECK_MARK)
    cols = ", ".join(
        f"CASE WHEN coalesce(bool_or(CASE WHEN year = {y} THEN n_answers > 0 END), false) "
        f"THEN {mark} ELSE '' END AS {ident(str(y))}" for y in S.SURVEY_YEARS)
    body = f"SELECT item, {case_map('item', S.SHARE_LABELS)} AS question, {cols} FROM long GROUP BY item"
    return with_resp(body, ctes)


def _all_nn(cols) -> str:
    return "(" + " AND ".join(f"{ident(c)} IS NOT NULL" for c in cols) + ")"


def complete_case_by_wave() -> str:
    cols = ["caseid", "year", "weight", *S.CORE_ITEMS, "education", "race", "party"]
    body = f"""SELECT {', '.join(ident(c) for c in cols)} FROM resp
WHERE CASE WHEN year = 2008 THEN {_all_nn(S.COMPLETE_CASE_2008)} ELSE {_all_nn(S.COMPLETE_CASE_FULL)} END"""
    return with_resp(body)


def swing_values_sql(sets_by_year) -> str:
    rows = ", ".join(f"({y}, {q(s)})" for y, ss in sets_by_year.items() for s in ss)
    return f"SELECT DISTINCT * FROM (VALUES {rows}) t(year, state)"


def _dummy_sql(name, col, values, form) -> str:
    if form == "eq":
        return f"CAST({ident(col)} = {q(values[0])} AS DOUBLE) AS {ident(name)}"
    return f"CAST(coalesce({ident(col)} IN {in_list(values)}, false) AS DOUBLE) AS {ident(name)}"


def dummy_design() -> str:
    from wavestat.sources.respondents import ADAPTER_SWING_BY_YEAR
    dummies = ", ".join(_dummy_sql(*d) for d in S.DEMOGRAPHIC_DUMMIES)
    ctes = f"""sw AS ({swing_values_sql(ADAPTER_SWING_BY_YEAR)}),
d AS (SELECT r.*, CASE WHEN s.year IS NOT NULL THEN 1.0 ELSE 0.0 END AS swing_state
      FROM resp r LEFT JOIN sw s ON r.year = s.year AND r.state = s.state)"""
    body = f"""SELECT caseid, year, {dummies},
  CAST(party = 'REPUBLICAN' AS DOUBLE) AS rep_party, CAST(party = 'DEMOCRAT' AS DOUBLE) AS dem_party,
  CAST(swing_state AS DOUBLE) AS swing_state FROM d"""
    return with_resp(body, ctes)


def correlation_matrix() -> str:
    cols = S.FRAUD_ITEMS + ["birth_year"]
    names = []
    for c in cols:
        new = c
        for old, lab in S.CORRELATION_RENAMES:
            new = new.replace(old, lab)
        names.append(new)
    aggs = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            x, y = f"CAST({ident(cols[i])} AS DOUBLE)", f"CAST({ident(cols[j])} AS DOUBLE)"
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            k = f"p{i}_{j}"
            aggs += [f"covar_samp(CASE WHEN {both} THEN {x} END, CASE WHEN {both} THEN {y} END) AS {k}_c",
                     f"var_samp(CASE WHEN {both} THEN {x} END) AS {k}_vx",
                     f"var_samp(CASE WHEN {both} THEN {y} END) AS {k}_vy"]
    parts = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            k = f"p{min(i, j)}_{max(i, j)}"
            r = f"CASE WHEN {k}_vx * {k}_vy > 0 THEN {k}_c / sqrt({k}_vx * {k}_vy) END"
            parts.append(f"SELECT {q(names[i])} AS row_var, {q(names[j])} AS col_var, {r6(r, 'r')} FROM m")
    ctes = f"m AS (SELECT {', '.join(aggs)} FROM resp)"
    return with_resp("\nUNION ALL\n".join(parts), ctes)


def domain_mean_ci() -> str:
    items = S.CORE_ITEMS
    out = "not_confident_vote_counted"
    conf = "upper(trim(CAST(confidence AS VARCHAR)))"
    ctes = f"""d AS (SELECT *, CASE WHEN {conf} IN {in_list(S.NOT_CONFIDENT)} THEN 1.0
                           WHEN {conf} IN {in_list(S.CONFIDENT)} THEN 0.0 END AS {out},
                CASE party WHEN 'DEMOCRAT' THEN 'Democrat' WHEN 'REPUBLICAN' THEN 'Republican' END AS party_label
         FROM resp WHERE year IN {in_list(S.SURVEY_YEARS)} AND party IN ('DEMOCRAT', 'REPUBLICAN')),
long AS ({union_long('d', ['year', 'party_label', 'weight'], items + [out], 'fraud_type', 'y', 'DOUBLE')}),
l2 AS (SELECT * FROM long WHERE NOT (year = 2008 AND fraud_type IN {in_list(S.ITEMS_NOT_IN_2008)})),
agg AS (SELECT year, fraud_type, party_label, count(*) AS n_rows, count(y) AS n_obs,
               sum(CASE WHEN y IS NOT NULL THEN weight END) AS sw, sum(weight * y) AS swy,
               sum(CASE WHEN y IS NOT NULL THEN weight * weight END) AS sw2,
               sum(weight * weight * y) AS sw2y, sum(weight * weight * y * y) AS sw2yy
        FROM l2 GROUP BY 1, 2, 3),
e AS (SELECT *, CAST(sum(n_rows) OVER (PARTITION BY year, fraud_type) AS BIGINT) AS n, swy / sw AS m
       FROM agg WHERE n_obs > 0),
e2 AS (SELECT *, sqrt(n / (n - 1) * greatest(sw2yy - 2 * m * sw2y + m * m * sw2, 0) / (sw * sw)) AS se FROM e)"""
    lo = "greatest(0, m - 1.96 * se)"
    hi = "least(1, m + 1.96 * se)"
    body = f"""SELECT year, fraud_type, {case_map('fraud_type', S.ITEM_LABELS)} AS fraud_label, party_label,
  {r6('m', 'proportion')}, {r6('se', 'std_error')}, {r6(lo, 'ci_lower')}, {r6(hi, 'ci_upper')},
  {r6('m * 100', 'percentage')}, {r6(lo + ' * 100', 'ci_lower_pct')}, {r6(hi + ' * 100', 'ci_upper_pct')},
  n, n_obs FROM e2"""
    return with_resp(body, ctes)


def _swing_effect_ctes() -> str:
    from wavestat.sources.respondents import ADAPTER_SWING_BY_YEAR
    items = S.CORE_ITEMS
    sums = []
    for g in (0, 1):
        wg = f"CASE WHEN s = {g} THEN weight END"
        sums += [f"count(*) FILTER (WHERE s = {g}) AS n{g}", f"sum({wg}) AS sw{g}", f"sum({wg} * y) AS swy{g}",
                 f"sum({wg} * {wg}) AS sw2{g}", f"sum({wg} * {wg} * y) AS sw2y{g}",
                 f"sum({wg} * {wg} * y * y) AS sw2yy{g}"]
    return f"""sw AS ({swing_values_sql(ADAPTER_SWING_BY_YEAR)}),
d AS (SELECT r.*, CASE WHEN sw.year IS NOT NULL THEN 1.0 ELSE 0.0 END AS s
      FROM resp r LEFT JOIN sw ON r.year = sw.year AND r.state = sw.state),
long AS ({union_long('d', ['year', 's', 'weight'], items, 'item', 'y', 'DOUBLE')}),
agg AS (SELECT year, item, {', '.join(sums)} FROM long WHERE y IS NOT NULL GROUP BY 1, 2),
a1 AS (SELECT *, CAST(n0 + n1 AS DOUBLE) AS n, swy0 / sw0 AS p0, swy1 / sw1 AS p1 FROM agg WHERE n0 > 0 AND n1 > 0),
a2 AS (SELECT *, p0 * (1 - p0) AS v0, p1 * (1 - p1) AS v1 FROM a1),
a3 AS (SELECT *, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS beta,
              n / (n - 1) * greatest(sw2yy0 - 2 * p0 * sw2y0 + p0 * p0 * sw20, 0) / ((sw0 * v0) * (sw0 * v0)) AS ve0,
              n / (n - 1) * greatest(sw2yy1 - 2 * p1 * sw2y1 + p1 * p1 * sw21, 0) / ((sw1 * v1) * (sw1 * v1)) AS ve1,
              (n0 * v0 + n1 * v1) / n AS m
       FROM a2 WHERE v0 > 0 AND v1 > 0),
a4 AS (SELECT *, beta * m AS est,
              sqrt(power(-m + beta * (n0 / n) * v0 * (1 - 2 * p0), 2) * ve0
                   + power(m + beta * (n1 / n) * v1 * (1 - 2 * p1), 2) * ve1) AS se
       FROM a3)"""


def swing_effect() -> str:
    body = f"""SELECT year, item, {case_map('item', S.EFFECT_LABELS)} AS fraud_label, {q(S.SWING_GROUP)} AS "group",
  'swing_states' AS term, {r6('est', 'estimate')}, {r6('se', 'std_error')},
  {r6('est - 1.96 * se', 'ci_lower')}, {r6('est + 1.96 * se', 'ci_upper')},
  {r6('beta', 'beta')}, {r6('sqrt(ve0 + ve1)', 'beta_se')}, {r6('p0', 'p0')}, {r6('p1', 'p1')},
  CAST(n AS BIGINT) AS n, n0, n1,
  CASE WHEN least(n0, n1) < 5 THEN 'small_cell' ELSE 'ok' END AS status
FROM a4 WHERE est IS NOT NULL AND se IS NOT NULL"""
    return with_resp(body, _swing_effect_ctes())


def effect_trend() -> str:
    idx = case_map("year", {y: i + 1 for i, y in enumerate(S.SURVEY_YEARS)})
    body = f"""SELECT item, 'swing_states' AS term, {r6(f'regr_slope(est, {idx})', 'slope')},
  {r6(f'regr_intercept(est, {idx})', 'intercept')}, CAST(regr_count(est, {idx}) AS BIGINT) AS n_points
FROM a4 WHERE est IS NOT NULL AND se IS NOT NULL GROUP BY item"""
    return with_resp(body, _swing_effect_ctes())


def response_patterns() -> str:
    items = S.CORE_ITEMS
    dummies = ""
    where = f"year = 2024 AND {_all_nn(S.COMPLETE_CASE_FULL)}"
    cols = ", ".join(ident(c) for c in items)
    return with_resp(f"SELECT {cols}, count(*) AS n FROM resp WHERE {where} GROUP BY {cols}")


# ---------------------------------------------------------------------------
# Harmonisation: stand-in raw waves (same encodings as sources/standin.py)
# and the harmonise rules, restated in SQL.
# ---------------------------------------------------------------------------

def _pick_sql(options, k: str = "caseid") -> str:
    whens = " ".join(f"WHEN {i} THEN {'NULL' if o is None else (q(o) if isinstance(o, str) else repr(o))}"
                     for i, o in enumerate(options))
    return f"(CASE ({k} % {len(options)}) {whens} END)"


def _map_sql(expr: str, mapping: dict, default="NULL") -> str:
    whens = " ".join(f"WHEN {expr} = {q(k)} THEN {q(v) if isinstance(v, str) else repr(v)}"
                     for k, v in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


def _standin_sql(key: str):
    from wavestat.sources import standin as W
    year, sources = S.WAVE_MANIFEST[key]
    st = W.WAVE_STYLE[key]
    lower = st.get("lower", False)

    def txt(c):
        return f"lower({c})" if lower else c

    def item(c):
        if st["items"] == "codes":
            return (f"CAST(CASE WHEN {c} = 1 THEN {_pick_sql([1.0, 2.0])} WHEN {c} = 0 THEN {_pick_sql([3.0, 4.0])} "
                    f"ELSE {_pick_sql(W.MISSING_CODES)} END AS DOUBLE)", "double")
        t = (f"(CASE WHEN {c} = 1 THEN {_pick_sql(W.ONE_TEXT)} WHEN {c} = 0 THEN {_pick_sql(W.ZERO_TEXT)} "
             f"ELSE {_pick_sql(W.MISSING_TEXT)} END)")
        if st["items"] == "text_lower":
            return f"lower({t})", "text"
        if st["items"] == "text_mixed":
            # initcap of the fixed phrases: first letter of each word upper, rest lower
            return (" (CASE " + " ".join(
                f"WHEN {t} = {q(o)} THEN {q(' '.join(w[:1].upper() + w[1:].lower() for w in o.split(' ')))}"
                for o in W.ONE_TEXT + W.ZERO_TEXT + [x for x in W.MISSING_TEXT if x]) + " END)"), "text"
        return t, "text"

    enc = {
        "caseid": ("caseid", "long"),
        "weight": ("weight", "double"),
        "confidence": (txt("confidence"), "text"),
        "birth_year": (("CAST(birth_year AS VARCHAR)", "text") if st.get("birth_text")
                       else ("CAST(birth_year AS DOUBLE)", "double") if lower else ("birth_year", "int")),
        "gender": (txt("gender"), "text"),
        "race": (("coalesce(race, '9')", "text") if st.get("race_code9") else (txt("race"), "text")),
        "education": ((_map_sql("education", W.EDUCATION_2008), "text") if lower else ("education", "text")),
        "party": ((_map_sql("party", W.PARTY_CODES, "4.0"), "double") if st["party"] == "codes"
                  else (f"coalesce({txt('party')}, {q('not sure' if lower else 'NOT SURE')})", "text")),
        "zip_code": ("lpad(CAST(caseid % 99991 AS VARCHAR), 5, '0')", "text"),
        "county": ("CASE WHEN caseid % 10 = 0 THEN NULL ELSE 'county ' || CAST(caseid % 50 AS VARCHAR) END", "text"),
        "state": (("CAST(CAST(regexp_extract(state, '(\\d+)$', 1) AS INTEGER) AS DOUBLE)", "double")
                  if st["state"] == "fips_code" else (txt("state"), "text")),
        "time_lived_in_residence": (("CAST(caseid % 40 AS DOUBLE)", "double") if lower else
                                    ("CASE WHEN caseid % 9 = 0 THEN '-8' ELSE CAST(caseid % 40 AS VARCHAR) END",
                                     "text")),
        "ideology": (txt("ideology"), "text"),
        "voted": (_pick_sql(["YES", "NO", "-9"]), "text"),
    }
    for it in S.FRAUD_ITEMS:
        enc[it] = item(it)
    if st.get("codebook"):
        for col, codes in W.CODES_2022.items():
            enc[col] = (f"CAST({_map_sql(col, codes, '-9.0')} AS DOUBLE)", "double")
    cols, types = [], {}
    for target, src in zip(S.HARMONISED_COLUMNS, sources):
        if src != S.NOT_ASKED:
            e, t = enc[target]
            cols.append(f"{e} AS {ident(src)}")
            types[target] = (src, t)
    return f"SELECT {', '.join(cols)} FROM resp WHERE year = {year}", types


def _code_text_sql(col: str, t: str) -> str:
    if t == "double":
        return (f"(CASE WHEN {col} = floor({col}) AND abs({col}) < 9.0e15 "
                f"THEN CAST(CAST({col} AS BIGINT) AS VARCHAR) ELSE CAST({col} AS VARCHAR) END)")
    if t in ("int", "long"):
        return f"CAST({col} AS VARCHAR)"
    return col


def _harmonize_sql(key: str, codes_one, codes_zero) -> str:
    year, sources = S.WAVE_MANIFEST[key]
    raw, types = _standin_sql(key)

    def text(target):
        if target not in types:
            return "CAST(NULL AS VARCHAR)"
        src, t = types[target]
        return f"upper({_code_text_sql(ident(src), t)})"

    def scrub(e):
        return f"(CASE WHEN {e} IN {in_list(S.REFUSAL_CODES)} THEN NULL ELSE {e} END)"

    out = {}
    src, t = types["caseid"]
    out["caseid"] = f"CAST({ident(src)} AS BIGINT)"
    out["year"] = f"CAST({year} AS INTEGER)"
    src, t = types["weight"]
    out["weight"] = f"CAST({ident(src)} AS DOUBLE)"
    for it in S.FRAUD_ITEMS:
        x = text(it)
        out[it] = (f"CAST(CASE WHEN {x} IN {in_list(S.BELIEF_TEXT_ONE)} THEN 1.0 "
                   f"WHEN {x} IN {in_list(S.BELIEF_TEXT_ZERO)} THEN 0.0 "
                   f"WHEN {x} IN {in_list(codes_one)} THEN 1.0 WHEN {x} IN {in_list(codes_zero)} THEN 0.0 "
                   f"ELSE NULL END AS DOUBLE)")
    src, t = types["birth_year"]
    out["birth_year"] = f"TRY_CAST(TRY_CAST({_code_text_sql(ident(src), t)} AS DOUBLE) AS INTEGER)"
    src, t = types["state"]
    if t == "double":
        out["state"] = f"upper({case_map(_code_text_sql(ident(src), t), S.STATE_CODES)})"
    else:
        out["state"] = f"upper({ident(src)})"
    for c in ("zip_code", "county"):
        out[c] = text(c)
    race = text("race")
    out["race"] = scrub(f"(CASE WHEN {race} = {q(S.RACE_MISSING_CODE)} THEN NULL ELSE {race} END)")
    party = text("party")
    out["party"] = scrub("(CASE " + " ".join(f"WHEN {party} IN {in_list(v)} THEN {q(k)}"
                                             for k, v in S.PARTY_CODES.items()) + " ELSE NULL END)")
    for c in ("confidence", "gender", "education", "ideology", "voted", "time_lived_in_residence"):
        out[c] = scrub(text(c))
    if year == 2022:
        for col, codes in S.CODEBOOK_2022.items():
            mapping = dict(codes)
            if col in S.CODEBOOK_2022_KEEPS_TEXT:
                mapping.update({lab: lab for lab in codes.values()})
            out[col] = case_map(out[col], mapping)
    sel = ", ".join(f"{out[c]} AS {ident(c)}" for c in S.COMBINED_COLUMNS)
    return f"SELECT {sel} FROM ({raw}) w"


def _harmonize(codes_one, codes_zero) -> str:
    parts = [_harmonize_sql(k, codes_one, codes_zero) for k in S.WAVE_MANIFEST]
    items_nn = "coalesce(" + ", ".join(ident(c) for c in S.FRAUD_ITEMS) + ") IS NOT NULL"
    ctes = "comb AS (" + "\nUNION ALL\n".join(parts) + ")"
    cols = ", ".join(r6(ident(c), c) if c in S.FRAUD_ITEMS or c == "weight" else ident(c)
                     for c in S.COMBINED_COLUMNS)
    return with_resp(f"SELECT {cols} FROM comb WHERE {items_nn}", ctes)


def harmonize_combined() -> str:
    return _harmonize(S.BELIEF_CODES_ONE_MAIN, S.BELIEF_CODES_ZERO_MAIN)


def harmonize_alt() -> str:
    return _harmonize(S.BELIEF_CODES_ONE_ALT, S.BELIEF_CODES_ZERO_ALT)


def outcome_frequency() -> str:
    long = union_long("resp", ["year"], S.CORE_ITEMS, "item", "value")
    return with_resp("SELECT year, item, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY year, item, value",
                     f"long AS ({long})")


def harmonize_labelled() -> str:
    return f"SELECT * FROM ({harmonize_combined()}) WHERE year = 2012"


def glm_cells() -> str:
    from wavestat.sources.respondents import ADAPTER_SWING_BY_YEAR
    items = S.CORE_ITEMS
    ctes = f"""sw AS ({swing_values_sql(ADAPTER_SWING_BY_YEAR)}),
d AS (SELECT r.*, CAST(party = 'REPUBLICAN' AS DOUBLE) AS rep_party, CAST(party = 'DEMOCRAT' AS DOUBLE) AS dem_party,
             CAST(CASE WHEN sw.year IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS swing_state
      FROM resp r LEFT JOIN sw ON r.year = sw.year AND r.state = sw.state),
long AS ({union_long('d', ['year', 'weight', 'rep_party', 'dem_party', 'swing_state'], items, 'item', 'y')}),
l2 AS (SELECT *, (y IS NOT NULL AND rep_party IS NOT NULL AND dem_party IS NOT NULL AND swing_state IS NOT NULL
                  AND weight IS NOT NULL) AS complete FROM long WHERE y IS NOT NULL)"""
    body = f"""SELECT year, item, complete,
  CASE WHEN complete THEN rep_party END AS x1, CASE WHEN complete THEN dem_party END AS x2,
  CASE WHEN complete THEN swing_state END AS x3, count(*) AS n,
  {r6('sum(CASE WHEN complete THEN weight END)', 'sw')},
  {r6('sum(CASE WHEN complete THEN weight * weight END)', 'sw2')},
  {r6('sum(CASE WHEN complete THEN weight * y END)', 'swy')},
  {r6('sum(CASE WHEN complete THEN weight * weight * y END)', 'sw2y')},
  {r6('sum(CASE WHEN complete THEN weight * weight * y * y END)', 'sw2yy')}
FROM l2 GROUP BY 1, 2, 3, 4, 5, 6"""
    return with_resp(body, ctes)


ORACLES = {
    "harmonize_combined": harmonize_combined,
    "harmonize_alt": harmonize_alt,
    "harmonize_labelled": harmonize_labelled,
    "outcome_frequency": outcome_frequency,
    "belief_share_by_item": belief_share_by_item,
    "belief_share_by_party_year": belief_share_by_party_year,
    "belief_share_by_party_pooled": belief_share_by_party_pooled,
    "count_by_confidence": count_by_confidence,
    "count_by_confidence_party": count_by_confidence_party,
    "confidence_crosstab": confidence_crosstab,
    "null_rate_by_item_year": null_rate_by_item_year,
    "null_counts_by_item_year": null_counts_by_item_year,
    "demographics_percent": demographics_percent,
    "availability_matrix": availability_matrix,
    "complete_case_by_wave": complete_case_by_wave,
    "dummy_design": dummy_design,
    "correlation_matrix": correlation_matrix,
    "domain_mean_ci": domain_mean_ci,
    "swing_effect": swing_effect,
    "effect_trend": effect_trend,
    "response_patterns": response_patterns,
    "glm_cells": glm_cells,
}


def oracle_sql() -> dict[str, str]:
    from wavestat.plans.oracle_models import MODEL_ORACLES  # builds on this module
    return {name: fn() for name, fn in {**ORACLES, **MODEL_ORACLES}.items()}


__all__ = ["oracle_sql", "RESPONDENTS_SQL", "ident", "q"]
