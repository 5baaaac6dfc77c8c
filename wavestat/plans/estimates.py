"""Estimator products: party trends with intervals, swing-state effects,
party effects, demographic logit tables, the belief-score regression and PCA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavestat import study as S
from wavestat.functions import eq_dummy, in_set, lookup, recode
from wavestat.operators.contrast import binary_contrast, linear_trend
from wavestat.operators.design import add_dummies, add_set_flag, complete_case_by_key
from wavestat.operators.domain import domain_mean
from wavestat.operators.glm import fit_glm, fit_glm_items, item_cells
from wavestat.operators.irt import attach_scores, fit_2pl, item_parameters, pattern_scores, response_patterns
from wavestat.operators.multivar import pca_fit
from wavestat.operators.multivar import pca_loadings as multivar_loadings
from wavestat.operators.multivar import pca_scores as multivar_scores

Z95 = 1.96


def not_confident_outcome(conf_col: str = "confidence"):
    """Confidence answer -> 1 (not confident) / 0 (confident) / NULL (don't know, other)."""
    c = F.upper(F.trim(F.col(conf_col).cast("string")))
    return (F.when(in_set(c, S.NOT_CONFIDENT), F.lit(1.0))
            .when(in_set(c, S.CONFIDENT), F.lit(0.0))
            .otherwise(F.lit(None).cast("double")))


def party_trend(resp: DataFrame, years=S.SURVEY_YEARS, items=S.CORE_ITEMS,
                not_in_2008=S.ITEMS_NOT_IN_2008) -> DataFrame:
    """Weighted share per year, outcome and party (Democrat / Republican) with
    design SE and a clipped 95% normal interval.

    Outcomes: the core items plus "not confident vote counted"; 2008 leaves
    out the items it did not ask.  Each year is its own design.
    Output: year, fraud_type, fraud_label, party_label, proportion, std_error,
    ci_lower, ci_upper, percentage, ci_lower_pct, ci_upper_pct, n, n_obs.
    """
    outcome = "not_confident_vote_counted"
    df = (resp.withColumn(outcome, not_confident_outcome())
          .filter(in_set("year", years) & in_set("party", ["DEMOCRAT", "REPUBLICAN"]))
          .withColumn("party_label", lookup("party", {"DEMOCRAT": "Democrat", "REPUBLICAN": "Republican"})))
    outcomes = list(items) + [outcome]
    excl = (F.col("year") == F.lit(2008)) & F.col("fraud_type").isin(*not_in_2008)
    est = domain_mean(df, outcomes, "party_label", ["year"], exclude=excl, item_col="fraud_type")
    p, se = F.col("mean"), F.col("std_error")
    lo = F.when((p - F.lit(Z95) * se).isNotNull(), F.greatest(F.lit(0.0), p - F.lit(Z95) * se))
    hi = F.when((p + F.lit(Z95) * se).isNotNull(), F.least(F.lit(1.0), p + F.lit(Z95) * se))
    return est.select(
        "year", "fraud_type", lookup("fraud_type", S.ITEM_LABELS).alias("fraud_label"), "party_label",
        p.alias("proportion"), se.alias("std_error"), lo.alias("ci_lower"), hi.alias("ci_upper"),
        (p * 100).alias("percentage"), (lo * 100).alias("ci_lower_pct"), (hi * 100).alias("ci_upper_pct"),
        "n", "n_obs")


def swing_effect(resp: DataFrame, swing: DataFrame, items=S.CORE_ITEMS,
                 labels=S.EFFECT_LABELS) -> DataFrame:
    """Average marginal effect of living in a swing state, per year and item.

    Survey-weighted logit of each item on the year's swing-state flag (closed
    form, see ``binary_contrast``); years without flag variation are left out,
    models without a finite estimate have NULL estimates and their status.
    Output: year, item, fraud_label, group, term, estimate, std_error,
    ci_lower, ci_upper, beta, beta_se, p0, p1, n, n0, n1, status.
    """
    df = add_set_flag(resp.select("year", "state", "weight", *items), swing, ["year", "state"],
                      "swing_states")
    est = binary_contrast(df, items, "swing_states", by=["year"], weight="weight")
    return est.select(
        "year", "item", lookup("item", labels).alias("fraud_label"), F.lit(S.SWING_GROUP).alias("group"),
        "term", "estimate", "std_error",
        (F.col("estimate") - F.lit(Z95) * F.col("std_error")).alias("ci_lower"),
        (F.col("estimate") + F.lit(Z95) * F.col("std_error")).alias("ci_upper"),
        "beta", "beta_se", "p0", "p1", "n", "n0", "n1", "status")


def survey_years(df: DataFrame, col: str = "year") -> Column:
    """Distinct survey years present in the data, sorted, as an array value of the plan (scalar subquery)."""
    return df.select(F.sort_array(F.collect_set(col))).scalar()


def year_index(years=S.SURVEY_YEARS, col: str = "year") -> Column:
    """1-based position of the year among all survey years (trend x axis); NULL for other years."""
    known = years if isinstance(years, Column) else F.array(*[F.lit(y) for y in years])
    at = F.array_position(known, F.col(col).cast("int"))
    return F.when(at > 0, at)


def effect_trend(effects: DataFrame, keys=("item", "term"), years=S.SURVEY_YEARS) -> DataFrame:
    """Least-squares trend of effect estimates over the survey-year index.

    ``years``: all survey years in order, a list or an array column (the x axis
    counts every year, so an item first asked in the second wave starts at 2).  NULL estimates are no
    points of the line.
    Output: keys..., slope, intercept, n_points.
    """
    return linear_trend(effects.withColumn("year_index", year_index(years)), list(keys),
                        "year_index", "estimate")


def swing_effect_trend(resp: DataFrame, swing: DataFrame) -> DataFrame:
    """Trend of the swing-state effects over the index of the survey years
    present in the data.  Output: item, term, slope, intercept, n_points."""
    return effect_trend(swing_effect(resp, swing), years=survey_years(resp))


# ----------------------------------------------------------------------------
# Party effects (logit on party dummies + swing flag, marginal effects)
# ----------------------------------------------------------------------------

PARTY_PREDICTORS = ("rep_party", "dem_party", "swing_state")


def _party_design(resp: DataFrame, swing: DataFrame, items) -> DataFrame:
    df = resp.select("year", "state", "party", "weight", *items).withColumns({
        "rep_party": eq_dummy("party", "REPUBLICAN"),
        "dem_party": eq_dummy("party", "DEMOCRAT")})
    return add_set_flag(df, swing, ["year", "state"], "swing_state")


def party_effects(resp: DataFrame, swing: DataFrame, items=S.CORE_ITEMS,
                  labels=S.EFFECT_LABELS, kind: str = "derivative") -> DataFrame:
    """Average marginal effect of Republican / Democrat (vs Independent) on
    each belief, per year, from a survey-weighted logit that also controls for
    swing-state residence.  All (year, item) models are fitted together.

    Model rows: non-NULL belief; rows without a party stay in the design
    (n) but not in the fit.  ``kind``: ``"derivative"`` (default) or
    ``"difference"`` (average change from party dummy 0 to 1).  Models
    without a finite estimate have NULL estimates and their status; a model
    with a row without weight falls back to the plain weighted logit of the
    others (status ``fallback``, pooled standard errors).
    Output: year, item, fraud_label, term, party, estimate, std_error,
    ci_lower, ci_upper, n_design, n_fit, status.
    """
    terms = list(S.PARTY_EFFECT_TERMS)
    fit = fit_glm_items(_party_design(resp, swing, items), ["year"], items, PARTY_PREDICTORS, keep_null_outcome=False,
                        difference_terms=terms if kind == "difference" else (), fallback=True)
    me = fit.marginal_effects(resp.sparkSession, terms, kind=kind)
    me = me.withColumn("estimate", F.when(F.col("std_error").isNotNull(), F.col("estimate")))
    return me.select(
        "year", "item", lookup("item", labels).alias("fraud_label"), "term",
        lookup("term", S.PARTY_EFFECT_TERMS).alias("party"), "estimate", "std_error",
        (F.col("estimate") - F.lit(Z95) * F.col("std_error")).alias("ci_lower"),
        (F.col("estimate") + F.lit(Z95) * F.col("std_error")).alias("ci_upper"),
        "n_design", "n_fit", "status")


def party_effect_trend(resp: DataFrame, swing: DataFrame) -> DataFrame:
    """Trend line of the party effects over the survey-year index, per item
    and party.  Output: item, term, slope, intercept, n_points."""
    return effect_trend(party_effects(resp, swing), keys=("item", "term"), years=survey_years(resp))


# ----------------------------------------------------------------------------
# Demographic logits 2012-2024 and their coefficient tables
# ----------------------------------------------------------------------------

def demographic_design(resp: DataFrame, years=None) -> DataFrame:
    """Complete-case rule by wave (2008: three items) and the demographic dummies."""
    df = resp
    if years is not None:
        df = df.filter(in_set("year", years))
    df = complete_case_by_key(df, "year", {2008: S.COMPLETE_CASE_2008}, S.COMPLETE_CASE_FULL)
    return add_dummies(df, S.DEMOGRAPHIC_DUMMIES)


def demographic_logits(resp: DataFrame, years=S.DEMOGRAPHIC_LOGIT_YEARS, items=S.CORE_ITEMS,
                       predictors=S.DEMOGRAPHIC_PREDICTORS):
    """Survey-weighted logit of each item on the demographic predictors, per
    year; returns the ``GlmFit`` (all year x item models in one batch)."""
    df = demographic_design(resp, years)
    return fit_glm_items(df, ["year"], items, list(predictors))


def coefficient_table(coefs: DataFrame, term_labels: dict, model_col: str, model_labels: dict | None = None,
                      digits: int = 3) -> DataFrame:
    """Coefficient rows kept for labelled terms, in label-dictionary order, with
    half-even rounding.  Output: model keys, model, term, label, term_order,
    Estimate, Std_Error, p_value (all rounded)."""
    order = {t: i for i, t in enumerate(term_labels)}
    out = coefs.filter(in_set("term", list(term_labels)))
    model = lookup(model_col, model_labels) if model_labels else F.col(model_col)
    return out.select(
        *[c for c in coefs.columns if c not in (
            "term", "term_index", "estimate", "std_error", "statistic", "p_value", "aliased",
            "n_design", "n_fit", "df_resid", "iterations", "status", model_col)],
        model.alias("model"), "term", lookup("term", term_labels).alias("label"),
        lookup("term", order).alias("term_order"),
        F.bround("estimate", digits).alias("Estimate"),
        F.bround("std_error", digits).alias("Std_Error"),
        F.bround("p_value", digits).alias("p_value"),
        "status")


def wide_by_model(table: DataFrame, keys, models, value_cols=("Estimate", "Std_Error"),
                  sep: str = "__") -> DataFrame:
    """Long coefficient table -> one column per (model, value): ``{model}__{value}``."""
    aggs = []
    for mdl in models:
        for v in value_cols:
            aggs.append(F.first(F.when(F.col("model") == F.lit(mdl), F.col(v)), ignorenulls=True)
                        .alias(f"{mdl}{sep}{v}"))
    return table.groupBy(*keys).agg(*aggs)


def logit_coefficients(resp: DataFrame) -> DataFrame:
    """Long coefficient table of the 2012-2024 demographic logits.

    Output: year, model (item label), term, label, term_order, Estimate,
    Std_Error, p_value, status.
    """
    fit = demographic_logits(resp)
    coefs = fit.coefficients(resp.sparkSession)
    return coefficient_table(coefs, S.DEMOGRAPHIC_TERM_LABELS, "item", S.ITEM_LABELS)


def logit_tables_wide(resp: DataFrame, items=S.CORE_ITEMS) -> DataFrame:
    """Coefficient tables wide by outcome: per year and term,
    ``{outcome}__Estimate`` and ``{outcome}__Std_Error`` (printed as two
    halves: first ceil(k/2) outcomes, then the rest -- see ``split_halves``)."""
    long = logit_coefficients(resp)
    labels = [S.ITEM_LABELS[i] for i in items]
    return wide_by_model(long, ["year", "label", "term_order"], labels)


def split_halves(models):
    """The two printed halves of an outcome list: first ceil(k/2), then the rest."""
    half = (len(models) + 1) // 2
    return list(models[:half]), list(models[half:])


# ----------------------------------------------------------------------------
# Belief score (2PL IRT) and its weighted linear regression
# ----------------------------------------------------------------------------

def irt_design(resp: DataFrame, year: int = 2024) -> DataFrame:
    """Rows of one year after the complete-case rule, with the demographic dummies."""
    return demographic_design(resp.filter(F.col("year") == F.lit(year)))


def irt_response_patterns(resp: DataFrame, year: int = 2024, items=S.CORE_ITEMS) -> DataFrame:
    """Answer patterns over the core items (complete-case rows of one year)
    and their counts.  Output: the items, n."""
    return response_patterns(irt_design(resp, year).select(*items), items)


def _irt(resp: DataFrame, year: int, items):
    df = irt_design(resp, year)
    fit = fit_2pl(df.select(*items), items)
    return df, fit


def irt_item_parameters(resp: DataFrame, year: int = 2024, items=S.CORE_ITEMS) -> DataFrame:
    """2PL slope / intercept / difficulty per item.  Output: item, a, d, b."""
    _, fit = _irt(resp, year, items)
    return item_parameters(resp.sparkSession, fit)


def irt_scores(resp: DataFrame, year: int = 2024, items=S.CORE_ITEMS) -> DataFrame:
    """EAP belief score per respondent (pattern scores joined back to rows).

    Output: caseid, year, fraud_score."""
    df, fit = _irt(resp, year, items)
    scores = pattern_scores(resp.sparkSession, fit, "fraud_score")
    return attach_scores(df.select("caseid", "year", *items), scores, items, "fraud_score").select(
        "caseid", "year", "fraud_score")


def irt_regression(resp: DataFrame, year: int = 2024, items=S.CORE_ITEMS,
                   predictors=S.DEMOGRAPHIC_PREDICTORS) -> DataFrame:
    """Survey-weighted linear regression of the 2PL belief score on the
    demographic predictors (design SE, t-based p-values).

    Output: label, term, term_order, Estimate, Std_Error, p_value (rounded to
    3 decimals, half-even), status.
    """
    df, fit = _irt(resp, year, items)
    scores = pattern_scores(resp.sparkSession, fit, "fraud_score")
    scored = attach_scores(df, scores, items, "fraud_score")
    reg = fit_glm(scored.select("year", "weight", "fraud_score", *predictors), ["year"], "fraud_score",
                  list(predictors), family="gaussian")
    table = coefficient_table(reg.coefficients(resp.sparkSession), S.DEMOGRAPHIC_TERM_LABELS, "year")
    return table.select("label", "term", "term_order", "Estimate", "Std_Error", "p_value", "status")


# ----------------------------------------------------------------------------
# Principal components of the core items
# ----------------------------------------------------------------------------

def _pca_rows(resp: DataFrame, first_year: int, items):
    return resp.filter(F.col("year") >= F.lit(first_year)).select(
        "caseid", "year", *[F.col(c).cast("double").alias(c) for c in items]).dropna(subset=list(items))


def pca_loadings(resp: DataFrame, first_year: int = 2012, items=S.CORE_ITEMS) -> DataFrame:
    """Loadings of the standardised core items (complete rows from ``first_year``).

    Output: variable, component, component_index, loading, sdev, variance_share.
    """
    fit = pca_fit(_pca_rows(resp, first_year, items), items)
    return multivar_loadings(resp.sparkSession, fit)


def pca_scores(resp: DataFrame, first_year: int = 2012, items=S.CORE_ITEMS) -> DataFrame:
    """Component scores per respondent.  Output: caseid, year, PC1..PCk."""
    rows = _pca_rows(resp, first_year, items)
    fit = pca_fit(rows, items)
    return multivar_scores(rows, fit, keep=["caseid", "year"])


# ----------------------------------------------------------------------------
# The 2008 raw-wave logit table
# ----------------------------------------------------------------------------

def raw2008_design(raw: DataFrame) -> DataFrame:
    """Recodes, case filters and dummies of the 2008 raw-wave models."""
    df = raw.select("caseid", "weight", "mode", *S.RAW2008_ITEMS, "birthyr", "gender", "race", "educ",
                    "pid3", "inputzip")
    df = df.withColumns({q_: (F.when(in_set(q_, S.RAW2008_TEXT_ONE), F.lit(1.0))
                              .when(in_set(q_, S.RAW2008_TEXT_ZERO), F.lit(0.0))
                              .otherwise(F.lit(None).cast("double"))) for q_ in S.RAW2008_ITEMS})
    df = df.dropna(subset=list(S.RAW2008_ITEMS))
    df = df.withColumns({
        "race": recode("race", S.RAW2008_RACE),
        "educ": recode("educ", S.RAW2008_EDUC),
        "birthyr": F.col("birthyr").cast("string").try_cast("double"),
    })
    keep = F.lit(True)
    for v in S.RAW2008_GENDER_DROP:
        keep = keep & (F.col("gender") != F.lit(v))
    for v in S.RAW2008_PARTY_DROP:
        keep = keep & (F.col("pid3") != F.lit(v))
    keep = keep & F.col("gender").isNotNull() & F.col("race").isNotNull() & F.col("educ").isNotNull() \
        & F.col("pid3").isNotNull()
    df = df.filter(keep)
    return df.withColumns({name: eq_dummy(col, value) for name, col, value in S.RAW2008_DUMMIES})


def logit_table_2008(raw: DataFrame) -> DataFrame:
    """Survey-weighted logits of the three 2008 items on interview mode and
    demographics, wide by outcome.  Education enters with all five dummies
    plus the intercept; the aliased one gets no estimate (NULL).

    Output: label, term, term_order, Estimate_Q36, SE_Q36, Estimate_Q37,
    SE_Q37, Estimate_Q38, SE_Q38 (rounded to 3 decimals, half-even).
    """
    df = raw2008_design(raw)
    preds = list(S.RAW2008_PREDICTORS)
    fit = fit_glm_items(df, [], S.RAW2008_ITEMS, preds, item_col="model")
    table = coefficient_table(fit.coefficients(raw.sparkSession), S.RAW2008_TERM_LABELS, "model")
    aggs = []
    for q_, name in S.RAW2008_MODEL_NAMES.items():
        for src, prefix in (("Estimate", "Estimate"), ("Std_Error", "SE")):
            aggs.append(F.first(F.when(F.col("model") == F.lit(q_), F.col(src)), ignorenulls=True)
                        .alias(f"{prefix}_{name}"))
    return table.groupBy("label", "term", "term_order").agg(*aggs)


def party_effect_cells(resp: DataFrame, swing: DataFrame, items=S.CORE_ITEMS) -> DataFrame:
    """The cell table the party-effect logits are fitted on: one row per
    (year, item, complete, rep_party, dem_party, swing_state) with n and the
    sums of w, w^2, w y, w^2 y, w^2 y^2.  Output: year, item, complete, x1,
    x2, x3, n, sw, sw2, swy, sw2y, sw2yy."""
    cells = item_cells(_party_design(resp, swing, items), ["year"], items, PARTY_PREDICTORS, keep_null_outcome=False)
    return cells.drop("n_no_weight")
