"""Descriptive products over the combined respondent table.

Each function takes the combined table (any DataFrame with the harmonised
schema) and returns a result DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavestat import study as S
from wavestat.functions import (age_bins_closed, age_bins_open, count_null, count_true, eq_dummy,
                                in_set, lookup, percent_label, percent_label_tenths, percent_tenths_text, recode,
                                thousands_text)
from wavestat.operators.design import add_dummies, add_set_flag, complete_case_by_key
from wavestat.operators.multivar import numeric_columns, pairwise_correlation
from wavestat.operators.reshape import pivot_counts, pivot_first, unpivot_items, unpivot_patterns
from wavestat.operators.shares import count_share, null_rates, percent_table, weighted_share

BELIEF = "Belief in Fraud"
NO_BELIEF = "No Belief in Fraud"


def belief_share_by_item(resp: DataFrame, items=S.FRAUD_ITEMS, labels=S.SHARE_LABELS) -> DataFrame:
    """Weighted share believing / not believing each item is common.

    Output: fraud_type, fraud_label, belief, weighted_n, proportion, label
    (whole percent) and belief_proportion (the item's belief share, the
    display sort key).
    """
    out = weighted_share(
        resp, items, weight="weight",
        value_label=lambda v: F.when(v == F.lit(1), F.lit(BELIEF)).otherwise(F.lit(NO_BELIEF)),
        item_col="fraud_type", value_col="belief", share_col="proportion")
    w = Window.partitionBy("fraud_type")
    return out.select(
        "fraud_type",
        lookup("fraud_type", labels).alias("fraud_label"),
        "belief",
        "weighted_n",
        "proportion",
        percent_label("proportion").alias("label"),
        F.max(F.when(F.col("belief") == F.lit(BELIEF), F.col("proportion"))).over(w)
        .alias("belief_proportion"),
    )


# ----------------------------------------------------------------------------
# Belief by party (one year, pooled years)
# ----------------------------------------------------------------------------

def common_label(v):
    """1 / 0 / other -> "Common" / "Not Common" / NULL."""
    return (F.when(v == F.lit(1), F.lit("Common"))
            .when(v == F.lit(0), F.lit("Not Common")))


def chart_demographics(df: DataFrame, age_from) -> DataFrame:
    """Party label and demographic groups of the party charts.

    party/gender/race: labelled levels, other values "Other/Missing", NULL
    stays NULL; education collapsed with "Other/Missing" for the rest;
    age group from ``age_from`` (a year column or a fixed year).
    """
    age = F.lit(age_from) - F.col("birth_year").cast("double") if isinstance(age_from, int) \
        else F.col(age_from) - F.col("birth_year").cast("double")
    return df.withColumns({
        "party_label": recode("party", [(v, [k]) for k, v in S.PARTY_LABELS.items()],
                              default=S.OTHER_MISSING, null_stays_null=True),
        "gender_group": recode("gender", [(v, [k]) for k, v in S.GENDER_LABELS.items()],
                               default=S.OTHER_MISSING, null_stays_null=True),
        "race_group": recode("race", [(v, [k]) for k, v in S.RACE_LABELS.items()],
                             default=S.OTHER_MISSING, null_stays_null=True),
        "education_group": recode("education", S.EDUCATION_COLLAPSE, default=S.OTHER_MISSING),
        "age": age,
        "age_group": age_bins_open(age, S.AGE_BINS_CHART, S.AGE_CHART_TOP, S.AGE_CHART_MISSING),
    })


def _belief_by_party(df: DataFrame, items, labels) -> DataFrame:
    parties = list(S.PARTY_LABELS.values())
    df = df.filter(in_set("party_label", parties))
    out = weighted_share(df, items, by=["party_label"], weight="weight", value_label=common_label,
                         item_col="fraud_key", value_col="belief", share_col="percentage")
    return out.select(lookup("fraud_key", labels).alias("fraud_type"), "party_label", "belief",
                      "weighted_n", "percentage", percent_label_tenths("percentage").alias("label"))


def belief_share_by_party_year(resp: DataFrame, year: int = 2024, items=S.CORE_ITEMS,
                               labels=S.ITEM_LABELS) -> DataFrame:
    """Weighted share of Common / Not Common per item and party in one year.

    Output: fraud_type (label), party_label, belief, weighted_n, percentage
    (share within item and party), label (percent text, one decimal).
    """
    df = chart_demographics(resp.filter(F.col("year") == F.lit(year)), year)
    return _belief_by_party(df, items, labels)


def belief_share_by_party_pooled(resp: DataFrame, first_year: int = 2012, last_year: int = 2024,
                                 items=S.CORE_ITEMS, labels=S.ITEM_LABELS) -> DataFrame:
    """As ``belief_share_by_party_year`` pooled over a year range (age from
    each row's year; rows without a weight are left out)."""
    df = resp.filter(F.col("year").between(first_year, last_year) & F.col("weight").isNotNull())
    return _belief_by_party(chart_demographics(df, "year"), items, labels)


# ----------------------------------------------------------------------------
# Number of beliefs by confidence (heatmaps) and the confidence cross-tab
# ----------------------------------------------------------------------------

def _not_dont_know(c: str):
    cond = F.lit(True)
    for pat in S.DONT_KNOW_PATTERNS:
        cond = cond & ~F.coalesce(F.col(c).rlike("(?i)" + pat), F.lit(False))
    return cond


def _confidence_label(c: str):
    return lookup(c, dict(zip(S.CONFIDENCE_LEVELS, S.CONFIDENCE_LABELS)))


def count_by_confidence(resp: DataFrame, items=S.CORE_ITEMS, first_year: int = 2012) -> DataFrame:
    """Share of respondents believing 0..k items within each confidence level.

    Years from ``first_year``; don't-know answers removed; complete rows only;
    confidence outside the four levels forms a NULL group.
    Output: confidence, fraud_count, n, prop, label (whole percent).
    """
    df = (resp.filter(F.col("year") >= F.lit(first_year))
          .select("year", *items, "confidence")
          .filter(_not_dont_know("confidence"))
          .dropna())
    df = df.select(_confidence_label("confidence").alias("confidence"),
                   count_true(items).cast("int").alias("fraud_count"))
    out = count_share(df, ["confidence", "fraud_count"], ["confidence"], "n", "prop")
    return out.withColumn("label", percent_label("prop"))


def count_by_confidence_party(resp: DataFrame, items=S.CORE_ITEMS, first_year: int = 2012) -> DataFrame:
    """``count_by_confidence`` split by party (title-case levels; others NULL).

    Output: party, confidence, fraud_count, n, prop (share within party and
    confidence), label (whole percent).
    """
    df = (resp.filter(F.col("year") >= F.lit(first_year))
          .select("year", "party", *items, "confidence")
          .filter(_not_dont_know("confidence"))
          .dropna())
    party = F.initcap("party")
    df = df.select(F.when(party.isin(*S.PARTY_TITLE_LEVELS), party).alias("party"),
                   _confidence_label("confidence").alias("confidence"),
                   count_true(items).cast("int").alias("fraud_count"))
    out = count_share(df, ["party", "confidence", "fraud_count"], ["party", "confidence"], "n", "prop")
    return out.withColumn("label", percent_label("prop"))


def confidence_crosstab(resp: DataFrame, items=S.CORE_ITEMS) -> DataFrame:
    """Counts of confidence level x number of items believed (columns 0..k).

    Rows with any NULL item or a confidence outside the four levels are left
    out.  Output: Confidence, confidence_order, "0".."k" (zero-filled).
    """
    df = resp.select(count_true(items, skip_null=True).alias("fraud_count"),
                     count_null(items).alias("fraud_any_na"),
                     F.col("confidence"))
    df = df.filter((F.col("fraud_any_na") == 0) & in_set("confidence", S.CONFIDENCE_LEVELS))
    df = df.select(_confidence_label("confidence").alias("Confidence"),
                   lookup("confidence", {lev: i for i, lev in enumerate(S.CONFIDENCE_LEVELS)})
                   .alias("confidence_order"),
                   "fraud_count")
    return pivot_counts(df, ["Confidence", "confidence_order"], "fraud_count", range(len(items) + 1))


# ----------------------------------------------------------------------------
# Missing answers, demographics, availability
# ----------------------------------------------------------------------------

def _column_years(resp: DataFrame) -> list:
    """The study's years and any others present in the data, in order."""
    found = resp.agg(F.collect_set("year")).first()[0]  # the years become column names
    return sorted({*S.SURVEY_YEARS, *found})


def null_rate_by_item_year(resp: DataFrame, items=S.CORE_ITEMS, labels=S.ITEM_LABELS,
                           years=None, order=S.TABLE_ITEM_ORDER) -> DataFrame:
    """NULL count and share of each item by year, as "count (share%)" text.

    ``years``: the year columns (default: the study's years and any others
    present in the data, found by one small job).
    Output: Question (label), question_order, one text column per year.
    """
    years = _column_years(resp) if years is None else years
    long = null_rates(resp, items, ["year"], item_col="item")
    long = long.select(
        lookup("item", labels).alias("Question"),
        "year",
        F.concat(thousands_text("na_count"), F.lit(" ("),
                 percent_tenths_text("na_count", "total"), F.lit(")")).alias("combined_val"))
    wide = pivot_first(long, ["Question"], "year", years, ["combined_val"], name_fmt="{pivot}")
    return wide.withColumn("question_order",
                           lookup("Question", {lab: i for i, lab in enumerate(order)}))


def null_counts_by_item_year(resp: DataFrame, items=S.CORE_ITEMS, labels=S.ITEM_LABELS) -> DataFrame:
    """Long form of the missing-answer table: year, Question, total, na_count, na_prop."""
    long = null_rates(resp, items, ["year"], item_col="item")
    return long.select("year", lookup("item", labels).alias("Question"), "total", "na_count", "na_prop")


def demographics_clean(resp: DataFrame) -> DataFrame:
    """Cleaned demographic columns of the demographics table."""
    up = lambda c: F.upper(F.col(c).cast("string"))
    birth = F.col("birth_year").cast("string").try_cast("double")
    age = F.col("year").cast("double") - birth
    return resp.select(
        F.col("weight").cast("string").try_cast("double").alias("weight"),
        age_bins_closed(age, S.AGE_BINS_TABLE, S.AGE_TABLE_TOP).alias("age_group"),
        recode(up("gender"), S.DEMO_GENDER).alias("gender_clean"),
        recode(up("education"), S.DEMO_EDUCATION).alias("educ_clean"),
        recode(up("party"), S.DEMO_PARTY).alias("party_clean"),
        recode(up("ideology"), S.DEMO_IDEOLOGY).alias("ideo_clean"),
    )


def demographics_percent(resp: DataFrame, sections=S.DEMO_SECTIONS) -> DataFrame:
    """Unweighted and weighted percent of each demographic level.

    Output: section, feature, n_unweighted, n_weighted, unweighted_pct,
    weighted_pct, section_order, level_order.
    """
    return percent_table(demographics_clean(resp), sections, weight="weight")


def availability_matrix(resp: DataFrame, items=S.FRAUD_ITEMS, labels=S.SHARE_LABELS,
                        years=None, mark: str = S.CHECK_MARK) -> DataFrame:
    """Which items were answered (any non-NULL) in which year.

    One pass counts non-NULL answers per (year, item); the years x items
    result is reshaped to one mark column per year (``years``; default: the
    study's years and any others present in the data).
    Output: item, question, one column per year holding the mark or "".
    """
    years = _column_years(resp) if years is None else years
    per_year = resp.groupBy("year").agg(*[F.count(F.col(c)).alias(c) for c in items])
    long = unpivot_items(per_year, ["year"], items, "item", "n_answers")
    aggs = [F.coalesce(F.max(F.when(F.col("year") == F.lit(y), F.col("n_answers") > 0)), F.lit(False))
            .alias(f"__{y}") for y in years]
    wide = long.groupBy("item").agg(*aggs)
    return wide.select("item", lookup("item", labels).alias("question"),
                       *[F.when(F.col(f"__{y}"), F.lit(mark)).otherwise(F.lit("")).alias(str(y))
                         for y in years])


# ----------------------------------------------------------------------------
# Model-design views and the correlation matrix
# ----------------------------------------------------------------------------

def complete_case_by_wave(resp: DataFrame) -> DataFrame:
    """Rows complete on the model columns; 2008 checks its three items only.

    Output: caseid, year, weight, the six core items, education, race, party.
    """
    cols = ["caseid", "year", "weight", *S.CORE_ITEMS, "education", "race", "party"]
    return complete_case_by_key(resp.select(*cols), "year", {2008: S.COMPLETE_CASE_2008},
                                S.COMPLETE_CASE_FULL)


def dummy_design(resp: DataFrame, swing: DataFrame) -> DataFrame:
    """Indicator columns used by the models, plus party and swing-state flags.

    Output: caseid, year, the demographic dummies, rep_party, dem_party,
    swing_state.
    """
    df = add_dummies(resp, S.DEMOGRAPHIC_DUMMIES)
    df = df.withColumns({"rep_party": eq_dummy("party", "REPUBLICAN"),
                         "dem_party": eq_dummy("party", "DEMOCRAT")})
    df = add_set_flag(df, swing, ["year", "state"], "swing_state")
    return df.select("caseid", "year", *[d[0] for d in S.DEMOGRAPHIC_DUMMIES],
                     "rep_party", "dem_party", "swing_state")


def correlation_matrix(resp: DataFrame, renames=S.CORRELATION_RENAMES,
                       exclude=("caseid", "year", "weight")) -> DataFrame:
    """Pairwise-complete Pearson correlation of all numeric columns.

    Columns are renamed by substring replacement first; caseid, year and
    weight are left out.  Output: row_var, col_var, r.
    """
    names = []
    for c in resp.columns:
        new = c
        for old, label in renames:
            new = new.replace(old, label)
        names.append(new)
    renamed = resp.toDF(*names)
    cols = numeric_columns(renamed, exclude)
    return pairwise_correlation(renamed, cols)


def outcome_frequency(resp: DataFrame, items=S.CORE_ITEMS) -> DataFrame:
    """How often each answer of each item occurs per year (the distribution a model's outcome has).

    Output: year, item, value, n.
    """
    long = unpivot_patterns(resp, ["year"], items, {"n": F.count(F.lit(1))})
    return long.filter(F.col("value").isNotNull()).groupBy("year", "item", "value").agg(F.sum("n").alias("n"))
