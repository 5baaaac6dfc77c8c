"""Product semantics on small hand-made respondent tables."""

import math

import pytest
from pyspark.sql import functions as F

from wavestat import study as S
from wavestat.operators.design import flag_table
from wavestat.plans import descriptive as D
from wavestat.plans import estimates as X

COLS = ["caseid", "year", "weight", *S.FRAUD_ITEMS, "confidence", "birth_year", "gender", "race",
        "education", "party", "state", "ideology"]
SCHEMA = ("caseid long, year int, weight double, " + ", ".join(f"{c} double" for c in S.FRAUD_ITEMS)
          + ", confidence string, birth_year int, gender string, race string, education string, party string, "
            "state string, ideology string")


def resp_row(caseid, year, weight, items, confidence=None, birth_year=None, gender=None, race=None,
             education=None, party=None, state=None, ideology=None):
    vals = [None if v is None else float(v) for v in items] + [None] * (len(S.FRAUD_ITEMS) - len(items))
    return (caseid, year, weight, *vals, confidence, birth_year, gender, race, education, party, state, ideology)


@pytest.fixture(scope="module")
def resp(spark):
    rows = [
        resp_row(1, 2024, 1.0, [1, 0, 1, 1, 0, 0], "VERY CONFIDENT", 1950, "MALE", "WHITE", "NO HS", "DEMOCRAT", "S1"),
        resp_row(2, 2024, 2.0, [0, 0, 1, 1, 1, 0], "NOT TOO CONFIDENT", 1990, "FEMALE", "BLACK", "4-YEAR",
                 "REPUBLICAN", "S2"),
        resp_row(3, 2024, 1.0, [1, 1, None, 0, 0, 0], "I DON’T KNOW", None, "FEMALE", None, "POST-GRAD",
                 None, "S1"),
        resp_row(4, 2024, 3.0, [0, 1, 0, 0, 0, 1], "Don't know", 2000, None, "ASIAN", "2-YEAR", "INDEPENDENT",
                 "S3"),
        resp_row(5, 2012, 1.5, [1, 1, 1, 1, 1, 1], "SOMEWHAT CONFIDENT", 1960, "MALE", "MIXED", "HS GRAD",
                 "DEMOCRAT", "S2"),
        resp_row(6, 2012, 0.5, [0, 0, 0, None, 0, 0], "NOT AT ALL CONFIDENT", 1970, "MALE", "WHITE", "NO HS",
                 "REPUBLICAN", "S1"),
        resp_row(7, 2008, 1.0, [1, 0, 0], "VERY CONFIDENT", 1940, "FEMALE", "WHITE", "NO HS", "DEMOCRAT", "S1"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_belief_share_by_party_excludes_missing_party(resp):
    out = {(r.fraud_type, r.party_label, r.belief): r for r in D.belief_share_by_party_year(resp).collect()}
    assert {k[1] for k in out} == {"Democrat", "Republican", "Independent"}
    r = out[("Voting More Than Once", "Republican", "Not Common")]
    assert r.weighted_n == 2.0 and r.percentage == 1.0


def test_count_by_confidence_drops_dont_know_both_apostrophes(resp):
    out = D.count_by_confidence(resp).collect()
    # rows 3 and 4 answer don't know (curly / straight apostrophe, any case), row 6 has a NULL item,
    # row 7 is before the first year
    assert sum(r.n for r in out) == 3
    by = {(r.confidence, r.fraud_count): r.prop for r in out}
    assert by[("Very confident", 3)] == 1.0 and by[("Not too confident", 3)] == 1.0


def test_confidence_crosstab_zero_fills_and_needs_all_items(resp):
    out = {r.Confidence: r for r in D.confidence_crosstab(resp).collect()}
    # rows 3 (NULL item), 6 (NULL item), 7 (2008: three items NULL) drop; 4 is don't know
    assert set(out) == {"Very confident", "Not too confident", "Somewhat confident"}
    assert out["Somewhat confident"]["6"] == 1 and out["Somewhat confident"]["0"] == 0
    assert out["Very confident"]["3"] == 1


def test_party_trend_design_n_counts_rows_with_missing_answers(resp):
    out = {(r.year, r.fraud_type, r.party_label): r for r in X.party_trend(resp).collect()}
    r = out[(2012, "non_citizen_voting", "Democrat")]
    assert r.n == 2 and r.n_obs == 1 and r.proportion == 1.0
    assert (2008, "non_citizen_voting", "Democrat") not in out  # not asked in 2008
    assert out[(2024, "voting_more_than_once", "Democrat")].proportion == 1.0


def test_demographics_age_bins_and_levels(resp):
    out = {(r.section, r.feature): r for r in D.demographics_percent(resp).collect()}
    assert math.isclose(out[("Party", "Democrat")].unweighted_pct, 50.0)
    assert ("Education", "Some College") not in out  # "2-YEAR" is not in this table's mapping
    assert out[("Age Group", "65+")].n_unweighted == 2  # born 1950 in 2024, 1940 in 2008
    assert out[("Age Group", "45–64")].n_unweighted == 1  # born 1960 in 2012


def test_availability_from_answers(resp):
    out = {r.item: r for r in D.availability_matrix(resp).collect()}
    assert out["voting_more_than_once"]["2008"] == S.CHECK_MARK
    assert out["non_citizen_voting"]["2008"] == ""
    assert out["drop_box_fraud"]["2024"] == ""


def test_swing_flag_null_state_is_not_swing(spark, resp):
    swing = flag_table(spark, {2024: ["S1"], 2012: ["S2"]})
    out = {r.caseid: r.swing_state for r in D.dummy_design(resp.withColumn(
        "state", F.when(F.col("caseid") == 2, None).otherwise(F.col("state"))), swing).collect()}
    assert out == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 1.0, 6: 0.0, 7: 0.0}


def test_effects_without_an_estimate_stay(spark):
    def wave(year, swing, other, dem="DEMOCRAT"):
        # per group and party: answers of the first item
        return [resp_row(0, year, 1.0, [y], party=p, state=st) for st, ys in (("S1", swing), ("S2", other))
                for p in (dem, "REPUBLICAN", "INDEPENDENT") for y in ys]
    rows = (wave(2016, [0, 1, 1], [0, 0, 1]) + wave(2020, [1, 1, 1], [0, 0, 1], dem="REPUBLICAN")
            + wave(2024, [0, 0, 1], [0, 1, 1]))
    df = spark.createDataFrame(rows, SCHEMA)
    swing = flag_table(spark, {2016: ["S1"], 2020: ["S1"], 2024: ["S1"]})
    got = {r.year: r for r in X.swing_effect(df, swing).collect()}
    assert set(got) == {2016, 2020, 2024} and got[2020].status == "separated"
    assert (got[2020].estimate, got[2020].ci_lower, got[2020].p1) == (None, None, 1.0)
    trend = X.swing_effect_trend(df, swing).collect()
    assert len(trend) == 1 and trend[0].n_points == 2
    assert math.isclose(trend[0].slope, (got[2024].estimate - got[2016].estimate) / 2)
    party = {(r.year, r.term): r for r in X.party_effects(df, swing).collect()}
    assert set(party) == {(y, t) for y in (2016, 2020, 2024) for t in S.PARTY_EFFECT_TERMS}
    assert party[2020, "dem_party"].estimate is None and party[2020, "dem_party"].status != "ok"
    points = {r.term: r.n_points for r in X.party_effect_trend(df, swing).collect()}
    assert points["dem_party"] == 2


def test_a_later_wave_gets_its_column(spark, resp):
    more = resp.unionByName(spark.createDataFrame([resp_row(8, 2026, 1.0, [1, None, 0])], SCHEMA))
    years = [str(y) for y in [*S.SURVEY_YEARS, 2026]]
    nulls = D.null_rate_by_item_year(more)
    assert nulls.columns == ["Question", *years, "question_order"]
    got = {r.Question: r["2026"] for r in nulls.collect()}
    assert got[S.ITEM_LABELS["ballot_tampering"]] == "1 (100.0%)" and got[S.ITEM_LABELS["voting_more_than_once"]].startswith("0 (")
    marks = {r.item: r["2026"] for r in D.availability_matrix(more).collect()}
    assert marks["voting_more_than_once"] == S.CHECK_MARK and marks["ballot_tampering"] == ""
    assert D.availability_matrix(resp).columns == ["item", "question", *years[:-1]]
