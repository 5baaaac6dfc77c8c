"""Study configuration: the fraud-belief survey as one configuration of the
generic operators.

FIXED VALUES.  Everything in this module is data that must equal the
published study for results to match: wave manifests, response codings,
labels, level orders and swing-state sets.  They are written plainly, in the
order the study uses them.  Operators never hard-code any of this; they take
it as arguments.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------
# Harmonised schema
# ----------------------------------------------------------------------------

# Ten belief items, in harmonised column order.
FRAUD_ITEMS = [
    "voting_more_than_once",
    "ballot_tampering",
    "impersonation",
    "non_citizen_voting",
    "mail_ballot_fraud",
    "officials_changing_results",
    "vote_counting_software",
    "paid_to_vote",
    "fraudulent_registration",
    "drop_box_fraud",
]

# The six items used by most products.
CORE_ITEMS = FRAUD_ITEMS[:6]

# Items not asked in the 2008 wave.
ITEMS_NOT_IN_2008 = ["non_citizen_voting", "mail_ballot_fraud", "officials_changing_results"]

# Harmonised column names, in wave-manifest order (year is added after caseid).
HARMONISED_COLUMNS = [
    "caseid", "weight",
    "voting_more_than_once", "ballot_tampering", "impersonation",
    "non_citizen_voting", "mail_ballot_fraud", "officials_changing_results",
    "vote_counting_software", "paid_to_vote", "fraudulent_registration", "drop_box_fraud",
    "confidence", "birth_year",
    "gender", "race", "education", "party", "zip_code",
    "county", "state", "time_lived_in_residence", "ideology", "voted",
]

# Combined-table column order: caseid, year, then the rest.
COMBINED_COLUMNS = ["caseid", "year"] + HARMONISED_COLUMNS[1:]

# Survey years, in order.
SURVEY_YEARS = [2008, 2012, 2014, 2016, 2020, 2022, 2024]

# Wave manifests: per wave file, the source column for each harmonised column
# ("X" = not asked in that wave), and the survey year of the wave.
NOT_ASKED = "X"
WAVE_MANIFEST = {
    "spae_2008": (2008, [
        "caseid", "weight",
        "q36", "q37", "q38", "X", "X", "X",
        "X", "X", "X", "X",
        "q34", "birthyr", "gender", "race", "educ", "pid3",
        "inputzip", "countyname", "inputstate", "time_years", "ideo5", "q1"]),
    "MITU0017_OUTPUT": (2012, [
        "caseid", "weight",
        "q29a", "q29b", "q29c", "q29d", "q29e", "q29f",
        "X", "X", "X", "X",
        "q25", "birthyr", "gender", "race", "educ", "pid3",
        "lookupzip", "countyname", "regstate", "time_1", "ideo5", "q1"]),
    "MITU0019_OUTPUT_50state_1": (2014, [
        "caseid", "weight",
        "Q37A", "Q37B", "Q37C", "Q37D", "Q37E", "Q37F",
        "X", "X", "X", "X",
        "Q33", "birthyr", "gender", "race", "educ", "pid3",
        "lookupzip", "countyname", "inputstate", "time_1", "ideo5", "Q1"]),
    "MITU0022_OUTPUT": (2016, [
        "caseid", "weight",
        "Q37A", "Q37B", "Q37C", "Q37D", "Q37E", "Q37F",
        "X", "X", "X", "X",
        "Q33", "birthyr", "gender", "race", "educ", "pid3",
        "inputzip", "countyname", "inputstate", "time_1", "ideo5", "Q1"]),
    "MITU0031_OUTPUT2": (2020, [
        "caseid", "weight",
        "Q54A", "Q54B", "Q54C", "Q54D", "Q54E", "Q54F",
        "X", "X", "X", "X",
        "Q44", "birthyr", "gender", "race", "educ", "pid3",
        "inputzip", "countyname", "inputstate", "citylength_1", "ideo5", "Q1"]),
    "MITU0042_OUTPUT_0120": (2022, [
        "caseid", "weight",
        "Q53A", "Q53B", "Q53C", "Q53D", "Q53E", "Q53F",
        "Q53G", "Q53H", "Q53I", "Q53J",
        "Q49", "birthyr", "gender", "race", "educ", "pid3",
        "zipinput", "countyname", "inputstate", "citylength_1", "ideo5", "q1"]),
    "MITU0051_OUTPUT": (2024, [
        "caseid", "weight_final",
        "Q46A", "Q46B", "Q46C", "Q46D", "Q46E", "Q46F",
        "Q46G", "Q46H", "Q46I", "Q46J",
        "Q42", "birthyr", "gender", "race", "educ", "pid3",
        "inputzip", "countyname", "inputstate", "X", "ideo5", "Q1"]),
}

# ----------------------------------------------------------------------------
# Response codings used by harmonisation
# ----------------------------------------------------------------------------

# Belief answers as text (compared after upper-casing).
BELIEF_TEXT_ONE = ["IT IS VERY COMMON", "IT OCCURS OCCASIONALLY", "IT OCCURS FREQUENTLY"]
BELIEF_TEXT_ZERO = ["IT OCCURS INFREQUENTLY", "IT ALMOST NEVER OCCURS"]
# Belief answers as numeric codes: main build and the sensitivity ("alt") build.
BELIEF_CODES_ONE_MAIN = ["1", "2"]
BELIEF_CODES_ZERO_MAIN = ["3", "4"]
BELIEF_CODES_ONE_ALT = ["1", "2", "3"]
BELIEF_CODES_ZERO_ALT = ["4"]

# Refusal / missing codes scrubbed to NULL in response columns.
REFUSAL_CODES = ["PHONE - REFUSED", "-1", "-2", "-3", "-7", "-8", "-9"]
# Response columns the refusal scrub applies to.
RESPONSE_COLUMNS = FRAUD_ITEMS + ["confidence", "gender", "race", "education",
                                  "party", "ideology", "voted", "time_lived_in_residence"]

# Party normalisation (text or code).
PARTY_CODES = {
    "DEMOCRAT": ["DEMOCRAT", "1"],
    "REPUBLICAN": ["REPUBLICAN", "2"],
    "INDEPENDENT": ["INDEPENDENT", "3"],
}

# Race code that means "missing".
RACE_MISSING_CODE = "9"

# Numeric state code -> state name.
STATE_CODES = {
    "1": "ALABAMA", "2": "ALASKA", "4": "ARIZONA", "5": "ARKANSAS", "6": "CALIFORNIA",
    "8": "COLORADO", "9": "CONNECTICUT", "10": "DELAWARE", "11": "DISTRICT OF COLUMBIA",
    "12": "FLORIDA", "13": "GEORGIA", "15": "HAWAII", "16": "IDAHO", "17": "ILLINOIS",
    "18": "INDIANA", "19": "IOWA", "20": "KANSAS", "21": "KENTUCKY", "22": "LOUISIANA",
    "23": "MAINE", "24": "MARYLAND", "25": "MASSACHUSETTS", "26": "MICHIGAN",
    "27": "MINNESOTA", "28": "MISSISSIPPI", "29": "MISSOURI", "30": "MONTANA",
    "31": "NEBRASKA", "32": "NEVADA", "33": "NEW HAMPSHIRE", "34": "NEW JERSEY",
    "35": "NEW MEXICO", "36": "NEW YORK", "37": "NORTH CAROLINA", "38": "NORTH DAKOTA",
    "39": "OHIO", "40": "OKLAHOMA", "41": "OREGON", "42": "PENNSYLVANIA",
    "44": "RHODE ISLAND", "45": "SOUTH CAROLINA", "46": "SOUTH DAKOTA", "47": "TENNESSEE",
    "48": "TEXAS", "49": "UTAH", "50": "VERMONT", "51": "VIRGINIA", "53": "WASHINGTON",
    "54": "WEST VIRGINIA", "55": "WISCONSIN", "56": "WYOMING",
}

# Codebook of the 2022 wave: column -> {code: label}; text already equal to a
# label is kept (only gender and party list their own text as a source).
CODEBOOK_2022 = {
    "gender": {"1": "MALE", "2": "FEMALE"},
    "confidence": {"1": "VERY CONFIDENT", "2": "SOMEWHAT CONFIDENT",
                   "3": "NOT TOO CONFIDENT", "4": "NOT AT ALL CONFIDENT"},
    "race": {"1": "WHITE", "2": "BLACK", "3": "HISPANIC", "4": "ASIAN",
             "5": "NATIVE AMERICAN", "6": "OTHER"},
    "education": {"1": "LESS THAN HS", "2": "HS GRAD", "3": "SOME COLLEGE",
                  "4": "2-YEAR DEGREE", "5": "4-YEAR DEGREE", "6": "POSTGRAD"},
    "party": {"1": "DEMOCRAT", "2": "REPUBLICAN", "3": "INDEPENDENT"},
    "ideology": {"1": "VERY LIBERAL", "2": "LIBERAL", "3": "MODERATE",
                 "4": "CONSERVATIVE", "5": "VERY CONSERVATIVE"},
}
# Columns whose own label text is accepted as-is by the 2022 decode.
CODEBOOK_2022_KEEPS_TEXT = ["gender", "party"]

# ----------------------------------------------------------------------------
# Labels and level orders used by the products
# ----------------------------------------------------------------------------

# Belief-share chart labels (all ten items).
SHARE_LABELS = {
    "voting_more_than_once": "Multiple Voting",
    "ballot_tampering": "Ballot Tampering",
    "impersonation": "Voter Impersonation",
    "non_citizen_voting": "Non-Citizen Voting",
    "mail_ballot_fraud": "Mail Ballot Fraud",
    "officials_changing_results": "Official Tampering",
    "vote_counting_software": "Voting Software",
    "paid_to_vote": "Paid to Vote",
    "fraudulent_registration": "Fraudulent Registration",
    "drop_box_fraud": "Multiple Ballots (Drop Boxes)",
}

# Title-case labels of the six core items (party charts, tables).
ITEM_LABELS = {
    "voting_more_than_once": "Voting More Than Once",
    "ballot_tampering": "Ballot Tampering",
    "impersonation": "Impersonation",
    "non_citizen_voting": "Non-Citizen Voting",
    "mail_ballot_fraud": "Mail Ballot Fraud",
    "officials_changing_results": "Officials Changing Results",
    "not_confident_vote_counted": "Not Confident Vote Counted",
}

# Trend panel order.
TREND_ORDER = [
    "Mail Ballot Fraud",
    "Non-Citizen Voting",
    "Officials Changing Results",
    "Ballot Tampering",
    "Impersonation",
    "Voting More Than Once",
    "Not Confident Vote Counted",
]

# Sentence-case labels used by the effect charts.
EFFECT_LABELS = {
    "voting_more_than_once": "Voting more than once",
    "ballot_tampering": "Ballot tampering",
    "impersonation": "Impersonation",
    "non_citizen_voting": "Non-citizen voting",
    "mail_ballot_fraud": "Mail ballot fraud",
    "officials_changing_results": "Officials changing results",
}
EFFECT_ORDER = [
    "Ballot tampering",
    "Impersonation",
    "Voting more than once",
    "Mail ballot fraud",
    "Non-citizen voting",
    "Officials changing results",
]

# Missing-answer table order.
TABLE_ITEM_ORDER = [
    "Ballot Tampering",
    "Impersonation",
    "Voting More Than Once",
    "Mail Ballot Fraud",
    "Non-Citizen Voting",
    "Officials Changing Results",
]

# Correlation-matrix column renames (substring replacements, in order).
CORRELATION_RENAMES = [
    ("voting_more_than_once", "Multiple Voting"),
    ("ballot_tampering", "Ballot Tampering"),
    ("impersonation", "Impersonation"),
    ("non_citizen_voting", "Non-citizen Voting"),
    ("mail_ballot_fraud", "Mail Ballot Fraud"),
    ("officials_changing_results", "Official Tampering"),
]

# Confidence answers.
CONFIDENCE_LEVELS = ["NOT AT ALL CONFIDENT", "NOT TOO CONFIDENT",
                     "SOMEWHAT CONFIDENT", "VERY CONFIDENT"]
CONFIDENCE_LABELS = ["Not at all confident", "Not too confident",
                     "Somewhat confident", "Very confident"]
NOT_CONFIDENT = ["NOT TOO CONFIDENT", "NOT AT ALL CONFIDENT"]
CONFIDENT = ["VERY CONFIDENT", "SOMEWHAT CONFIDENT"]
# Patterns removed (case-insensitive) before counting beliefs by confidence.
DONT_KNOW_PATTERNS = ["DON'T KNOW", "I DON’T KNOW"]

# Party labels.
PARTY_LABELS = {"DEMOCRAT": "Democrat", "REPUBLICAN": "Republican", "INDEPENDENT": "Independent"}
PARTY_TITLE_LEVELS = ["Democrat", "Independent", "Republican"]
OTHER_MISSING = "Other/Missing"

# Demographic recodes of the party charts.
GENDER_LABELS = {"MALE": "Male", "FEMALE": "Female"}
RACE_LABELS = {"WHITE": "White", "BLACK": "Black", "HISPANIC": "Hispanic", "ASIAN": "Asian"}
EDUCATION_COLLAPSE = [
    ("High School or Less", ["HIGH SCHOOL GRADUATE", "NO HS"]),
    ("Some College", ["SOME COLLEGE", "2-YEAR"]),
    ("4-year degree", ["4-YEAR"]),
    ("Post-Graduate", ["POST-GRAD"]),
]
# Age bins of the party charts: (upper bound exclusive, label); the rest "65+".
AGE_BINS_CHART = [(35, "18-34"), (50, "35-49"), (65, "50-64")]
AGE_CHART_TOP = "65+"
AGE_CHART_MISSING = "Missing"

# Demographics table.
AGE_BINS_TABLE = [(18, 29, "18–29"), (30, 44, "30–44"), (45, 64, "45–64")]
AGE_TABLE_TOP = (65, "65+")
DEMO_GENDER = [("Male", ["MALE", "1"]), ("Female", ["FEMALE", "2"])]
DEMO_EDUCATION = [
    ("No High School", ["LESS THAN HS", "NO HS", "1"]),
    ("High School", ["HS GRAD", "HIGH SCHOOL GRADUATE", "2"]),
    ("Some College", ["SOME COLLEGE", "3"]),
    ("Some College", ["2-YEAR DEGREE", "4"]),
    ("4-year", ["4-YEAR DEGREE", "4-YEAR", "5"]),
    ("Post-grad", ["POSTGRAD", "POST-GRAD", "6"]),
]
DEMO_PARTY = [("Democrat", ["DEMOCRAT"]), ("Independent", ["INDEPENDENT"]),
              ("Republican", ["REPUBLICAN"])]
DEMO_IDEOLOGY = [
    ("Very Liberal", ["VERY LIBERAL", "1"]),
    ("Liberal", ["LIBERAL", "2"]),
    ("Moderate", ["MODERATE", "3"]),
    ("Conservative", ["CONSERVATIVE", "4"]),
    ("Very Conservative", ["VERY CONSERVATIVE", "5"]),
]
DEMO_SECTIONS = [
    ("Gender", "gender_clean", ["Male", "Female"]),
    ("Age Group", "age_group", ["18–29", "30–44", "45–64", "65+"]),
    ("Education", "educ_clean", ["No High School", "High School", "Some College", "4-year", "Post-grad"]),
    ("Party", "party_clean", ["Democrat", "Independent", "Republican"]),
    ("Ideology", "ideo_clean", ["Very Liberal", "Liberal", "Moderate", "Conservative", "Very Conservative"]),
]

# ----------------------------------------------------------------------------
# Model specifications
# ----------------------------------------------------------------------------

# Swing states per election year.
SWING_BY_YEAR = {
    2008: ["FLORIDA", "MINNESOTA", "MISSOURI", "INDIANA", "NORTH CAROLINA"],
    2012: ["FLORIDA", "NORTH CAROLINA", "OHIO"],
    2014: ["FLORIDA", "NORTH CAROLINA", "OHIO"],
    2016: ["FLORIDA", "IOWA", "MICHIGAN", "MINNESOTA", "NEVADA", "NEW HAMPSHIRE", "PENNSYLVANIA", "WISCONSIN"],
    2020: ["ARIZONA", "GEORGIA", "MICHIGAN", "NEVADA", "NORTH CAROLINA", "PENNSYLVANIA", "WISCONSIN"],
    2022: ["ARIZONA", "GEORGIA", "MICHIGAN", "NEVADA", "NORTH CAROLINA", "PENNSYLVANIA", "WISCONSIN"],
    2024: ["GEORGIA", "MICHIGAN", "NEW HAMPSHIRE", "PENNSYLVANIA", "WISCONSIN"],
}

PARTY_EFFECT_TERMS = {"rep_party": "Republican vs Independent", "dem_party": "Democrat vs Independent"}
SWING_GROUP = "Swing vs Non-Swing"

# Complete-case columns before the demographic models (2008 has fewer items).
COMPLETE_CASE_FULL = CORE_ITEMS + ["education", "race", "party"]
COMPLETE_CASE_2008 = ["voting_more_than_once", "ballot_tampering", "impersonation",
                      "education", "race", "party"]

# Dummy definitions on the combined table: name -> (column, values, form).
# form "eq": equality dummy (NULL stays NULL); "in": membership dummy (NULL -> 0).
DEMOGRAPHIC_DUMMIES = [
    ("female", "gender", ["FEMALE"], "eq"),
    ("white", "race", ["WHITE"], "eq"),
    ("black", "race", ["BLACK"], "eq"),
    ("hisp", "race", ["HISPANIC"], "eq"),
    ("asian", "race", ["ASIAN"], "eq"),
    ("other_r", "race", ["OTHER", "NATIVE AMERICAN", "MIXED", "TWO OR MORE RACES", "MIDDLE EASTERN"], "in"),
    ("hsgrad", "education", ["HIGH SCHOOL GRADUATE", "HS GRAD"], "in"),
    ("somecol", "education", ["SOME COLLEGE", "2-YEAR", "2-YEAR DEGREE"], "in"),
    ("fouryear", "education", ["4-YEAR", "4-YEAR DEGREE"], "in"),
    ("postgrad", "education", ["POST-GRAD", "POSTGRAD"], "in"),
    ("nohs", "education", ["NO HS", "LESS THAN HS"], "in"),
    ("dem", "party", ["DEMOCRAT"], "eq"),
    ("rep", "party", ["REPUBLICAN"], "eq"),
    ("ind", "party", ["INDEPENDENT"], "eq"),
]

# Predictors of the 2012-2024 demographic logits and of the score regression.
DEMOGRAPHIC_PREDICTORS = ["female", "black", "hisp", "asian", "other_r",
                          "somecol", "fouryear", "postgrad", "nohs",
                          "rep", "dem", "birth_year"]
DEMOGRAPHIC_TERM_LABELS = {
    "(Intercept)": "Intercept",
    "female": "Female",
    "black": "Black",
    "hisp": "Hispanic",
    "asian": "Asian",
    "other_r": "Other race",
    "somecol": "Some college",
    "fouryear": "4-year",
    "postgrad": "Post-grad",
    "nohs": "No HS",
    "rep": "Republican",
    "dem": "Democrat",
    "birth_year": "Birth year",
}
DEMOGRAPHIC_LOGIT_YEARS = [2012, 2014, 2016, 2020, 2022, 2024]

# The 2008 raw-wave logit.
RAW2008_ITEMS = ["q36", "q37", "q38"]
RAW2008_TEXT_ONE = ["it is very common", "it occurs occasionally"]
RAW2008_TEXT_ZERO = ["it almost never occurs", "it occurs infrequently"]
RAW2008_RACE = [("white", ["white"]), ("black", ["black"]), ("hispanic", ["hispanic"]),
                ("asian", ["asian"]),
                ("other", ["mixed", "native american", "other", "middle eastern"])]
RAW2008_EDUC = [("some college", ["some college", "2-year"]), ("4-year", ["4-year"]),
                ("high school graduate", ["high school graduate"]),
                ("post-grad", ["post-grad"]), ("no hs", ["no hs"])]
RAW2008_GENDER_DROP = ["phone - refused"]
RAW2008_PARTY_DROP = ["phone - refused", "not sure", "other"]
RAW2008_DUMMIES = [
    ("phone", "mode", "phone"),
    ("female", "gender", "female"),
    ("male", "gender", "male"),
    ("white", "race", "white"),
    ("black", "race", "black"),
    ("hisp", "race", "hispanic"),
    ("asian", "race", "asian"),
    ("other_r", "race", "other"),
    ("hsgrad", "educ", "high school graduate"),
    ("somecol", "educ", "some college"),
    ("fouryear", "educ", "4-year"),
    ("postgrad", "educ", "post-grad"),
    ("nohs", "educ", "no hs"),
    ("rep", "pid3", "republican"),
    ("dem", "pid3", "democrat"),
    ("ind", "pid3", "independent"),
]
RAW2008_PREDICTORS = ["phone", "female", "black", "hisp", "asian", "other_r",
                      "somecol", "hsgrad", "fouryear", "postgrad", "nohs",
                      "rep", "dem", "birthyr"]
RAW2008_TERM_LABELS = {
    "(Intercept)": "Intercept",
    "phone": "Phone Interview",
    "female": "Female",
    "black": "Black",
    "hisp": "Hispanic",
    "asian": "Asian",
    "other_r": "Other race",
    "somecol": "Some college",
    "hsgrad": "HS graduate",
    "fouryear": "4-year",
    "postgrad": "Post-grad",
    "nohs": "No HS",
    "rep": "Republican",
    "dem": "Democrat",
    "birthyr": "Birth year",
}
RAW2008_MODEL_NAMES = {"q36": "Q36", "q37": "Q37", "q38": "Q38"}

CHECK_MARK = "✓"
