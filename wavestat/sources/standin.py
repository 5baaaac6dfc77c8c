"""Stand-in raw survey waves built from the respondent view.

The driver tables hold no raw waves, so the harmonisation job gets its input
from here: each wave is the respondent view's rows of that survey year,
re-encoded the way that wave's file stores them -- its own column names from
the manifest, answers as upper/lower/mixed-case text or numeric codes, states
as names or numeric codes, the 2022 codebook codes, refusal and don't-know
codes for missing answers.  This module only encodes; decoding is the job of
``operators.harmonize`` (and of the raw-2008 model product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavestat import study as S
from wavestat.functions import lookup

# FIXED VALUES: per-wave storage style of the stand-in files.
#   items:  "text_upper" | "text_lower" | "text_mixed" | "codes"
#   state:  "name" | "fips_code"
#   party:  "text" | "codes"
#   codebook: True for the wave whose demographics are stored as codes
WAVE_STYLE = {
    "spae_2008": {"items": "text_lower", "state": "name", "party": "text", "lower": True},
    "MITU0017_OUTPUT": {"items": "text_upper", "state": "fips_code", "party": "text"},
    "MITU0019_OUTPUT_50state_1": {"items": "codes", "state": "name", "party": "codes", "race_code9": True},
    "MITU0022_OUTPUT": {"items": "codes", "state": "name", "party": "codes", "birth_text": True},
    "MITU0031_OUTPUT2": {"items": "codes", "state": "fips_code", "party": "text"},
    "MITU0042_OUTPUT_0120": {"items": "codes", "state": "name", "party": "codes", "codebook": True},
    "MITU0051_OUTPUT": {"items": "text_mixed", "state": "name", "party": "text"},
}

ONE_TEXT = ["IT IS VERY COMMON", "IT OCCURS FREQUENTLY", "IT OCCURS OCCASIONALLY"]
ZERO_TEXT = ["IT OCCURS INFREQUENTLY", "IT ALMOST NEVER OCCURS"]
MISSING_TEXT = [None, "DON'T KNOW", "PHONE - REFUSED"]
MISSING_CODES = [None, 9.0, -1.0]

# Respondent-view labels -> the 2008 file's lower-case labels.
EDUCATION_2008 = {"NO HS": "no hs", "HS GRAD": "high school graduate", "2-YEAR": "2-year",
                  "4-YEAR DEGREE": "4-year", "POST-GRAD": "post-grad"}
# Respondent-view labels -> 2022 codebook codes.
CODES_2022 = {
    "gender": {"MALE": 1.0, "FEMALE": 2.0},
    "confidence": {"VERY CONFIDENT": 1.0, "SOMEWHAT CONFIDENT": 2.0, "NOT TOO CONFIDENT": 3.0,
                   "NOT AT ALL CONFIDENT": 4.0, "I DON'T KNOW": 5.0},
    "race": {"WHITE": 1.0, "BLACK": 2.0, "HISPANIC": 3.0, "ASIAN": 4.0, "MIXED": 6.0},
    "education": {"NO HS": 1.0, "HS GRAD": 2.0, "2-YEAR": 4.0, "4-YEAR DEGREE": 5.0, "POST-GRAD": 6.0},
    "party": {"DEMOCRAT": 1.0, "REPUBLICAN": 2.0, "INDEPENDENT": 3.0},
    "ideology": {"VERY LIBERAL": 1.0, "LIBERAL": 2.0, "MODERATE": 3.0, "CONSERVATIVE": 4.0,
                 "VERY CONSERVATIVE": 5.0},
}
PARTY_CODES = {"DEMOCRAT": 1.0, "REPUBLICAN": 2.0, "INDEPENDENT": 3.0}


def _pick(options, k: Column) -> Column:
    """options[k mod len], an index into a literal array (deterministic per respondent)."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(k, F.lit(len(options))))


def _map(c: Column, mapping: dict, default=None) -> Column:
    found = lookup(c, mapping)
    return found if default is None else F.coalesce(found, F.lit(default))


def _answers(style: str, k: Column) -> dict[str, Column]:
    """The forms in which a respondent's 1, 0 and missing answers are stored, the same for every item."""
    if style == "codes":
        return {"__one": _pick([1.0, 2.0], k), "__zero": _pick([3.0, 4.0], k), "__missing": _pick(MISSING_CODES, k)}
    form = {"text_lower": F.lower, "text_mixed": F.initcap}.get(style, lambda text: text)
    return {"__one": form(_pick(ONE_TEXT, k)), "__zero": form(_pick(ZERO_TEXT, k)), "__missing": form(_pick(MISSING_TEXT, k))}


def _item(v: Column) -> Column:
    return F.when(v == 1, F.col("__one")).when(v == 0, F.col("__zero")).otherwise(F.col("__missing"))


def standin_wave(resp: DataFrame, key: str) -> DataFrame:
    """One raw wave (manifest column names, the wave's own codings)."""
    year, sources = S.WAVE_MANIFEST[key]
    style = WAVE_STYLE[key]
    k = F.col("caseid")
    rows = resp.filter(F.col("year") == F.lit(year)).withColumns(_answers(style["items"], k))
    lower = style.get("lower", False)

    def txt(c: str) -> Column:
        return F.lower(F.col(c)) if lower else F.col(c)

    enc: dict[str, Column] = {
        "caseid": F.col("caseid"),
        "weight": F.col("weight"),
        "confidence": txt("confidence"),
        "birth_year": (F.col("birth_year").cast("string") if style.get("birth_text")
                       else F.col("birth_year").cast("double") if lower else F.col("birth_year")),
        "gender": txt("gender"),
        "race": (F.coalesce(F.col("race"), F.lit(S.RACE_MISSING_CODE)) if style.get("race_code9")
                 else txt("race")),
        "education": (_map(F.col("education"), EDUCATION_2008) if lower else F.col("education")),
        "party": (_map(F.col("party"), PARTY_CODES, 4.0) if style["party"] == "codes"
                  else F.coalesce(txt("party"), F.lit("not sure" if lower else "NOT SURE"))),
        "zip_code": F.lpad(F.pmod(k, F.lit(99991)).cast("string"), 5, "0"),
        "county": F.when(F.pmod(k, F.lit(10)) == 0, F.lit(None)).otherwise(
            F.concat(F.lit("county "), F.pmod(k, F.lit(50)).cast("string"))),
        "state": (F.regexp_extract("state", r"(\d+)$", 1).cast("double") if style["state"] == "fips_code"
                  else txt("state")),
        "time_lived_in_residence": (F.pmod(k, F.lit(40)).cast("double") if lower
                                    else F.when(F.pmod(k, F.lit(9)) == 0, F.lit("-8"))
                                    .otherwise(F.pmod(k, F.lit(40)).cast("string"))),
        "ideology": txt("ideology"),
        "voted": _pick(["YES", "NO", "-9"], k),
    }
    for item in S.FRAUD_ITEMS:
        enc[item] = _item(F.col(item))
    if style.get("codebook"):
        for col, codes in CODES_2022.items():
            enc[col] = _map(F.col(col), codes, -9.0).cast("double")

    cols = []
    for target, src in zip(S.HARMONISED_COLUMNS, sources):
        if src != S.NOT_ASKED:
            cols.append(enc[target].alias(src))
    if lower:
        cols.append(F.when(F.pmod(k, F.lit(4)) == 0, F.lit("phone")).otherwise(F.lit("internet")).alias("mode"))
    return rows.select(*cols)


def standin_waves(resp: DataFrame) -> dict[str, DataFrame]:
    """Every wave of the study manifest, keyed by wave file key."""
    return {key: standin_wave(resp, key) for key in S.WAVE_MANIFEST}


def write_standin_waves(resp: DataFrame, base_dir: str, keys=tuple(S.WAVE_MANIFEST)) -> dict[str, str]:
    """Write the stand-in waves ``keys`` each as its own Parquet file set; returns key -> path.

    The respondent view of their years is written once, so its joins run once
    and join no other years, and each wave is encoded from a scan of it.  The
    files are not partitioned by year: that would sort the joined rows of every
    task, which costs more than the scans and holds a task's rows in memory.
    """
    spark = resp.sparkSession
    base = base_dir.rstrip("/")
    resp.filter(F.col("year").isin([S.WAVE_MANIFEST[key][0] for key in keys])).write.mode("overwrite").parquet(f"{base}/respondents")
    view = spark.read.schema(resp.schema).parquet(f"{base}/respondents")
    paths = {}
    for key in keys:
        path = f"{base}/{key}"
        standin_wave(view, key).write.mode("overwrite").parquet(path)
        paths[key] = path
    return paths


def labelled_wave(wave: DataFrame, key: str, columns) -> tuple[DataFrame, DataFrame]:
    """A text wave as labelled codes: (coded wave, its (wave, column, code, label) rows).

    Each column's texts are numbered from 1 in text order; texts that are
    numbers themselves (refusal codes) stay as codes without a label.
    """
    long = wave.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "label")
    texts = long.filter(F.col("label").isNotNull() & F.col("label").try_cast("double").isNull()).distinct()
    order = Window.partitionBy("column").orderBy("label")
    dictionary = texts.select(F.lit(key).alias("wave"), "column", F.row_number().over(order).cast("double").alias("code"), "label")
    codes: dict = {}
    for r in dictionary.collect():  # a row per answer text
        codes.setdefault(r.column, {})[r.label] = r.code
    coded = wave.withColumns({c: F.coalesce(_map(F.col(c), codes[c]).cast("double"), F.col(c).cast("string").try_cast("double"))
                              for c in columns if c in codes})
    return coded, dictionary
