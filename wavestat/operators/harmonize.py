"""Wave harmonisation: differently coded survey waves -> one respondent table.

Each wave becomes ONE projection (rename by manifest, text normalisation,
recodes, refusal scrub, optional codebook decode, cast to the fixed schema);
the waves are then appended by name and rows with no belief answer at all are
dropped.  Catalyst collapses every step into a single ``Project`` per wave and
pushes the final filter below the ``Union``; there is no shuffle.

Source columns are matched by exact name (``q1`` and ``Q1`` are different
columns even though Spark resolves names case-insensitively by default): the
wave is first re-labelled positionally, so no lookup goes through the
analyser's name resolution.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestat import study as S
from wavestat.functions import code_text, lookup


@dataclass(frozen=True)
class ResponseCoding:
    """How belief answers map to 1 / 0 (text and numeric-code forms)."""
    text_one: tuple = tuple(S.BELIEF_TEXT_ONE)
    text_zero: tuple = tuple(S.BELIEF_TEXT_ZERO)
    codes_one: tuple = tuple(S.BELIEF_CODES_ONE_MAIN)
    codes_zero: tuple = tuple(S.BELIEF_CODES_ZERO_MAIN)


MAIN_CODING = ResponseCoding()
ALT_CODING = ResponseCoding(codes_one=tuple(S.BELIEF_CODES_ONE_ALT), codes_zero=tuple(S.BELIEF_CODES_ZERO_ALT))


@dataclass(frozen=True)
class HarmonizeRules:
    """Study rules applied to every wave (defaults: the fraud-belief study)."""
    targets: tuple = tuple(S.HARMONISED_COLUMNS)
    items: tuple = tuple(S.FRAUD_ITEMS)
    response_columns: tuple = tuple(S.RESPONSE_COLUMNS)
    refusal_codes: tuple = tuple(S.REFUSAL_CODES)
    party_codes: Mapping = field(default_factory=lambda: dict(S.PARTY_CODES))
    race_missing: str = S.RACE_MISSING_CODE
    state_codes: Mapping = field(default_factory=lambda: dict(S.STATE_CODES))
    coding: ResponseCoding = MAIN_CODING


# Fixed combined schema (types every wave is cast to before the union).
COMBINED_TYPES: dict[str, T.DataType] = {
    "caseid": T.LongType(), "year": T.IntegerType(), "weight": T.DoubleType(),
    **{c: T.DoubleType() for c in S.FRAUD_ITEMS},
    "confidence": T.StringType(), "birth_year": T.IntegerType(),
    "gender": T.StringType(), "race": T.StringType(), "education": T.StringType(),
    "party": T.StringType(), "zip_code": T.StringType(), "county": T.StringType(),
    "state": T.StringType(), "time_lived_in_residence": T.StringType(),
    "ideology": T.StringType(), "voted": T.StringType(),
}
COMBINED_SCHEMA = T.StructType([T.StructField(c, COMBINED_TYPES[c], True) for c in S.COMBINED_COLUMNS])

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _to_number(c: Column, dtype: T.DataType, target: str) -> Column:
    """Numeric column: plain cast; text column: ``try_cast`` (bad text -> NULL)."""
    if isinstance(dtype, _NUMERIC):
        return c.cast(target)
    as_double = c.cast("string").try_cast("double")
    return as_double if target == "double" else as_double.try_cast(target)


def _as_number(v: str) -> float | None:
    try:
        return float(v)
    except ValueError:
        return None


def _first_match_map(targets: Sequence[tuple[object, Sequence[str]]], numeric: bool = False) -> Column:
    """Literal map source value -> target, the first listing of a value wins (the
    same result as a CASE over the lists in order).

    ``numeric``: keys for a numeric source column -- the values that read as
    numbers, as doubles (a number never equals answer text, so text values
    drop out; ``1.0`` matches code ``"1"`` as its text form would).
    """
    pairs: dict = {}
    for target, sources in targets:
        for v in sources:
            key = _as_number(v) if numeric else v
            if key is not None:
                pairs.setdefault(key, target)
    if not pairs:
        numeric_targets = all(isinstance(t, float) for t, _ in targets)
        return F.create_map().cast(T.MapType(T.DoubleType() if numeric else T.StringType(),
                                             T.DoubleType() if numeric_targets else T.StringType()))
    args = []
    for k, v in pairs.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def _scrubbed(text: Column, codes: Sequence[str]) -> Column:
    """``nullify`` of a text column, its codes in a literal array: one loop in the
    generated code and not a branch per code (the JVM compiles no method beyond
    8,000 bytes of code, and a wave is one method)."""
    return F.when(F.array_contains(F.array(*[F.lit(v) for v in codes]), text), F.lit(None)).otherwise(text) if codes else text


def _belief_targets(coding: ResponseCoding) -> list[tuple[float, Sequence[str]]]:
    return [(1.0, coding.text_one), (0.0, coding.text_zero), (1.0, coding.codes_one), (0.0, coding.codes_zero)]


def harmonize_wave(df: DataFrame, sources: Sequence[str], year: int, rules: HarmonizeRules = HarmonizeRules(),
                   codebook: Mapping[str, Mapping[str, str]] | None = None,
                   codebook_keeps_text: Sequence[str] = (), not_asked: str = S.NOT_ASKED) -> DataFrame:
    """Project one raw wave onto the combined schema.

    ``sources[i]`` is the wave's column for ``rules.targets[i]`` (``not_asked``
    = not in this wave -> NULL).  ``codebook`` (column -> {code: label})
    decodes numeric codes; values outside it become NULL except, for
    ``codebook_keeps_text`` columns, text equal to one of the labels.
    """
    if len(sources) != len(rules.targets):
        raise ValueError("manifest length differs from the target column list")
    names = list(df.columns)
    types = [f.dataType for f in df.schema.fields]
    wave = df.toDF(*[f"__c{i}" for i in range(len(names))])

    def source(target: str) -> tuple[Column | None, T.DataType | None]:
        src = sources[rules.targets.index(target)]
        if src == not_asked or src not in names:  # exact, case-sensitive match
            return None, None
        i = names.index(src)
        return F.col(f"__c{i}"), types[i]

    texts: dict[str, Column] = {}
    maps: dict[tuple, Column] = {}

    def text(target: str) -> Column:
        """Upper-cased text form of the wave's column (built once, reused)."""
        if target not in texts:
            c, t = source(target)
            texts[target] = F.lit(None).cast("string") if c is None else F.upper(code_text(c, t))
        return texts[target]

    def is_numeric(target: str) -> bool:
        return isinstance(source(target)[1], _NUMERIC)

    def coded(target: str, name: str, targets) -> Column:
        """Value -> target by first-match lists: numeric columns are looked up
        as numbers (no per-row text conversion), text columns as upper text."""
        c, t = source(target)
        if c is None:
            return F.lit(None)
        numeric = isinstance(t, _NUMERIC)
        key = (name, numeric)
        if key not in maps:
            maps[key] = _first_match_map(targets, numeric)
        return maps[key][c.cast("double")] if numeric else maps[key][text(target)]

    out: dict[str, Column] = {}
    c, t = source("caseid")
    out["caseid"] = _to_number(c, t, "long") if c is not None else F.lit(None).cast("long")
    out["year"] = F.lit(year).cast("int")
    c, t = source("weight")
    out["weight"] = _to_number(c, t, "double") if c is not None else F.lit(None).cast("double")

    for item in rules.items:
        out[item] = coded(item, "belief", _belief_targets(rules.coding))

    c, t = source("birth_year")
    out["birth_year"] = (code_text(c, t).try_cast("double").try_cast("int") if c is not None
                         else F.lit(None).cast("int"))

    c, t = source("state")
    if c is None:
        out["state"] = F.lit(None).cast("string")
    elif isinstance(t, _NUMERIC):
        out["state"] = F.upper(lookup(code_text(c, t), dict(rules.state_codes)))
    else:
        out["state"] = F.upper(c.cast("string"))

    for col in ("zip_code", "county"):
        out[col] = text(col)

    race = text("race")
    out["race"] = F.when(race == F.lit(rules.race_missing), F.lit(None)).otherwise(race)
    out["party"] = coded("party", "party", list(rules.party_codes.items()))
    for col in ("confidence", "gender", "education", "ideology", "voted", "time_lived_in_residence"):
        out[col] = text(col)

    for col in rules.response_columns:
        if col in out and col not in rules.items:
            out[col] = _scrubbed(out[col].cast("string"), rules.refusal_codes)

    if codebook:
        for col, codes in codebook.items():
            if is_numeric(col):
                # refusal codes and the race missing code are not codebook
                # codes, so decoding the raw number gives the same result
                out[col] = coded(col, f"codebook:{col}", [(lab, [code]) for code, lab in codes.items()])
            else:
                mapping = dict(codes)
                if col in codebook_keeps_text:
                    mapping.update({lab: lab for lab in codes.values()})
                out[col] = lookup(out[col], mapping)

    return wave.select(*[out[name].cast(COMBINED_TYPES[name]).alias(name) for name in S.COMBINED_COLUMNS])


def label_lookups(dictionary: DataFrame) -> dict[str, dict[str, dict[str, str]]]:
    """wave -> column -> {code: label} from a (wave, column, code, label) table.

    The table is a survey's codebook, one row per label, and does not grow with
    the respondents; its rows become literals of the plan.  A code with two
    labels is an error.
    """
    found: dict = {}
    for r in dictionary.select("wave", "column", F.col("code").cast("string").alias("code"), "label").collect():
        labels = found.setdefault(r.wave, {}).setdefault(r.column, {})
        if labels.setdefault(r.code, r.label) != r.label:
            raise ValueError(f"two labels for code {r.code} of {r.column} in wave {r.wave}")
    return found


def apply_labels(wave: DataFrame, labels: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Labelled columns as text: a labelled code becomes its label, another value its own text, NULL stays.

    Columns are matched by exact name; other columns are passed on.  Codes of a
    numeric column are compared as numbers (code "1" labels 1 and 1.0).
    """
    names = list(wave.columns)
    fields = wave.schema.fields
    flat = wave.toDF(*[f"__c{i}" for i in range(len(names))])
    out = []
    for i, name in enumerate(names):
        c, t = F.col(f"__c{i}"), fields[i].dataType
        if labels.get(name):
            numeric = isinstance(t, _NUMERIC)
            by_label = [(label, [code]) for code, label in labels[name].items()]
            c = F.coalesce(_first_match_map(by_label, numeric)[c.cast("double") if numeric else c.cast("string")], code_text(c, t))
        out.append(c.alias(name))
    return flat.select(*out)


def combine_waves(waves: Sequence[DataFrame], items: Sequence[str] = S.FRAUD_ITEMS) -> DataFrame:
    """Append harmonised waves by name and drop rows whose items are all NULL."""
    combined = functools.reduce(lambda a, b: a.unionByName(b), waves)
    return combined.filter(F.coalesce(*[F.col(c) for c in items]).isNotNull())


def harmonize_study(raw_waves: Mapping[str, DataFrame], coding: ResponseCoding = MAIN_CODING,
                    manifest=S.WAVE_MANIFEST, labels: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Harmonise every wave of the study manifest and combine them.

    ``raw_waves`` maps the manifest's wave key to the raw wave DataFrame.
    Every wave of the manifest must be given (an absent one is an error).
    ``labels`` (see ``label_lookups``) turns the labelled columns of a wave
    into text first.  The 2022 wave additionally decodes its numeric codebook.
    """
    absent = [key for key in manifest if key not in raw_waves]
    if absent:
        raise ValueError(f"no input for wave(s): {', '.join(map(str, absent))}")
    rules = HarmonizeRules(coding=coding)
    parts = []
    for key, (year, sources) in manifest.items():
        book = S.CODEBOOK_2022 if year == 2022 else None
        wave = apply_labels(raw_waves[key], (labels or {}).get(key, {}))
        parts.append(harmonize_wave(wave, sources, year, rules, book, S.CODEBOOK_2022_KEEPS_TEXT))
    return combine_waves(parts, rules.items)
