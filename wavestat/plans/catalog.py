"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the respondent adapter or the
stand-in raw wave files derived from them) and runs the whole product on
them.  Result doubles are rounded to 6 decimals so that the oracle comparison
is exact.

``PRODUCTS`` lists each product with the input it takes; ``bind`` turns the
list into callables over any respondent source, so the same products run on
the live adapter view (``queries()``) or on a written combined table (bench).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestat import study as S
from wavestat.operators.design import flag_table
from wavestat.operators.harmonize import ALT_CODING, MAIN_CODING, harmonize_study, label_lookups
from wavestat.plans import descriptive as D
from wavestat.plans import estimates as X
from wavestat.session import checkpoint_dir
from wavestat.sources.respondents import ADAPTER_SWING_BY_YEAR, respondents
from wavestat.sources.standin import labelled_wave, write_standin_waves
from wavestat.sources.waves import read_wave, read_waves

RESP = "resp"          # product(resp)
SWING = "swing"        # product(resp, swing)
RAW = "raw"            # product(raw wave) -- key in the spec
WAVES = "waves"        # product(raw waves)
LABELLED = "labelled"  # product(one wave as labelled codes, its label dictionary) -- key in the spec

#: Answer columns of the 2012 wave that its labelled form stores as codes.
LABELLED_2012 = ("q29a", "q29b", "q29c", "q29d", "q29e", "q29f", "q25", "gender", "race", "educ", "pid3", "ideo5", "q1")


def harmonize_labelled_wave(wave: DataFrame, dictionary: DataFrame, key: str = "MITU0017_OUTPUT") -> DataFrame:
    """One wave stored as labelled codes, decoded by its label dictionary and harmonised.

    Output: the combined schema."""
    return harmonize_study({key: wave}, MAIN_CODING, {key: S.WAVE_MANIFEST[key]}, label_lookups(dictionary))


PRODUCTS: dict[str, tuple] = {
    "harmonize_combined": (WAVES, lambda waves: harmonize_study(waves, MAIN_CODING)),
    "harmonize_alt": (WAVES, lambda waves: harmonize_study(waves, ALT_CODING)),
    "harmonize_labelled": (LABELLED, harmonize_labelled_wave, "MITU0017_OUTPUT"),
    "belief_share_by_item": (RESP, D.belief_share_by_item),
    "belief_share_by_party_year": (RESP, D.belief_share_by_party_year),
    "belief_share_by_party_pooled": (RESP, D.belief_share_by_party_pooled),
    "count_by_confidence": (RESP, D.count_by_confidence),
    "count_by_confidence_party": (RESP, D.count_by_confidence_party),
    "confidence_crosstab": (RESP, D.confidence_crosstab),
    "null_rate_by_item_year": (RESP, D.null_rate_by_item_year),
    "null_counts_by_item_year": (RESP, D.null_counts_by_item_year),
    "demographics_percent": (RESP, D.demographics_percent),
    "availability_matrix": (RESP, D.availability_matrix),
    "outcome_frequency": (RESP, D.outcome_frequency),
    "complete_case_by_wave": (RESP, D.complete_case_by_wave),
    "dummy_design": (SWING, D.dummy_design),
    "correlation_matrix": (RESP, D.correlation_matrix),
    "domain_mean_ci": (RESP, X.party_trend),
    "swing_effect": (SWING, X.swing_effect),
    "effect_trend": (SWING, X.swing_effect_trend),
    "glm_cells": (SWING, X.party_effect_cells),
    "party_effects": (SWING, X.party_effects),
    "party_effect_trend": (SWING, X.party_effect_trend),
    "logit_coefficients": (RESP, X.logit_coefficients),
    "logit_tables_wide": (RESP, X.logit_tables_wide),
    "logit_table_2008": (RAW, X.logit_table_2008, "spae_2008"),
    "response_patterns": (RESP, X.irt_response_patterns),
    "irt_item_parameters": (RESP, X.irt_item_parameters),
    "irt_scores": (RESP, X.irt_scores),
    "linear_regression": (RESP, X.irt_regression),
    "pca_loadings": (RESP, X.pca_loadings),
    "pca_scores": (RESP, X.pca_scores),
}

_LABELLED: set[str] = set()
_WAVE_FILES: dict[tuple[str, str], dict[str, str]] = {}


def round_doubles(df: DataFrame, digits: int = 6, whole: Sequence[str] = ()) -> DataFrame:
    """Round every double column (result presentation for comparison) but those of ``whole`` numbers."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in whole:
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def standin_wave_files(spark: SparkSession, sf_dir: str,
                       resp_source: Callable[[SparkSession, str], DataFrame] = respondents,
                       keys=tuple(S.WAVE_MANIFEST)) -> dict[str, DataFrame]:
    """Raw wave files ``keys`` for ``sf_dir`` (each written once per session under
    the checkpoint folder), read back lazily."""
    files = _WAVE_FILES.setdefault((spark.sparkContext.applicationId, sf_dir, resp_source), {})
    absent = [key for key in keys if key not in files]
    if absent:
        base = f"{checkpoint_dir(spark).rstrip('/')}/waves-{uuid.uuid4().hex}"
        files.update(write_standin_waves(resp_source(spark, sf_dir), base, absent))
    return read_waves(spark, {key: files[key] for key in keys})


def labelled_files(spark: SparkSession, sf_dir: str, resp_source, key: str) -> tuple[DataFrame, DataFrame]:
    """The wave as labelled codes and its dictionary, written beside the raw wave files once per session."""
    raw = standin_wave_files(spark, sf_dir, resp_source, [key])[key]
    files = _WAVE_FILES[spark.sparkContext.applicationId, sf_dir, resp_source]
    base = files[key] + "-labelled"
    if base not in _LABELLED:
        coded, dictionary = labelled_wave(raw, key, LABELLED_2012)
        coded.write.mode("overwrite").parquet(f"{base}/wave")
        dictionary.write.mode("overwrite").parquet(f"{base}/labels")
        _LABELLED.add(base)
    return read_wave(spark, f"{base}/wave"), read_wave(spark, f"{base}/labels")


def bind(name: str, resp_source: Callable[[SparkSession, str], DataFrame] = respondents,
         rounded: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    """Callable ``(spark, sf_dir) -> DataFrame`` for one registered product."""
    kind, product, *extra = PRODUCTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == RESP:
            out = product(resp_source(spark, sf_dir))
        elif kind == SWING:
            out = product(resp_source(spark, sf_dir), flag_table(spark, ADAPTER_SWING_BY_YEAR))
        elif kind == LABELLED:
            out = product(*labelled_files(spark, sf_dir, resp_source, extra[0]))
        elif kind == RAW:
            out = product(standin_wave_files(spark, sf_dir, resp_source, extra)[extra[0]])
        else:
            out = product(standin_wave_files(spark, sf_dir, resp_source))
        # a harmonised wave's items are 1, 0 or null
        return round_doubles(out, whole=S.FRAUD_ITEMS if kind in (WAVES, LABELLED) else ()) if rounded else out

    run.__name__ = name
    run.__doc__ = getattr(product, "__doc__", None)
    return run


def queries(resp_source: Callable[[SparkSession, str], DataFrame] = respondents
            ) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(name, resp_source) for name in PRODUCTS}
