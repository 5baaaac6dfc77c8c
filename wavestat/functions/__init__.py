"""Scalar column helpers (recodes, dummies, bins, row counts, formatting)."""

from wavestat.functions.recode import (  # noqa: F401
    age_bins_closed, age_bins_open, all_not_null, binary_response, clip, code_text,
    count_null, count_true, eq_dummy, in_dummy, in_set, lookup, nullify,
    percent_label, percent_label_tenths, percent_tenths_text, recode, thousands_text,
)
