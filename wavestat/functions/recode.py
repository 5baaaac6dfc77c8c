"""Column-expression helpers for survey recodes.

All helpers return ``Column`` expressions built from built-in functions, so
they stay inside whole-stage codegen.  The NULL rules follow the study's
semantics, which differ from SQL defaults in a few places:

* membership used as a value is FALSE for NULL (``in_set``), while an
  equality dummy stays NULL for NULL (``eq_dummy``);
* numeric codes are compared as text after normalising ``1.0`` to ``"1"``
  (``code_text``), never by casting text to numbers;
* text to number uses ``try_cast`` (bad text -> NULL, no error).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_text(c: ColumnOrName, dtype: T.DataType) -> Column:
    """Text form of a code column: numbers print without a fraction when whole.

    ``1.0`` -> ``"1"``, ``-9`` -> ``"-9"``, ``2.5`` -> ``"2.5"``, text unchanged.
    """
    c = _col(c)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(9.0e15))
        return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    return c.cast("string")


def in_set(c: ColumnOrName, values: Iterable) -> Column:
    """``c IN values`` as a value: FALSE (not NULL) when ``c`` is NULL."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def eq_dummy(c: ColumnOrName, value) -> Column:
    """1.0 / 0.0 indicator of ``c == value``; NULL when ``c`` is NULL."""
    return (_col(c) == F.lit(value)).cast("double")


def in_dummy(c: ColumnOrName, values: Iterable) -> Column:
    """1.0 / 0.0 indicator of membership; NULL counts as not a member (0.0)."""
    return in_set(c, values).cast("double")


def recode(c: ColumnOrName, mapping: Sequence[tuple[object, Sequence]], default=None,
           null_stays_null: bool = False) -> Column:
    """Multi-branch recode: first ``(target, sources)`` pair whose sources hold
    the value wins; otherwise ``default`` (NULL if not given).

    ``null_stays_null`` keeps NULL input as NULL even when a default is given.
    """
    c = _col(c)
    expr = None
    if null_stays_null:
        expr = F.when(c.isNull(), F.lit(None))
    for target, sources in mapping:
        cond = in_set(c, sources)
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def lookup(c: ColumnOrName, mapping: dict) -> Column:
    """Map lookup key -> label; a key outside the map gives NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_col(c)]


def nullify(c: ColumnOrName, codes: Iterable) -> Column:
    """Scrub missing/refusal codes to NULL; other values (and NULL) pass."""
    c = _col(c)
    return F.when(in_set(c, codes), F.lit(None)).otherwise(c)


def binary_response(text: Column, one_text: Sequence[str], zero_text: Sequence[str],
                    one_codes: Sequence[str], zero_codes: Sequence[str]) -> Column:
    """Belief answer -> 1.0 / 0.0 / NULL, from answer text or numeric code text."""
    return (F.when(in_set(text, one_text), F.lit(1.0))
            .when(in_set(text, zero_text), F.lit(0.0))
            .when(in_set(text, one_codes), F.lit(1.0))
            .when(in_set(text, zero_codes), F.lit(0.0))
            .otherwise(F.lit(None).cast("double")))


def age_bins_open(age: Column, bins: Sequence[tuple[float, str]], top: str, missing: str) -> Column:
    """Ages binned by exclusive upper bounds; NULL age -> ``missing`` label."""
    expr = F.when(age.isNull(), F.lit(missing))
    for upper, label in bins:
        expr = expr.when(age < F.lit(upper), F.lit(label))
    return expr.otherwise(F.lit(top))


def age_bins_closed(age: Column, bins: Sequence[tuple[float, float, str]],
                    top: tuple[float, str]) -> Column:
    """Ages binned by closed ``[lo, hi]`` ranges plus an open top bin; others NULL."""
    expr = None
    for lo, hi, label in bins:
        cond = (age >= F.lit(lo)) & (age <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.when(age >= F.lit(top[0]), F.lit(top[1]))
    return expr.otherwise(F.lit(None).cast("string"))


def count_true(cols: Sequence[ColumnOrName], skip_null: bool = False) -> Column:
    """Row-wise number of items equal to 1.

    ``skip_null=False``: plain sum, NULL if any item is NULL.
    ``skip_null=True``: NULL items count as 0.
    """
    if skip_null:
        terms = [F.coalesce((_col(c) == F.lit(1)).cast("int"), F.lit(0)) for c in cols]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out
    terms = [_col(c) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def count_null(cols: Sequence[ColumnOrName]) -> Column:
    """Row-wise number of NULL items."""
    terms = [_col(c).isNull().cast("int") for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def all_not_null(cols: Sequence[ColumnOrName]) -> Column:
    """TRUE when every listed column is non-NULL."""
    out = F.lit(True)
    for c in cols:
        out = out & _col(c).isNotNull()
    return out


def clip(c: ColumnOrName, lo: float, hi: float) -> Column:
    """Clip to ``[lo, hi]``; NULL stays NULL (``greatest`` alone would not)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def percent_tenths_text(count: ColumnOrName, total: ColumnOrName) -> Column:
    """``count / total`` as a percent with one decimal, e.g. ``"12.3%"``.

    Rounded half-to-even on the exact ratio (integer arithmetic, no float ties).
    """
    num = _col(count).cast("long") * F.lit(1000)
    den = _col(total).cast("long")
    q = F.floor(F.try_divide(num, den)).cast("long")
    r = num - q * den
    up = (F.lit(2) * r > den) | ((F.lit(2) * r == den) & (q % 2 == 1))
    tenths = q + up.cast("long")
    text = F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))
    return F.when(den > 0, text)


def thousands_text(count: ColumnOrName) -> Column:
    """Whole number with thousands separators, e.g. ``"12,345"``."""
    return F.format_number(_col(count).cast("long"), 0)


def percent_label(share: ColumnOrName) -> Column:
    """Whole-percent label of a share, e.g. 0.125 -> "12%" (half-to-even, as the
    charts print it); NULL share -> NULL."""
    return F.concat(F.bround(_col(share) * F.lit(100.0), 0).cast("long").cast("string"), F.lit("%"))


def percent_label_tenths(share: ColumnOrName) -> Column:
    """Percent label with one decimal, whole numbers printed without it, e.g.
    0.4533 -> "45.3%", 0.12 -> "12%" (half-to-even); NULL share -> NULL."""
    rounded = F.bround(_col(share) * F.lit(100.0), 1).cast("string")
    return F.concat(F.regexp_replace(rounded, r"\.0$", ""), F.lit("%"))
