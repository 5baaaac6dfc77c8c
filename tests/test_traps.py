"""NULL / type traps of the recode kit (R semantics vs SQL defaults)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestat.functions import (age_bins_closed, age_bins_open, clip, code_text, count_null, count_true,
                                eq_dummy, in_dummy, in_set, lookup, nullify, percent_tenths_text, recode,
                                thousands_text)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_membership_is_false_for_null(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",)], "x string")
    out = df.select(in_set("x", ["A"]).alias("m"), in_dummy("x", ["A"]).alias("d"))
    assert rows(out, "m", "d") == [(True, 1.0), (False, 0.0), (False, 0.0)]


def test_equality_dummy_keeps_null(spark):
    df = spark.createDataFrame([("A",), (None,)], "x string")
    assert rows(df.select(eq_dummy("x", "A").alias("d")), "d") == [(1.0,), (None,)]


def test_code_text_normalises_numbers(spark):
    df = spark.createDataFrame([(1.0, 1, "1"), (2.5, -9, "x"), (None, None, None)], "d double, i int, s string")
    out = df.select(code_text("d", T.DoubleType()).alias("d"), code_text("i", T.IntegerType()).alias("i"),
                    code_text("s", T.StringType()).alias("s"))
    assert rows(out, "d", "i", "s") == [("1", "1", "1"), ("2.5", "-9", "x"), (None, None, None)]


def test_text_compares_never_throw_under_ansi(spark):
    df = spark.createDataFrame([("A",), ("1",)], "x string")
    out = df.select(in_set("x", ["1", "2"]).alias("m"))
    assert rows(out, "m") == [(False,), (True,)]


def test_try_cast_bad_text_is_null(spark):
    df = spark.createDataFrame([("1970",), ("abc",)], "x string")
    assert rows(df.select(F.col("x").try_cast("int").alias("y")), "y") == [(1970,), (None,)]


def test_recode_default_and_null(spark):
    df = spark.createDataFrame([("DEMOCRAT",), ("OTHER",), (None,)], "p string")
    out = df.select(recode("p", [("Democrat", ["DEMOCRAT"])], default="Other/Missing",
                           null_stays_null=True).alias("a"),
                    recode("p", [("Democrat", ["DEMOCRAT"])], default="Other/Missing").alias("b"))
    assert rows(out, "a", "b") == [("Democrat", "Democrat"), ("Other/Missing", "Other/Missing"),
                                   (None, "Other/Missing")]


def test_lookup_missing_key_is_null(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert rows(df.select(lookup("k", {"a": "A"}).alias("v")), "v") == [("A",), (None,)]


def test_nullify_refusal_codes(spark):
    df = spark.createDataFrame([("-9",), ("PHONE - REFUSED",), ("YES",), (None,)], "v string")
    assert rows(df.select(nullify("v", ["-9", "PHONE - REFUSED"]).alias("v")), "v") == [
        (None,), (None,), ("YES",), (None,)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (None,)], "x double")
    assert rows(df.select(clip("x", 0.0, 1.0).alias("y")), "y") == [(0.0,), (0.5,), (1.0,), (None,)]


def test_row_counts_strict_and_skip_null(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (1.0, None, 1.0)], "a double, b double, c double")
    out = df.select(count_true(["a", "b", "c"]).alias("s"), count_true(["a", "b", "c"], True).alias("k"),
                    count_null(["a", "b", "c"]).alias("n"))
    assert rows(out, "s", "k", "n") == [(2.0, 2, 0), (None, 2, 1)]


def test_age_bins(spark):
    df = spark.createDataFrame([(17.0,), (18.0,), (29.0,), (30.0,), (64.0,), (65.0,), (None,)], "a double")
    out = df.select(age_bins_closed(F.col("a"), [(18, 29, "18-29"), (30, 44, "30-44"), (45, 64, "45-64")],
                                    (65, "65+")).alias("t"),
                    age_bins_open(F.col("a"), [(35, "<35"), (50, "<50")], "50+", "Missing").alias("c"))
    assert rows(out, "t", "c") == [(None, "<35"), ("18-29", "<35"), ("18-29", "<35"), ("30-44", "<35"),
                                   ("45-64", "50+"), ("65+", "50+"), (None, "Missing")]


def test_percent_text_half_even_exact(spark):
    # 1/80 = 1.25% exactly -> half-even gives 1.2%; 3/80 = 3.75% -> 3.8%
    df = spark.createDataFrame([(1, 80), (3, 80), (1234, 10000), (0, 7)], "c long, t long")
    out = df.select(percent_tenths_text("c", "t").alias("p"), thousands_text(F.col("c") * 1000).alias("k"))
    assert rows(out, "p", "k") == [("1.2%", "1,000"), ("3.8%", "3,000"), ("12.3%", "1,234,000"), ("0.0%", "0")]


def test_half_even_rounding_of_labels(spark):
    df = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert rows(df.select(F.bround("x", 2).alias("y")), "y") == [(0.12,), (0.38,)]


def test_empty_weight_sum_is_zero(spark):
    from wavestat.operators.shares import weighted_counts
    df = spark.createDataFrame([("a", None)], "k string, weight double")
    assert rows(weighted_counts(df, ["k"]), "k", "weighted_n") == [("a", 0.0)]


def test_binary_response_text_and_codes(spark):
    from wavestat.functions import binary_response
    df = spark.createDataFrame([("IT IS VERY COMMON",), ("IT ALMOST NEVER OCCURS",), ("2",), ("3",), ("9",),
                                (None,)], "t string")
    out = df.select(binary_response(F.col("t"), ["IT IS VERY COMMON"], ["IT ALMOST NEVER OCCURS"],
                                    ["1", "2"], ["3", "4"]).alias("v"))
    assert rows(out, "v") == [(1.0,), (0.0,), (1.0,), (0.0,), (None,), (None,)]


def test_percent_label_half_even(spark):
    from wavestat.functions import percent_label
    df = spark.createDataFrame([(0.125,), (0.375,), (0.5,), (None,)], "p double")
    assert rows(df.select(percent_label("p").alias("l")), "l") == [("12%",), ("38%",), ("50%",), (None,)]


def test_percent_label_tenths(spark):
    from wavestat.functions import percent_label_tenths
    df = spark.createDataFrame([(0.4533,), (0.12,), (1.0,), (0.125,), (0.00049,), (None,)], "p double")
    assert rows(df.select(percent_label_tenths("p").alias("l")), "l") == [
        ("45.3%",), ("12%",), ("100%",), ("12.5%",), ("0%",), (None,)]
