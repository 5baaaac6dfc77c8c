"""Share operators: properties."""

import math

from pyspark.sql import functions as F

from wavestat.operators.reshape import unpivot_items
from wavestat.operators.shares import count_share, percent_table, weighted_share


def test_shares_sum_to_one_and_scale_free(spark):
    rows = [("D", 1.0, 0.0, 1.5), ("D", 0.0, None, 2.0), ("R", 1.0, 1.0, 0.5), ("R", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "party string, i1 double, i2 double, weight double")
    s1 = weighted_share(df, ["i1", "i2"], by=["party"])
    tot = s1.groupBy("item", "party").agg(F.sum("proportion").alias("t")).collect()
    assert all(math.isclose(r.t, 1.0) for r in tot)
    s3 = weighted_share(df.withColumn("weight", F.col("weight") * 3), ["i1", "i2"], by=["party"])
    a = {(r.item, r.party, r.value): r.proportion for r in s1.collect()}
    b = {(r.item, r.party, r.value): r.proportion for r in s3.collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_unpivot_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, a double, b double")
    assert unpivot_items(df, ["id"], ["a", "b"]).count() == 4


def test_count_share_and_percent_table(spark):
    df = spark.createDataFrame([("x", "M", 1.0), ("x", "F", 3.0), ("y", "M", 1.0), ("y", None, 1.0)],
                               "c string, g string, weight double")
    cs = {(r.c, r.g): r.prop for r in count_share(df, ["c", "g"], ["c"]).collect()}
    assert cs[("x", "M")] == 0.5 and cs[("y", None)] == 0.5
    pt = {r.feature: r for r in percent_table(df, [("Gender", "g", ["M", "F"])]).collect()}
    assert math.isclose(pt["M"].unweighted_pct, 200 / 3) and math.isclose(pt["F"].weighted_pct, 60.0)
    assert pt["M"].level_order == 0 and pt["F"].level_order == 1
