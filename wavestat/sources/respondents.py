"""Respondent view over the driver's TPC-H-shaped tables.

The test tables hold no survey.  This adapter gives them the combined
respondent schema (one row per line item) so every product runs on data that
grows with the tables.  It only shapes columns; no product logic lives here.

Join plan: orders -> customer, then lineitem -> those, are large and sort-merge/
shuffle-hash joined on their keys (AQE re-plans at run time, skew join on), so
lineitem is shuffled once; ``nation`` is the 25-row TPC-H dimension and is
broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestat.sources.tables import read_table

# Calendar year of the ship date -> survey year.
SHIP_YEAR_TO_SURVEY = [(1995, 2008), (1996, 2012), (1997, 2014), (1998, 2016),
                       (1999, 2020), (2000, 2022)]
LAST_SURVEY_YEAR = 2024
MAX_BROADCAST_DIMENSION_ROWS = 100_000


def _item(null_cond, one_cond):
    return (F.when(null_cond, F.lit(None))
            .when(one_cond, F.lit(1.0))
            .otherwise(F.lit(0.0))).cast("double")


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined respondent table (harmonised schema) derived from the tables."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    # nation: a 25-row dimension in every TPC-H scale; broadcast behind a size check
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    if nation.count() <= MAX_BROADCAST_DIMENSION_ROWS:
        nation = F.broadcast(nation)

    placed = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, customer.c_nationkey == nation.n_nationkey))
    joined = li.join(placed.select("o_orderkey", "o_orderpriority", "c_mktsegment", "n_name"), li.l_orderkey == F.col("o_orderkey"))

    ship_year = F.year("l_shipdate")
    year = None
    for cal, survey in SHIP_YEAR_TO_SURVEY:
        year = F.when(ship_year == cal, F.lit(survey)) if year is None else year.when(
            ship_year == cal, F.lit(survey))
    year = year.otherwise(F.lit(LAST_SURVEY_YEAR)).cast("int")

    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    early = (ship_year == 1995) | F.lit(False)
    pre2000 = ship_year < 2000

    confidence = (F.when(sk % 6 == 0, "VERY CONFIDENT").when(sk % 6 == 1, "SOMEWHAT CONFIDENT")
                  .when(sk % 6 == 2, "NOT TOO CONFIDENT").when(sk % 6 == 3, "NOT AT ALL CONFIDENT")
                  .when(sk % 6 == 4, "I DON'T KNOW"))
    race = (F.when(pk % 7 == 0, "BLACK").when(pk % 7 == 1, "HISPANIC").when(pk % 7 == 2, "ASIAN")
            .when(pk % 7 == 3, "MIXED").when(pk % 7 == 4, F.lit(None)).otherwise("WHITE"))
    prio = F.col("o_orderpriority")
    education = (F.when(prio == "1-URGENT", "NO HS").when(prio == "2-HIGH", "HS GRAD")
                 .when(prio == "3-MEDIUM", "2-YEAR").when(prio == "4-NOT SPECIFIED", "4-YEAR DEGREE")
                 .otherwise("POST-GRAD"))
    seg = F.col("c_mktsegment")
    party = (F.when(seg == "AUTOMOBILE", "DEMOCRAT").when(seg == "BUILDING", "REPUBLICAN")
             .when(seg == "FURNITURE", "INDEPENDENT"))
    ideology = (F.when(sk % 5 == 0, "VERY LIBERAL").when(sk % 5 == 1, "LIBERAL")
                .when(sk % 5 == 2, "MODERATE").when(sk % 5 == 3, "CONSERVATIVE")
                .otherwise("VERY CONSERVATIVE"))

    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("caseid"),
        year.alias("year"),
        ((F.col("l_quantity") + 10) / 35).cast("double").alias("weight"),
        _item(pk % 11 == 0, F.col("l_discount") > 0.055).alias("voting_more_than_once"),
        _item(pk % 13 == 0, F.col("l_tax") > 0.045).alias("ballot_tampering"),
        _item(pk % 17 == 0, F.col("l_extendedprice") > 40000).alias("impersonation"),
        _item(early | (sk % 11 == 0), F.col("l_returnflag") == "R").alias("non_citizen_voting"),
        _item(early | (sk % 13 == 0), (F.col("l_discount") + F.col("l_tax")) > 0.095)
        .alias("mail_ballot_fraud"),
        _item(early | (sk % 17 == 0), F.col("l_extendedprice") > 60000).alias("officials_changing_results"),
        _item(pre2000, F.col("l_linenumber") > 3).alias("vote_counting_software"),
        _item(pre2000, F.col("l_returnflag") == "A").alias("paid_to_vote"),
        _item(pre2000, pk % 3 == 0).alias("fraudulent_registration"),
        _item(pre2000, sk % 4 == 0).alias("drop_box_fraud"),
        confidence.alias("confidence"),
        (F.lit(1930) + pk % 75).cast("int").alias("birth_year"),
        F.when(F.col("l_linestatus") == "F", "FEMALE").otherwise("MALE").alias("gender"),
        race.alias("race"),
        education.alias("education"),
        party.alias("party"),
        F.upper("n_name").alias("state"),
        ideology.alias("ideology"),
    )


# FIXED VALUES for the adapter view: its states are NATION_0..NATION_24, so the
# study's swing sets (US state names) match nobody.  The test configuration
# uses these per-year sets instead.
ADAPTER_SWING_BY_YEAR = {
    2008: ["NATION_1", "NATION_3", "NATION_7"],
    2012: ["NATION_1", "NATION_3", "NATION_7", "NATION_12"],
    2014: ["NATION_2", "NATION_3", "NATION_7"],
    2016: ["NATION_3", "NATION_9", "NATION_14", "NATION_20"],
    2020: ["NATION_1", "NATION_7", "NATION_18"],
    2022: ["NATION_1", "NATION_7", "NATION_18", "NATION_21"],
    2024: ["NATION_5", "NATION_7", "NATION_11"],
}
