"""Combined-table writer/reader and the result sink."""

import re

from wavestat.sources.waves import read_combined, write_combined, write_result


def test_combined_roundtrip_with_year_pruning(spark, tmp_path):
    df = spark.createDataFrame([(1, 2008, 1.0), (2, 2012, 2.0), (3, 2024, 0.5)], "caseid long, year int, weight double")
    write_combined(df, str(tmp_path / "comb"))
    assert sorted(p.name for p in (tmp_path / "comb").iterdir() if p.name.startswith("year=")) == [
        "year=2008", "year=2012", "year=2024"]
    sub = read_combined(spark, str(tmp_path / "comb"), years=[2012, 2024])
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*\]", plan), plan
    assert sorted(r.caseid for r in sub.collect()) == [2, 3]


def test_result_sink_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    write_result(df, str(tmp_path / "out"), fmt="csv")
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert sorted((r.k, r.v) for r in back.collect()) == [("a", "1.5"), ("b", None)]


def test_small_years_are_one_file_and_large_ones_split(spark, tmp_path):
    import collections
    import glob
    years = {2008: 2000, 2012: 2000, 2016: 60_000, 2020: 2000}
    df = None
    for year, n in years.items():
        part = spark.range(0, n, 1, 6).selectExpr(f"cast({year} as int) year", "id caseid", "sha2(cast(id as string), 256) note")
        df = part if df is None else df.unionByName(part)
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        write_combined(df, str(tmp_path / "comb"))
    finally:
        for key in settings:
            spark.conf.unset(key)
    files = collections.Counter(f.split("year=")[1][:4] for f in glob.glob(str(tmp_path / "comb" / "year=*" / "*.parquet")))
    assert files["2008"] <= 2 and files["2012"] <= 2 and files["2020"] <= 2 and 4 <= files["2016"] <= 40
    back = {r.year: r["count"] for r in read_combined(spark, str(tmp_path / "comb")).groupBy("year").count().collect()}
    assert back == years
