"""Stand-in wave files: what is joined and written for a product, and the size of the generated code."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from wavestat import study as S
from wavestat.operators.harmonize import ALT_CODING, COMBINED_SCHEMA, harmonize_study
from wavestat.plans import catalog
from wavestat.sources import respondents as R
from wavestat.sources.standin import standin_waves, write_standin_waves

#: The JVM leaves a method beyond so many bytes of code interpreted.
COMPILED_BYTES = 8000


@pytest.fixture(scope="module")
def resp(spark):
    fields = [f for f in COMBINED_SCHEMA.fields if f.name not in ("zip_code", "county", "time_lived_in_residence", "voted")]
    base = {"weight": 1.0, **dict.fromkeys(S.FRAUD_ITEMS, 1.0), "confidence": "VERY CONFIDENT", "birth_year": 1960, "gender": "MALE",
            "race": "WHITE", "education": "HS GRAD", "party": "DEMOCRAT", "state": "NATION_1", "ideology": "MODERATE"}
    rows = [{**base, "caseid": None if i == 5 else i, "year": y, S.FRAUD_ITEMS[i % 10]: (None, 0.0)[i % 2], "weight": 0.1234567 * i}
            for i, y in enumerate(S.SURVEY_YEARS * 12)]
    return spark.createDataFrame([tuple(r[f.name] for f in fields) for r in rows],
                                 COMBINED_SCHEMA.__class__(fields)).localCheckpoint()


def largest_method(df) -> int:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))


def test_a_product_on_one_wave_writes_that_wave_alone(spark, resp, tmp_path):
    def source(s, d):
        return resp

    files = catalog._WAVE_FILES
    catalog.standin_wave_files(spark, str(tmp_path), source, ["spae_2008"])
    one = files[spark.sparkContext.applicationId, str(tmp_path), source]
    assert list(one) == ["spae_2008"]
    folder = os.path.dirname(one["spae_2008"]).removeprefix("file:")
    assert {r.year for r in spark.read.parquet(f"{folder}/respondents").select("year").distinct().collect()} == {2008}
    path = one["spae_2008"]
    waves = catalog.standin_wave_files(spark, str(tmp_path), source)
    assert one["spae_2008"] == path and list(waves) == list(S.WAVE_MANIFEST)
    direct = standin_waves(resp)
    for key, wave in waves.items():
        assert wave.columns == direct[key].columns
        assert sorted(map(str, wave.collect())) == sorted(map(str, direct[key].collect()))


def test_respondent_files_are_not_sorted_by_year(resp, tmp_path):
    write_standin_waves(resp, str(tmp_path / "w"))
    assert not [x for x in os.listdir(tmp_path / "w" / "respondents") if x.startswith("year=")]


def test_lineitem_is_shuffled_once(spark, tmp_path):
    tables = {"lineitem": "1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 1d l_quantity, 1d l_extendedprice, 0d l_discount, "
                          "0d l_tax, 'R' l_returnflag, 'F' l_linestatus, date'1996-01-01' l_shipdate",
              "orders": "1L o_orderkey, 1L o_custkey, '2-HIGH' o_orderpriority",
              "customer": "1L c_custkey, 1L c_nationkey, 'BUILDING' c_mktsegment", "nation": "1L n_nationkey, 'Nation_1' n_name"}
    for name, columns in tables.items():
        spark.sql(f"select {columns}").write.parquet(str(tmp_path / f"{name}.parquet"))
    df = R.respondents(spark, str(tmp_path))
    assert [(r.caseid, r.state, r.party, r.year) for r in df.collect()] == [(11, "NATION_1", "REPUBLICAN", 2012)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [(found.start(), line) for line in plan if (found := re.search(r"[A-Z]", line))]
    at = next(i for i, (_, line) in enumerate(depth) if "l_orderkey" in line and "Relation" in line)
    above = [line for i, (d, line) in enumerate(depth[:at]) if "Join" in line and all(x > d for x, _ in depth[i + 1:at + 1])]
    assert len(above) == 1


def test_generated_code_is_small_enough_to_be_compiled(spark, resp, tmp_path):
    resp.write.parquet(str(tmp_path / "resp"))
    for key, wave in standin_waves(spark.read.parquet(str(tmp_path / "resp"))).items():
        assert largest_method(wave) < COMPILED_BYTES, key
    run = catalog.bind("harmonize_alt", lambda s, d: resp)
    assert largest_method(run(spark, str(tmp_path))) < COMPILED_BYTES


def test_items_of_harmonised_waves_are_as_rounded(spark, resp, tmp_path):
    def source(s, d):
        return resp

    got = catalog.bind("harmonize_alt", source)(spark, str(tmp_path))
    raw = harmonize_study(catalog.standin_wave_files(spark, str(tmp_path), source), ALT_CODING)
    assert sorted(map(str, got.collect())) == sorted(map(str, catalog.round_doubles(raw).collect()))
    assert got.where(F.col("weight") != F.round("weight", 6)).count() == 0
