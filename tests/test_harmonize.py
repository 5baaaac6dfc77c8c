"""Harmonisation on small hand-written waves."""

from pyspark.sql import types as T

from wavestat import study as S
from wavestat.operators.harmonize import (ALT_CODING, COMBINED_SCHEMA, HarmonizeRules, combine_waves,
                                          harmonize_wave)


def same_types(a, b):
    return [(f.name, f.dataType) for f in a.fields] == [(f.name, f.dataType) for f in b.fields]


def manifest(**over):
    """Source names per target: defaults equal the target name, 'X' if not asked."""
    return [over.get(t, t) for t in S.HARMONISED_COLUMNS]


def test_text_wave(spark):
    schema = "caseid long, weight double, voting_more_than_once string, ballot_tampering string, " \
             "confidence string, birth_year string, gender string, race string, party string, state string"
    df = spark.createDataFrame([
        (1, 1.5, "it is very common", "It occurs infrequently", "very confident", "1970", "female", "9",
         "democrat", "ohio"),
        (2, 2.0, "IT OCCURS OCCASIONALLY", "PHONE - REFUSED", "-9", "n/a", "-1", "WHITE", "2", "Texas"),
        (3, 1.0, None, None, None, None, None, None, None, None),
    ], schema)
    src = manifest(**{c: "X" for c in S.HARMONISED_COLUMNS
                      if c not in ("caseid", "weight", "voting_more_than_once", "ballot_tampering",
                                   "confidence", "birth_year", "gender", "race", "party", "state")})
    out = combine_waves([harmonize_wave(df, src, 2012)])
    assert same_types(out.schema, COMBINED_SCHEMA)
    got = {r["caseid"]: r for r in out.collect()}
    assert set(got) == {1, 2}  # all-NULL item row dropped
    r1, r2 = got[1], got[2]
    assert (r1.voting_more_than_once, r1.ballot_tampering) == (1.0, 0.0)
    assert (r1.confidence, r1.birth_year, r1.gender, r1.race, r1.party, r1.state, r1.year) == (
        "VERY CONFIDENT", 1970, "FEMALE", None, "DEMOCRAT", "OHIO", 2012)
    assert (r2.voting_more_than_once, r2.ballot_tampering) == (1.0, None)
    assert (r2.confidence, r2.birth_year, r2.gender, r2.race, r2.party, r2.state) == (
        None, None, None, "WHITE", "REPUBLICAN", "TEXAS")


def test_numeric_codes_main_vs_alt(spark):
    schema = "caseid long, weight double, voting_more_than_once double, state int"
    df = spark.createDataFrame([(1, 1.0, 1.0, 39), (2, 1.0, 3.0, 3), (3, 1.0, 4.0, 48), (4, 1.0, 9.0, 1)],
                               schema)
    src = manifest(**{c: "X" for c in S.HARMONISED_COLUMNS
                      if c not in ("caseid", "weight", "voting_more_than_once", "state")})
    main = {r.caseid: (r.voting_more_than_once, r.state)
            for r in combine_waves([harmonize_wave(df, src, 2014)]).collect()}
    alt = {r.caseid: r.voting_more_than_once
           for r in combine_waves([harmonize_wave(df, src, 2014, HarmonizeRules(coding=ALT_CODING))]).collect()}
    assert main == {1: (1.0, "OHIO"), 2: (0.0, None), 3: (0.0, "TEXAS")}
    assert alt == {1: 1.0, 2: 1.0, 3: 0.0}


def test_exact_case_sensitive_source_names(spark):
    # the wave has both q1 and Q1; the manifest names Q1 for 'voted'
    df = spark.createDataFrame([(1, 1.0, "1", "YES", "NO")],
                               "caseid long, weight double, voting_more_than_once string, q1 string, Q1 string")
    src = manifest(voted="Q1", **{c: "X" for c in S.HARMONISED_COLUMNS
                                  if c not in ("caseid", "weight", "voting_more_than_once", "voted")})
    r = harmonize_wave(df, src, 2016).collect()[0]
    assert r.voted == "NO" and r.voting_more_than_once == 1.0


def test_codebook_decode(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 2.0, 3.0, "MALE", 6.0), (2, 1.0, 1.0, 5.0, 1.0, "7", 9.0)],
                               "caseid long, weight double, voting_more_than_once double, confidence double, "
                               "party double, gender string, race double")
    src = manifest(**{c: "X" for c in S.HARMONISED_COLUMNS
                      if c not in ("caseid", "weight", "voting_more_than_once", "confidence", "party",
                                   "gender", "race")})
    out = harmonize_wave(df, src, 2022, HarmonizeRules(), S.CODEBOOK_2022, S.CODEBOOK_2022_KEEPS_TEXT)
    got = {r.caseid: (r.confidence, r.party, r.gender, r.race) for r in out.collect()}
    assert got == {1: ("SOMEWHAT CONFIDENT", "INDEPENDENT", "MALE", "OTHER"), 2: (None, "DEMOCRAT", None, None)}


def test_union_casts_to_fixed_schema(spark):
    a = spark.createDataFrame([(1, 1.0, "1", 1970)], "caseid long, weight double, voting_more_than_once string, "
                                                     "birth_year int")
    b = spark.createDataFrame([("2", "2.5", 3.0, "1980")], "caseid string, weight string, "
                                                          "voting_more_than_once double, birth_year string")
    keep = ("caseid", "weight", "voting_more_than_once", "birth_year")
    src = manifest(**{c: "X" for c in S.HARMONISED_COLUMNS if c not in keep})
    out = combine_waves([harmonize_wave(a, src, 2008), harmonize_wave(b, src, 2012)])
    assert same_types(out.schema, COMBINED_SCHEMA)
    assert sorted((r.caseid, r.weight, r.birth_year) for r in out.collect()) == [(1, 1.0, 1970), (2, 2.5, 1980)]


def test_csv_wave_file_all_text(spark, tmp_path):
    from wavestat.sources.waves import read_wave
    path = str(tmp_path / "wave.csv")
    with open(path, "w") as f:
        f.write("caseid,weight,Q37A,pid3,inputstate,birthyr\n")
        f.write("11,1.25,2,1,Ohio,1980\n12,0.75,4,REPUBLICAN,Texas,x\n13,1.0,,3,,\n")
    df = read_wave(spark, path, "csv")
    src = manifest(voting_more_than_once="Q37A", party="pid3", state="inputstate", birth_year="birthyr",
                   **{c: "X" for c in S.HARMONISED_COLUMNS
                      if c not in ("caseid", "weight", "voting_more_than_once", "party", "state", "birth_year")})
    got = {r.caseid: (r.weight, r.voting_more_than_once, r.party, r.state, r.birth_year)
           for r in combine_waves([harmonize_wave(df, src, 2014)]).collect()}
    assert got == {11: (1.25, 1.0, "DEMOCRAT", "OHIO", 1980), 12: (0.75, 0.0, "REPUBLICAN", "TEXAS", None)}


def test_main_and_alt_differ_exactly_on_code_3(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from wavestat.sources.respondents import respondents
    from wavestat.sources.standin import standin_wave
    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        return
    key = "MITU0019_OUTPUT_50state_1"  # numeric answer codes
    year, sources = S.WAVE_MANIFEST[key]
    raw = standin_wave(respondents(spark, sf), key).withColumn("caseid", F.monotonically_increasing_id())
    raw.write.parquet(str(tmp_path / "w"))
    raw = spark.read.parquet(str(tmp_path / "w"))
    main = harmonize_wave(raw, sources, year)
    alt = harmonize_wave(raw, sources, year, HarmonizeRules(coding=ALT_CODING))
    items = [t for t, s_ in zip(S.HARMONISED_COLUMNS, sources) if t in S.FRAUD_ITEMS and s_ != "X"]
    codes = raw.select(F.col("caseid"), *[F.col(s_).alias(f"raw_{t}") for t, s_ in zip(S.HARMONISED_COLUMNS, sources)
                                          if t in items])
    j = (main.select("caseid", *[F.col(i).alias(f"m_{i}") for i in items])
         .join(alt.select("caseid", *[F.col(i).alias(f"a_{i}") for i in items]), "caseid")
         .join(codes, "caseid"))
    assert j.count() == raw.count()
    for i in items:
        differ = ~F.col(f"m_{i}").eqNullSafe(F.col(f"a_{i}"))
        code3 = F.col(f"raw_{i}") == 3.0
        assert j.filter(differ & ~F.coalesce(code3, F.lit(False))).count() == 0
        assert j.filter(code3 & ~((F.col(f"m_{i}") == 0.0) & (F.col(f"a_{i}") == 1.0))).count() == 0
    assert j.filter(F.col(f"raw_{items[0]}") == 3.0).count() > 0


def test_numeric_column_with_text_only_codes(spark):
    from wavestat.operators.harmonize import ResponseCoding
    coding = ResponseCoding(codes_one=("A",), codes_zero=("B",))  # no numeric codes at all
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 3.0)], "caseid long, weight double, voting_more_than_once double")
    src = manifest(**{c: "X" for c in S.HARMONISED_COLUMNS if c not in ("caseid", "weight", "voting_more_than_once")})
    out = harmonize_wave(df, src, 2014, HarmonizeRules(coding=coding)).collect()
    assert [r.voting_more_than_once for r in out] == [None, None]


def test_absent_wave_is_an_error(spark):
    import pytest

    from wavestat.operators.harmonize import harmonize_study
    with pytest.raises(ValueError, match="no input for wave"):
        harmonize_study({})


def test_label_dictionary_decodes_codes_and_keeps_other_values(spark):
    from wavestat.operators.harmonize import apply_labels, label_lookups
    dictionary = spark.createDataFrame([("w", "q", "1.0", "Very common"), ("w", "q", "2", "Never"), ("w", "G", "1", "Male"),
                                        ("other", "q", "1", "x"), ("w", "t", "a", "Alpha")],
                                       "wave string, column string, code string, label string")
    labels = label_lookups(dictionary)
    wave = spark.createDataFrame([(1.0, 1, "a", 1), (2.0, 2, "b", 2), (9.0, None, None, 3), (None, 1, "", 4)],
                                 "q double, g int, t string, id int").withColumnRenamed("g", "G")
    got = sorted((r.id, r.q, r.G, r.t) for r in apply_labels(wave, labels["w"]).collect())
    assert got == [(1, "Very common", "Male", "Alpha"), (2, "Never", "2", "b"), (3, "9", None, None), (4, None, "Male", "")]
    assert apply_labels(wave, {"missing": {"1": "x"}, "g": {"1": "no such column"}}).schema == wave.schema
    import pytest
    with pytest.raises(ValueError, match="two labels"):
        label_lookups(dictionary.unionByName(spark.createDataFrame([("w", "q", "2", "Seldom")], dictionary.schema)))
