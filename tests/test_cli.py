"""Build + report from wave files, with the study's own configuration."""

import os

from wavestat import cli
from wavestat.sources.respondents import respondents
from wavestat.sources.standin import write_standin_waves

SF = "/root/testdata/sf0.001"


def test_build_and_report(spark, tmp_path):
    if not os.path.exists(SF):
        return
    waves = write_standin_waves(respondents(spark, SF), str(tmp_path / "waves"))
    cli.build(spark, str(tmp_path / "waves"), str(tmp_path / "combined"))
    comb = spark.read.parquet(str(tmp_path / "combined"))
    assert comb.count() > 0 and "year" in comb.columns
    done = cli.report(spark, str(tmp_path / "combined"), str(tmp_path / "out"), raw_2008=waves["spae_2008"],
                      products=["belief_share_by_item", "swing_effect", "confidence_crosstab",
                                "logit_table_2008"])
    assert done == ["belief_share_by_item", "confidence_crosstab", "swing_effect", "logit_table_2008"]
    assert spark.read.parquet(str(tmp_path / "out" / "belief_share_by_item")).count() == 20
