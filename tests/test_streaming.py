"""The harmonise projection on a file stream equals the batch result."""

import tempfile

from wavestat import study as S
from wavestat.operators.harmonize import harmonize_wave, combine_waves
from wavestat.streaming import append_waves_stream, harmonize_wave_stream


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="wavestat-stream-", dir="/tmp")
    schema = "caseid long, weight double, voting_more_than_once string, party string"
    df = spark.createDataFrame([(1, 1.0, "IT IS VERY COMMON", "1"), (2, 2.0, "IT ALMOST NEVER OCCURS", "3"),
                                (3, 1.0, None, "2")], schema)
    df.write.parquet(f"{base}/in/part1")
    src = [t if t in ("caseid", "weight", "voting_more_than_once", "party") else "X"
           for t in S.HARMONISED_COLUMNS]
    stream = harmonize_wave_stream(spark, f"{base}/in/part1", df.schema, src, 2016)
    q = append_waves_stream(stream, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    got = sorted((r.caseid, r.voting_more_than_once, r.party) for r in spark.read.parquet(f"{base}/out").collect())
    want = sorted((r.caseid, r.voting_more_than_once, r.party)
                  for r in combine_waves([harmonize_wave(df, src, 2016)]).collect())
    assert got == want == [(1, 1.0, "DEMOCRAT"), (2, 0.0, "INDEPENDENT")]
