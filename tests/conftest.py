import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from wavestat.session import get_session
    SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
    s = get_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()
