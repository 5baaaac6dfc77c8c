#!/usr/bin/env python
"""Benchmark the registered products.

Runs like the study's own workflow: the combined respondent table is built
once and written (partitioned by year), the raw wave files are written once,
then every product reads them and is executed in full (``noop`` sink, nothing
collected).  Prints ONE JSON line:

  {"metric": "products_total_sec", "value": N, "unit": "sec", "queries": {...}, "setup": {...}, "sf": ...}

``value`` sums the product times; ``setup`` holds the input preparation
(building the combined table from the driver tables, writing the raw wave
files), which is timed but not part of ``value``.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_ONLY (comma-separated product names, optional).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavestat.plans import catalog  # noqa: E402
from wavestat.session import checkpoint_dir, get_session  # noqa: E402
from wavestat.sources.respondents import respondents  # noqa: E402
from wavestat.sources.waves import read_combined, write_combined  # noqa: E402


def run_full(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    # scratch under the shared checkpoint folder (never a machine-local folder)
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    times: dict[str, float] = {}
    setup: dict[str, float] = {}

    t0 = time.time()
    combined_path = f"{scratch}/combined"
    write_combined(respondents(spark, sf_dir), combined_path)
    setup["build_combined"] = round(time.time() - t0, 3)

    def resp_source(s, _sf_dir):
        return read_combined(s, combined_path)

    t0 = time.time()
    catalog.standin_wave_files(spark, sf_dir, resp_source)
    setup["write_raw_waves"] = round(time.time() - t0, 3)

    for name in catalog.PRODUCTS:
        if only and name not in only:
            continue
        t0 = time.time()
        run_full(catalog.bind(name, resp_source, rounded=False)(spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "products_total_sec", "value": total, "unit": "sec", "queries": times,
                      "setup": setup, "sf": sf, "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
