"""Command line: build the combined table from raw wave files, then write the
product tables.

  python -m wavestat.cli build  --waves DIR --out COMBINED [--format parquet|csv|json|orc] [--alt]
  python -m wavestat.cli report --combined COMBINED --out DIR [--raw-2008 PATH] [--products NAME ...]

``build`` reads ``DIR/<wave key>`` for every wave of the study manifest
(the key names of ``study.WAVE_MANIFEST``), harmonises and writes the combined
table partitioned by year.  ``report`` runs the products on the combined
table with the study's own configuration (its swing-state sets) and writes
one result table per product.  Both run on whatever session the environment
provides (``spark.checkpoint.dir`` must name shared storage on a cluster).
"""

from __future__ import annotations

import argparse
import os

from wavestat import study as S
from wavestat.operators.design import flag_table
from wavestat.operators.harmonize import ALT_CODING, MAIN_CODING, harmonize_study
from wavestat.plans import catalog
from wavestat.session import get_session
from wavestat.sources.waves import read_combined, read_wave, write_combined, write_result


def build(spark, waves_dir: str, out: str, fmt: str = "parquet", alt: bool = False) -> None:
    raw = {}
    for key in S.WAVE_MANIFEST:
        path = f"{waves_dir.rstrip('/')}/{key}"
        if fmt != "parquet" and os.path.exists(f"{path}.{fmt}"):
            path = f"{path}.{fmt}"
        raw[key] = read_wave(spark, path, fmt)
    write_combined(harmonize_study(raw, ALT_CODING if alt else MAIN_CODING), out)


def report(spark, combined: str, out: str, raw_2008: str | None = None, products=None,
           fmt: str = "parquet") -> list[str]:
    resp = read_combined(spark, combined)
    swing = flag_table(spark, S.SWING_BY_YEAR)
    unknown = [name for name in products or () if name not in catalog.PRODUCTS]
    if unknown:
        raise ValueError(f"unknown product(s): {', '.join(unknown)}")
    missing = [name for name in products or () if catalog.PRODUCTS[name][0] == catalog.RAW and not raw_2008]
    if missing:
        raise ValueError(f"the raw 2008 wave is needed for: {', '.join(missing)}")
    written = []
    for name, (kind, product, *extra) in catalog.PRODUCTS.items():
        if products and name not in products:
            continue
        if kind == catalog.RESP:
            df = product(resp)
        elif kind == catalog.SWING:
            df = product(resp, swing)
        elif kind == catalog.RAW and raw_2008:
            df = product(read_wave(spark, raw_2008))
        else:
            continue  # harmonisation is the build step; the raw-2008 model needs its file
        write_result(df, f"{out.rstrip('/')}/{name}", fmt)
        written.append(name)
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="wavestat")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="harmonise raw wave files into the combined table")
    b.add_argument("--waves", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--format", default="parquet")
    b.add_argument("--alt", action="store_true", help="sensitivity coding (code 3 counts as belief)")
    r = sub.add_parser("report", help="write the product tables")
    r.add_argument("--combined", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--raw-2008")
    r.add_argument("--products", nargs="*")
    r.add_argument("--format", default="parquet")
    args = ap.parse_args(argv)
    spark = get_session()
    if args.cmd == "build":
        build(spark, args.waves, args.out, args.format, args.alt)
    else:
        for name in report(spark, args.combined, args.out, args.raw_2008, args.products, args.format):
            print(name)


if __name__ == "__main__":
    main()
