"""Run any registered query from the command line.

    python -m ledgerloom --list
    python -m ledgerloom supplier_balances /root/testdata/sf0.01 --show 20
    python -m ledgerloom finance_daily /data/erp --stored /data/erp_catalog --out /data/reports/daily

Without ``--stored`` the ERP tables are derived from the driver tables in
``data_dir``; with it they are read from a catalog written by
``materialize_catalog``. ``--out`` writes Parquet from the executors;
``--show`` prints the first rows (nothing else is collected).
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="ledgerloom")
    ap.add_argument("key", nargs="?")
    ap.add_argument("data_dir", nargs="?")
    ap.add_argument("--stored", help="catalog written by materialize_catalog")
    ap.add_argument("--out", help="write the result here as Parquet")
    ap.add_argument("--show", type=int, default=0, help="print the first N rows")
    ap.add_argument("--list", action="store_true", help="list the registered query keys")
    args = ap.parse_args(argv)

    from ledgerloom.plans.registry import entries

    reg = entries()
    if args.list or not args.key:
        print("\n".join(sorted(reg)))
        return 0
    if args.key not in reg or not args.data_dir:
        ap.error(f"unknown key {args.key!r} or missing data_dir (see --list)")

    from pyspark.sql import SparkSession

    from ledgerloom.session import ensure_checkpoint_dir
    from ledgerloom.sources.catalog import load_catalog

    spark = SparkSession.builder.appName(f"ledgerloom-{args.key}").getOrCreate()
    ensure_checkpoint_dir(spark)
    df = reg[args.key][0](load_catalog(spark, args.data_dir, materialized=args.stored))
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=False)
    if not args.out and not args.show:
        df.printSchema()
    return 0


if __name__ == "__main__":
    sys.exit(main())
