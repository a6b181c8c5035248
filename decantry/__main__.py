"""Command line: list the registered queries or run one and write its result.

    python -m decantry list
    python -m decantry run catalog_with_stock --data /root/testdata/sf0.1 --out /tmp/out/stock
    python -m decantry run kpi_cube --data /root/testdata/sf0.1 --show 20
    python -m decantry sql kpi_cube          # print the DuckDB twin

``--out`` writes Parquet (the rows never pass through the driver); ``--show`` prints a few rows.
``--master`` defaults to $DECANTRY_MASTER or local[8]; on a cluster submit with spark-submit.
"""

from __future__ import annotations

import argparse
import sys

from decantry.plans.registry import load_all


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m decantry")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries with their survey ids")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("name")
    run.add_argument("--data", required=True, help="folder with the parquet tables")
    run.add_argument("--out", help="write the result as parquet to this folder")
    run.add_argument("--show", type=int, default=0, help="print this many rows")
    run.add_argument("--master", default=None)
    sql = sub.add_parser("sql", help="print the DuckDB twin of a query")
    sql.add_argument("name")
    args = ap.parse_args(argv)

    queries = load_all()
    if args.cmd == "list":
        for name, q in sorted(queries.items(), key=lambda kv: (kv[1].survey_id, kv[0])):
            print(f"{q.survey_id:14s} {name}")
        return 0
    if args.name not in queries:
        print(f"unknown query {args.name!r}; see `python -m decantry list`", file=sys.stderr)
        return 2
    if args.cmd == "sql":
        print(queries[args.name].oracle)
        return 0

    from decantry.session import build_session
    spark = build_session(args.master)
    df = queries[args.name].fn(spark, args.data)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    if args.show:
        df.show(args.show, truncate=False)
    if not args.out and not args.show:
        df.write.format("noop").mode("overwrite").save()
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
