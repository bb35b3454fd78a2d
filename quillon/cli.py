"""Command line: list the queries, run one on a folder of tables, count a feed, search the catalogue.

    python -m quillon.cli list
    python -m quillon.cli run momentum_backtest --tables /data --out /results/momentum
    python -m quillon.cli stats --tables /data
    python -m quillon.cli search "momentum reversal" --tables /data --status attempted
    python -m quillon.cli spec "some title" --tables /data
    python -m quillon.cli code momentum_backtest
"""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import registry


def session(name: str = "quillon") -> SparkSession:
    """The session of spark-submit, or a local one; times are UTC."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def run(spark: SparkSession, name: str, tables: str) -> DataFrame:
    queries, _ = registry.load()
    if name not in queries:
        raise SystemExit(f"no query {name}; try list")
    return queries[name](spark, tables.rstrip("/"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__.split("\n")[0])
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("list")
    one = sub.add_parser("run")
    one.add_argument("name")
    one.add_argument("--out", help="Parquet folder; without it the first rows are shown")
    stats = sub.add_parser("stats")
    find = sub.add_parser("search")
    find.add_argument("words", nargs="?", default="")
    find.add_argument("--status", default="")
    find.add_argument("--kind", default="")
    find.add_argument("--limit", type=int, default=20)
    spec = sub.add_parser("spec")
    spec.add_argument("idea")
    sub.add_parser("code").add_argument("name")
    for p in (one, stats, find, spec):
        p.add_argument("--tables", required=True, help="folder of Parquet tables")
    args = parser.parse_args(argv)
    if args.verb == "list":
        queries, sql = registry.load()
        for name in sorted(queries):
            print(f"{name}{'' if name in sql else '  (no SQL form)'}")
        return 0
    if args.verb == "code":
        queries, _ = registry.load()
        if args.name not in queries:
            print(f"no implementation of {args.name}; try search")
            return 1
        print(inspect.getsource(queries[args.name]))
        return 0
    spark = session()
    if args.verb == "run":
        df = run(spark, args.name, args.tables)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(50, truncate=False)
    elif args.verb == "stats":
        run(spark, "source_counts", args.tables).orderBy("source", "lang").show(200, truncate=False)
    else:
        from quillon.operators import ranking
        from quillon.plans.catalogue import catalogue

        items = catalogue(spark, args.tables.rstrip("/"))
        if args.verb == "spec":
            ranking.described(items, args.idea).show(1, truncate=False, vertical=True)
            return 0
        ranking.search(items, args.words, args.status, args.kind, args.limit).show(args.limit, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
