"""``python -m corpusmill``: list the queries, or run one over a folder of tables."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ls", help="names of the queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("tables", help="folder with the Parquet tables")
    run.add_argument("--out", help="write the result there as Parquet, instead of showing it")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    run.add_argument("--explain", action="store_true", help="show the plan only")
    args = parser.parse_args(argv)

    from corpusmill.plans import catalogue

    queries = catalogue.queries()
    if args.command == "ls":
        print("\n".join(sorted(queries)))
        return 0
    if args.name not in queries:
        print(f"no query {args.name!r}", file=sys.stderr)
        return 2
    from corpusmill.runtime import local_session

    spark = local_session()
    df = queries[args.name](spark, args.tables)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").parquet(args.out)
    else:
        df.show(args.rows, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main())
