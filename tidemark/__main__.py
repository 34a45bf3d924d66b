"""Command line: list the queries, show a plan, or run one over a folder of tables and write its result."""

from __future__ import annotations

import argparse

from tidemark.plans import registry
from tidemark.session import build_session, ship_package


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries and what they do")
    for name, text in (("explain", "formatted plan of a query"), ("run", "run a query")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("query", choices=sorted(registry.queries()))
        sub.add_argument("folder")
        if name == "run":
            sub.add_argument("--out", help="folder for Parquet files; without it the first rows are shown")
    given = parser.parse_args(args)
    if given.command == "list":
        for name, query in sorted(registry.queries().items()):
            print(f"{name}: {(query.__doc__ or '').strip().splitlines()[0]}")
        return 0
    spark = build_session()
    ship_package(spark)
    result = registry.queries()[given.query](spark, given.folder)
    if given.command == "explain":
        result.explain("formatted")
    elif given.out:
        result.write.mode("errorifexists").parquet(given.out)
    else:
        result.show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
