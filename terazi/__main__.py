"""python -m terazi [QUERY [FOLDER]]: the queries' names, or the first rows of one over a folder of tables, or with --plan its plan."""

from __future__ import annotations

import argparse


def main() -> None:
    from terazi.plans import catalog
    from terazi.session import build_session

    parser = argparse.ArgumentParser(prog="terazi", description=__doc__)
    parser.add_argument("query", nargs="?", choices=sorted(catalog.queries()), metavar="QUERY")
    parser.add_argument("folder", nargs="?", default="/root/testdata/sf0.001", metavar="FOLDER")
    parser.add_argument("--rows", type=int, default=20, help="how many rows to show")
    parser.add_argument("--plan", action="store_true", help="show the plan instead")
    asked = parser.parse_args()
    if asked.query is None:
        print("\n".join(sorted(catalog.queries())))
        return
    spark = build_session("terazi")
    rows = catalog.queries()[asked.query](spark, asked.folder)
    if asked.plan:
        rows.explain("formatted")
    else:
        rows.show(asked.rows, truncate=80)
    spark.stop()


if __name__ == "__main__":
    main()
