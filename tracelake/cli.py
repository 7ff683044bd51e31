"""Command line.

    python -m tracelake.cli list
    python -m tracelake.cli index FOLDER [--out FOLDER] [--json]
    python -m tracelake.cli scan FOLDER --report bandit=FILE [--report osv=FILE ...] [--site-packages FOLDER] [--out FOLDER] [--json]
    python -m tracelake.cli QUERY DATA [--out FOLDER] [--json] [--rows N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans import registry, scan
from tracelake.sources import files, reports


def _write(tables: dict[str, DataFrame], out: str | None, as_json: bool, rows: int) -> None:
    for name, df in tables.items():
        if not out:
            print(name)
            df.show(rows, truncate=80)
        elif as_json:
            files.write_json(df, f"{out}/{name}" if len(tables) > 1 else out)
        else:
            df.write.mode("overwrite").parquet(f"{out}/{name}" if len(tables) > 1 else out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("query", help="list, index, scan, or the name of a query")
    p.add_argument("data", nargs="?", help="folder of the sources or the tables")
    p.add_argument("--out", help="folder for the results; else the first rows are shown")
    p.add_argument("--json", action="store_true", help="results as JSON lines, not Parquet")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--report", action="append", default=[], metavar="SOURCE=FILE", help="a saved scanner report")
    p.add_argument("--site-packages", help="folder of the installed distributions")
    a = p.parse_args(argv)
    known = registry.queries()
    if a.query == "list":
        print("\n".join(sorted(known)))
        return 0
    if a.query not in (*known, "index", "scan"):
        p.error("no such query")
    if not a.data:
        p.error("the folder is missing")
    saved = dict(r.split("=", 1) for r in a.report if "=" in r)
    if a.query == "scan" and (not saved or not set(saved) <= set(reports.PARSERS)):
        p.error(f"scan needs reports of {', '.join(sorted(reports.PARSERS))}")
    spark = SparkSession.builder.appName(a.query).getOrCreate()
    if a.query == "index":
        tables = scan.index(files.discover(spark, a.data))
        tables.pop("files")
    elif a.query == "scan":
        tables = scan.scan(spark, a.data, saved, a.site_packages)
    else:
        tables = {a.query: known[a.query](spark, a.data)}
    _write(tables, a.out, a.json, a.rows)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
