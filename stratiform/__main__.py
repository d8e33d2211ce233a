"""Command line: list and run queries, check a configuration, and the whole way from cells to counts.

    python -m stratiform queries
    python -m stratiform query NAME TABLES [--out FOLDER]
    python -m stratiform check CONFIG.json
    python -m stratiform analyse CELLS.parquet STRUCTURE.csv FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratiform", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    do = parser.add_subparsers(dest="do", required=True)
    do.add_parser("queries", help="names of all queries")
    one = do.add_parser("query", help="run one query")
    one.add_argument("name")
    one.add_argument("tables")
    one.add_argument("--out")
    check = do.add_parser("check", help="issues of a run configuration; exit code 1 with an error among them")
    check.add_argument("config")
    whole = do.add_parser("analyse", help="leaf, hierarchy and slice tables of detected cells")
    whole.add_argument("cells")
    whole.add_argument("structure")
    whole.add_argument("out")
    a = parser.parse_args(arguments)

    from . import registry
    from .operators import runs, validate
    from .sources import files, scans

    if a.do == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.do == "query":
        if a.name not in registry.queries():
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        df = registry.queries()[a.name](spark, a.tables)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=False)
        return 0
    if a.do == "check":
        found = validate.issues(scans.json_documents(spark, a.config, "*").select(F.col("path").alias("config_id"), "doc")).collect()  # some rows a document
        for r in found:
            print(f"{r.severity}: {r.field}: {r.message}")
        return int(any(r.severity == "error" for r in found))
    tables = runs.analyse(spark.read.parquet(a.cells), files.structure_csv(spark, a.structure), None)
    for name in ("leaf", "hierarchy", "slices"):
        files.write_csv(tables[name], f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
