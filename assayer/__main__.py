"""Command line: ``list`` names the recipes, ``bench NAME`` runs one and writes its report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from assayer.plans.recipes import RECIPES, run_named


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="assayer")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    b = sub.add_parser("bench")
    b.add_argument("name")
    b.add_argument("--data", required=True, help="folder of the Parquet tables")
    b.add_argument("--out", help="folder of the report")
    b.add_argument("--quiet", action="store_true")
    a = p.parse_args(args)
    if a.command == "list":
        for name, r in RECIPES.items():
            print(f"{name}: {r.about}")
        return 0
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    result = run_named(a.name, spark, a.data, None if a.quiet else lambda s: print(s, file=sys.stderr))
    if a.out:
        result.write(a.out)
    print(result.to_markdown())
    return 0


if __name__ == "__main__":
    sys.exit(main())
