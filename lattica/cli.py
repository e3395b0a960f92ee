"""Command line: transpose (JSON or CSV to Parquet), merge (several tables to one), info, query, version."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lattica.engine import Engine
from lattica.sources import ingest

VERSION = "0.1.0"


def _types(items: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in items)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transpose")
    t.add_argument("-i", "--input", nargs="+", required=True)
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-t", "--type", choices=ingest.FORMATS, required=True)
    t.add_argument("-c", "--comment", default="")
    t.add_argument("--column-type", action="append", default=[], metavar="COLUMN=TYPE")
    t.add_argument("--default-type", default="STRING")
    m = sub.add_parser("merge")
    m.add_argument("-i", "--input", nargs="+", required=True)
    m.add_argument("-o", "--output", required=True)
    m.add_argument("-c", "--comment", default="")
    i = sub.add_parser("info")
    i.add_argument("input")
    q = sub.add_parser("query")
    q.add_argument("statement")
    q.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    sub.add_parser("version")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "version":
        print(VERSION)
        return
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    if a.command == "transpose":
        ingest.convert(spark, a.type, a.input, a.output, _types(a.column_type), a.default_type, a.comment)
    elif a.command == "merge":
        ingest.merge(spark, a.input, a.output, a.comment)
    elif a.command == "info":
        print(json.dumps(ingest.info(spark, a.input)))
    else:
        engine = Engine(spark)
        for item in a.table:
            name, path = item.split("=", 1)
            engine.catalog.load(name, "parquet", path)
        engine.plan(a.statement).show(truncate=False)


if __name__ == "__main__":
    main()
