"""Command line: ``python -m trellis query|explain|profile|validate|schema|run``."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trellis", description="Cypher over tables")
    parser.add_argument("command", choices=("query", "explain", "profile", "validate", "schema", "run"))
    parser.add_argument("text", nargs="?", default="", help="the query; for run, the configuration's file")
    parser.add_argument("--folder", help="folder of tables")
    parser.add_argument("--entity", action="append", default=[], metavar="LABEL=TABLE.KEY")
    parser.add_argument("--relationship", action="append", default=[], metavar="TYPE=TABLE.SOURCE>TARGET:LABEL>LABEL")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)

    from trellis.plans.validation import validate

    if args.command == "validate" and not args.folder:
        return _report(validate(args.text))

    from pyspark.sql import SparkSession

    from trellis.sources import discovery, pipeline

    spark = SparkSession.builder.appName("trellis").getOrCreate()
    if args.command == "run":
        for name, df in pipeline.run(spark, pipeline.load(args.text)).items():
            print(name)
            df.show(args.rows, False)
        return 0
    entities = {k: tuple(v.split(".")) for k, v in (e.split("=", 1) for e in args.entity)}
    relationships = {}
    for kind, rest in (r.split("=", 1) for r in args.relationship):
        table, _, columns = rest.partition(".")
        ends, _, labels = columns.partition(":")
        relationships[kind] = (table, *ends.split(">"), *labels.split(">"))
    session = discovery.discover(spark, args.folder, entities, relationships)
    if args.command == "validate":
        return _report(session.validate(args.text))
    if args.command == "schema":
        discovery.describe(session).show(10_000, False)
    elif args.command == "explain":
        print(session.explain(args.text))
    elif args.command == "profile":
        for phase, seconds, rows in session.profile(args.text):
            print(f"{phase}\t{seconds:.3f} s" + ("" if rows is None else f"\t{rows} rows"))
    else:
        session.cypher(args.text).show(args.rows, False)
    return 0


def _report(findings: list) -> int:
    for f in findings:
        print(f"{f.severity}: {f.message}")
    return int(any(f.severity == "error" for f in findings))


if __name__ == "__main__":
    sys.exit(main())
