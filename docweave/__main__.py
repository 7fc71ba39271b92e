"""python -m docweave process|capabilities|ontology-check|self-check"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("process", help="files to relations")
    p.add_argument("path")
    p.add_argument("--out", required=True)
    p.add_argument("--max-tokens", type=int, default=512)
    p.add_argument("--embed", action="store_true")
    p.add_argument("--format", choices=("parquet", "json"), default="parquet")
    commands.add_parser("capabilities")
    commands.add_parser("self-check")
    o = commands.add_parser("ontology-check")
    o.add_argument("file")
    args = parser.parse_args(argv)
    if args.command == "ontology-check":
        from docweave.plans import ontology

        try:
            print(json.dumps(ontology.report(ontology.compile_ontology(ontology.load(args.file))), indent=2))
            return 0
        except ontology.OntologyError as e:
            for place, message in e.problems:
                print(f"{place}: {message}", file=sys.stderr)
            return 1
    from docweave.plans import process, providers, settings
    from docweave.sources import documents, sinks

    if args.command == "capabilities":
        print(json.dumps(process.capabilities(), indent=2))
        return 0
    spark = SparkSession.builder.appName("docweave").getOrCreate()
    if args.command == "self-check":
        result = process.self_check(spark)
        print(json.dumps(result))
        return 0 if result["status"] == "ok" else 1
    conf = settings.load({"chunking": {"max_tokens": args.max_tokens}})
    items = documents.items(documents.scan(spark, args.path, max_mb=conf.service.max_mb))
    out = process.process(items, conf, (lambda: providers.HashingEmbedder(64)) if args.embed else None)
    sinks.write_relations(out, args.out, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
