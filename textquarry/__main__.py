"""Command line: python -m textquarry WORKSPACE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from textquarry.session import session
from textquarry.workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry", description="Datasets, documents and reviews in a workspace folder.")
    p.add_argument("workspace")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, help: str) -> None:  # noqa: A002
        c = sub.add_parser(name, help=help)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    a = lambda *flags, **options: (flags, options)
    command("prepare", a("source"), a("--name", required=True), a("--seed", type=int, default=42), a("--provenance", default="user-provided"), help="clean and split a CSV or JSON Lines file")
    command("evaluate", a("run"), a("dataset"), a("predictions"), a("--split", default="test"), help="score predictions (Parquet: source_line, p)")
    command("compare", a("runs", nargs="+"), a("--split", default="validation"), help="rank runs over one dataset")
    command("ingest", a("file"), a("--format", default="text", choices=("text", "jats")), a("--title", default=""), help="store a document")
    command("list", help="stored documents")
    command("extract", a("name"), a("--entities"), help="evidence records of all documents")
    command("review", a("extraction"), a("record"), a("status"), a("--revision", type=int, default=0), a("--reviewer", required=True), a("--correction", default="{}"), help="append a review")
    command("history", a("extraction"), a("record"), help="revisions of a record")
    command("search", a("name"), a("query"), help="records that hold all terms")
    command("export", a("name"), a("--mode", default="approved"), help="approved records, or all")
    return p


def main(arguments: list[str] | None = None) -> int:
    o = parser().parse_args(arguments)
    spark = session()
    w = Workspace(spark, o.workspace)
    show = lambda df: [print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)) for r in df.toLocalIterator()]
    try:
        if o.command == "prepare":
            show(w.prepare(o.source, o.name, o.seed, o.provenance))
        elif o.command == "evaluate":
            show(w.evaluate(o.run, o.dataset, spark.read.parquet(o.predictions), o.split))
        elif o.command == "compare":
            show(w.compare(o.runs, o.split))
        elif o.command == "ingest":
            raw = spark.read.text(o.file, wholetext=True).selectExpr("value AS content")
            from pyspark.sql import functions as F

            show(w.ingest(raw.select("content", F.lit(o.format).alias("format"), F.lit(o.title).alias("title"), F.lit(o.file).alias("source"))).select("id", "sha256"))
        elif o.command == "list":
            show(w.documents())
        elif o.command == "extract":
            show(w.extract(o.name, spark.read.parquet(o.entities) if o.entities else None).select("extraction_id", "id", "category", "text"))
        elif o.command == "review":
            w.review(o.extraction, o.record, o.revision, o.status, o.reviewer, json.loads(o.correction))
        elif o.command == "history":
            show(w.history(o.extraction, o.record))
        elif o.command == "search":
            show(w.search(o.name, o.query))
        else:
            for name, frame in w.export(o.name, o.mode).items():
                print(f"# {name}")
                show(frame)
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
