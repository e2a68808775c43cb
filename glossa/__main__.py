"""Commands: ``python -m glossa build|update|parse|frontier|validate|search ...``, over Parquet pages (doc_ord, is_source, url, html)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from glossa import dims
from glossa.operators import graph, views
from glossa.plans import build, rebuild
from glossa.sources import pages as sources


def _report(meta) -> str:
    return ", ".join(f"{meta[c]} {c}" for c in ("documents", "in_corpus", "authors", "scripture", "edges"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glossa")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("build", "pages to a laid-out graph"), ("parse", "pages to documents, citations and passages"), ("frontier", "pages to bring next")):
        c = commands.add_parser(name, help=text)
        c.add_argument("pages")
        c.add_argument("out" if name != "frontier" else "--out", default=None)
        if name == "build":
            c.add_argument("--no-recurse", action="store_true", help="seeds only")
            c.add_argument("--no-layout", action="store_true", help="nodes without places")
            c.add_argument("--centre", default=None, help="the node in the middle")
    c = commands.add_parser("update", help="a store of parsed pages up to date, and its graph; only changed pages are parsed")
    c.add_argument("pages")
    c.add_argument("store")
    c.add_argument("out")
    c.add_argument("--keep", action="store_true", help="stored pages that aren't given stay")
    c = commands.add_parser("validate", help="curated pontiffs that an index page doesn't link to")
    c.add_argument("index")
    c.add_argument("--pattern", default=r"holy-father/([a-z0-9-]+)\.html")
    c = commands.add_parser("search", help="the best matches of a graph's labels")
    c.add_argument("graph")
    c.add_argument("query")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("glossa").getOrCreate()
    if args.command == "build":
        out = build.build_graph(spark.read.parquet(args.pages), args.centre, not args.no_recurse, not args.no_layout)
        for r in out["skipped"].limit(100).collect():
            print(f"[skip] {r['url']}: {r['error']}", file=sys.stderr)
        sources.write_graph({k: out[k] for k in ("nodes", "edges", "meta")}, args.out)
        sources.write_document(out, f"{args.out}/graph.json")
        print(_report(out["meta"].first()))
    elif args.command == "update":
        done = rebuild.update(spark, args.store, spark.read.parquet(args.pages), whole=not args.keep)
        print(", ".join(f"{v} {k}" for k, v in done.items()))
        out = rebuild.graph_of(spark, args.store)
        sources.write_graph(out, args.out)
        print(_report(out["meta"].first()))
    elif args.command == "parse":
        parsed = build.parse(spark.read.parquet(args.pages))
        for name, df in parsed.items():
            sources.write_json(df, f"{args.out}/{name}")
        sources.write_json(build.records(parsed), f"{args.out}/records")
    elif args.command == "frontier":
        parsed = build.parse(spark.read.parquet(args.pages))
        found = graph.frontier(parsed["documents"], parsed["citations"]).orderBy("seq").select("doc_key", "url")
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            for r in found.toLocalIterator():
                print(r["url"])
    elif args.command == "validate":
        index = spark.read.text(args.index, wholetext=True).withColumnRenamed("value", "html")
        missing = [r["slug"] for r in graph.missing_slugs(dims.pontiffs(spark), index, args.pattern).orderBy("slug").collect()]
        print("\n".join(missing))
        return int(bool(missing))
    else:
        nodes = spark.read.parquet(f"{args.graph}/nodes.parquet")
        for r in views.search(nodes, args.query).collect():
            print(f"{r['id']}\t{r['label']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
