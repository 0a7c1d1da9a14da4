"""Command line: index a folder, search a collection, show what there is."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from inkwell.plans.index import index_folder, search_points
from inkwell.settings import Settings
from inkwell.sources.store import PointStore


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkwell")
    settings = Settings.load()
    parser.add_argument("--store", default=settings.store, help="folder of the point store; by default that of the settings")
    parser.add_argument("--collection", default="documents")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("folder", nargs="?", default=settings.documents)
    index.add_argument("--all", action="store_true", help="read and index again what earlier runs have")
    index.add_argument("--flat", action="store_true", help="leave out folders within the folder")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=20)
    search.add_argument("--rerank", type=int, default=5)
    commands.add_parser("info")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    store = PointStore(spark, args.store)
    if args.command == "index":
        print(index_folder(spark, store, args.folder, args.collection, recursive=not args.flat, incremental=not args.all))
    elif args.command == "search":
        rows = search_points(store, spark.createDataFrame([(0, args.query)], "query_id long, query string"), args.collection, args.top_k, args.rerank).collect()
        for r in rows:
            print(r["error"] or f"{r['rerank_rank']}. {r['source']} ({r['score']:.4f}) {(r['text'] or '')[:300]}")
        return int(any(r["error"] for r in rows))
    else:
        for r in store.info().collect():
            print(r.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
