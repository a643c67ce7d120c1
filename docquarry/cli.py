"""Command line: named queries, and collections of text files to ask, chat with, make QA pairs of, look into or empty."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans import catalog, service
from docquarry.sources import files
from docquarry.streaming import ingest


def collection(spark: SparkSession, path: str) -> DataFrame:
    """Points of a store, or of a collection that ``index`` wrote."""
    rows = ingest.Store(spark, path).points.read()
    return spark.read.parquet(path) if rows is None else rows


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docquarry", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(catalog.queries()))
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    index = sub.add_parser("index", help="chunk and embed text files into a Parquet collection")
    index.add_argument("pattern")
    index.add_argument("collection")
    take = sub.add_parser("ingest", help="take new text files into a store, as a stream; files that cannot be read are kept apart")
    take.add_argument("pattern")
    take.add_argument("collection")
    take.add_argument("--corpus", help="name of the corpus on the edges of the graph")
    drop = sub.add_parser("delete", help="take documents out of every table of a store")
    drop.add_argument("collection")
    drop.add_argument("doc_ids", nargs="+")
    ask = sub.add_parser("query", help="passages and an answer from a collection")
    ask.add_argument("collection")
    ask.add_argument("question")
    ask.add_argument("--topk", type=int, default=6)
    ask.add_argument("--engine", choices=("vector", "keyword", "hybrid"), default="hybrid")
    docs = sub.add_parser("list-docs", help="documents of a collection")
    docs.add_argument("collection")
    chat = sub.add_parser("chat", help="answer each line of the input from a collection, until an empty line")
    chat.add_argument("collection")
    chat.add_argument("--engine", choices=("vector", "keyword", "hybrid"), default="hybrid")
    pairs = sub.add_parser("qa-generate", help="write question-answer pairs of a document as JSON")
    pairs.add_argument("collection")
    pairs.add_argument("doc_id")
    pairs.add_argument("output")
    pairs.add_argument("-n", "--num", type=int, default=5)
    debug = sub.add_parser("debug-extract", help="write pages and chunks of files as JSON")
    debug.add_argument("pattern")
    debug.add_argument("output")
    reset = sub.add_parser("reset", help="empty a collection; its columns stay")
    reset.add_argument("collection")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    spark = SparkSession.builder.appName("docquarry").getOrCreate()
    if args.command == "run":
        rows = catalog.queries()[args.name](spark, args.folder)
        rows.write.mode("overwrite").parquet(args.out) if args.out else rows.show(truncate=False)
    elif args.command == "index":
        pages = files.extract_pages(files.read_files(spark, args.pattern), files.plain_pages)
        service.index(service.build_chunks(pages)).write.mode("append").parquet(args.collection)
    elif args.command == "ingest":
        store = ingest.Store(spark, args.collection)
        ingest.ingest(store, args.pattern, f"{args.collection}/checkpoint", files.strict_pages, corpus=args.corpus)
        ingest.progress(store).orderBy("batch").show(truncate=False)
        store.dead_letters.read().show(truncate=100)
    elif args.command == "delete":
        ingest.Store(spark, args.collection).delete(spark.createDataFrame([(d,) for d in args.doc_ids], "doc_id string"))
    elif args.command == "query":
        requests = [service.Request(args.question, args.topk)]
        hits = service.retrieve(collection(spark, args.collection), requests, args.engine)
        hits.orderBy("final_rank").show(truncate=100)
        service.answer(hits, requests).show(truncate=False)
    elif args.command == "chat":
        points = collection(spark, args.collection)
        for line in iter(lambda: sys.stdin.readline().strip(), ""):
            requests = [service.Request(line)]
            print(service.answer(service.retrieve(points, requests, args.engine), requests).first().answer)
    elif args.command == "qa-generate":
        points = collection(spark, args.collection).where(F.col("doc_id") == args.doc_id)
        files.write_qa(service.qa_pairs(points, args.num), args.output)
    elif args.command == "debug-extract":
        pages = files.extract_pages(files.read_files(spark, args.pattern), files.plain_pages)
        pages.write.mode("overwrite").json(f"{args.output}/pages")
        service.build_chunks(pages).write.mode("overwrite").json(f"{args.output}/nodes")
    elif args.command == "reset" and (store := ingest.Store(spark, args.collection)).points.manifest():
        store.reset()
    elif args.command == "reset":
        schema = spark.read.parquet(args.collection).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(args.collection)
    else:
        collection(spark, args.collection).groupBy("doc_id").agg(F.count("*").alias("chunks")).orderBy("doc_id").show(1000, truncate=False)


if __name__ == "__main__":
    main()
