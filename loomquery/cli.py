"""Command line: ``python -m loomquery search QUERY -f FILE``."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .engine import SearchEngine, strategies
from .functions.text import field_list
from .sources import corpus as io


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomquery", description="Search texts or records without an index.")
    commands = out.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="search a JSON array")
    search.add_argument("query")
    search.add_argument("-f", "--file", help="JSON file; standard input if absent")
    search.add_argument("-s", "--strategy", default="cascade", choices=[*strategies(), "auto"])
    search.add_argument("-k", "--top-k", type=int, default=10)
    search.add_argument("--text-fields", help="comma-separated fields of the records to search")
    serve = commands.add_parser("serve", help="answer HTTP requests")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--origin", help="allowed origin of cross-site requests")
    train = commands.add_parser("train", help="train a projection on a JSON array of strings and store it")
    train.add_argument("-f", "--file", help="JSON file; standard input if absent")
    for command in (search, serve, train):
        command.add_argument("--model-path", required=command is train, help="folder of the stored projection")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; 0 on success, 1 with a message on bad input."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomquery").getOrCreate()
    if args.command == "serve":
        from .server import serve

        serve(spark, args.host, args.port, args.model_path, args.origin)
        return 0
    try:
        if args.file:
            with open(args.file, encoding="utf-8") as f:
                items = io.parse_json(f)
        else:
            items = io.parse_json(sys.stdin)
        if args.command == "train":
            SearchEngine(spark, "projection").train(io.need_strings(items), model_path=args.model_path)
            return 0
        engine = SearchEngine(spark, args.strategy, model_path=args.model_path)
        if args.text_fields:
            table = io.from_objects(spark, items)
            start = time.perf_counter()
            found = engine.search_objects(args.query, table, field_list(args.text_fields), args.top_k).collect()
            took = (time.perf_counter() - start) * 1000
        else:
            found, took = engine.search_timed(args.query, io.need_strings(items), args.top_k)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    io.write_json(io.response(args.query, engine.strategy, found, len(items), took))
    return 0
