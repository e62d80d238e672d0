"""Command line: python -m kinloom COMMAND. The graph is the newest version that the ledger below --root names."""

from __future__ import annotations

import argparse
import functools
import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import chunk_table, numbered
from .operators.graph import Graph, load, save, save_changes, stats
from .operators.search import search_persons
from .plans.qa import answer
from .sources.files import read_books, stored_chunks, write_json
from .sources.models import Client, Http, Stub
from .sources.tables import graph_of
from .streaming.ingest import current_version, empty_graph, ingest_stream, load_seed, saved_results, write_results


def client_of(args: argparse.Namespace) -> Callable[[], Client]:
    """A maker of clients; without an address the offline stub answers."""
    if not args.url:
        return Stub
    return functools.partial(Http, args.url, args.model, os.environ.get("KINLOOM_KEY", ""))


def newest_graph(spark: SparkSession, root: str) -> Graph:
    version = current_version(spark, root)
    return load(spark, f"{root}/graph/{version}") if version else empty_graph(spark)


def publish(spark: SparkSession, graph: Graph, root: str, what: str, last: str | None = None, whole: bool = True) -> None:
    """Writes a snapshot, or what changes the version ``last``, and then names it in the ledger, so a run that is cut off changes nothing."""
    version = uuid.uuid4().hex
    if whole:
        save(graph, f"{root}/graph/{version}")
    else:
        save_changes(graph, f"{root}/graph", version, last)
    spark.range(1).select(F.lit(f"{what}-{version}").alias("chunk_id"), F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/ledger")


def show(rows: DataFrame, limit: int) -> None:
    for row in rows.limit(limit).toJSON().collect():
        print(row)


def process(spark: SparkSession, args: argparse.Namespace) -> None:
    make = lambda: numbered(chunk_table(read_books(spark, args.path), args.size, args.overlap)).select("chunk_id", "chapter", "content", "char_count")
    if args.again:
        write_json(make(), args.out)
    print(stored_chunks(spark, args.out, make).count())


def seed(spark: SparkSession, args: argparse.Namespace) -> None:
    publish(spark, graph_of(spark, args.path) if args.path else load_seed(spark, newest_graph(spark, args.root)), args.root, "seed")


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    ingest_stream(spark, args.path, args.root, client_of(args), args.files).awaitTermination()


def ingest_saved(spark: SparkSession, args: argparse.Namespace) -> None:
    written = write_results(newest_graph(spark, args.root), saved_results(spark, args.path))
    publish(spark, written.changed, args.root, "saved", current_version(spark, args.root), whole=False)


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    print(json.dumps(answer(newest_graph(spark, args.root), args.question, client_of(args)()), ensure_ascii=False))


def count(spark: SparkSession, args: argparse.Namespace) -> None:
    show(stats(newest_graph(spark, args.root)), args.limit)


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    show(search_persons(newest_graph(spark, args.root).person, args.words, args.limit), args.limit)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinloom")
    commands = top.add_subparsers(required=True)

    def add(name: str, run: Callable, about: str, *places: str, root: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        sub.set_defaults(run=run)
        for place in places:
            sub.add_argument(place)
        if root:
            sub.add_argument("--root", required=True, help="folder of results, snapshots and ledger")
        return sub

    cut = add("process", process, "books to chunk files", "path", "out", root=False)
    cut.add_argument("--size", type=int, default=1500)
    cut.add_argument("--overlap", type=int, default=200)
    cut.add_argument("--again", action="store_true", help="cut anew what is there already")
    add("seed", seed, "the seed rows, or a graph of the standard tables").add_argument("path", nargs="?")
    follow = add("ingest", ingest, "chunk files to the graph", "path")
    follow.add_argument("--files", type=int, default=1, help="files a batch")
    add("ingest-saved", ingest_saved, "saved results to the graph", "path")
    question = add("ask", ask, "answers a question", "question")
    for sub in (follow, question):
        sub.add_argument("--url", default="", help="chat endpoint; the key is read from KINLOOM_KEY")
        sub.add_argument("--model", default="")
    for sub in (add("stats", count, "counts by label and type"), add("search", search, "persons by words", "words")):
        sub.add_argument("--limit", type=int, default=100)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName("kinloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
