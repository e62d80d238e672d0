"""Summaries of persons and events by a model, for any number of uids at once, with a cache.

Prompts are made by joins; what a prompt lists is bounded by its row limits, so lists stay short however many links a node has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import PARTICIPATED, RELATION_LABELS
from ..operators.graph import Graph, labelled_relations
from ..operators.search import event_snippets
from ..sources.files import cached_or, checkpoint_dir
from ..sources.models import Client, ask_once

CACHE = "key string, type string, uid string, summary string"
#: What stands for nothing.
NONE, UNKNOWN = "无", "未知"
#: How long and how free answers may be.
OPTIONS = {"person": {"temperature": 0.3, "max_tokens": 2048}, "event": {"temperature": 0.3, "max_tokens": 1500}}
SYSTEM = {"person": "Tell this person's life from the facts given, in order of time, as Markdown.", "event": "Tell this event's cause, course and outcome from the facts given, as Markdown."}


def cache_key(kind: Column, uid: Column) -> Column:
    """A name that is safe as a file's."""
    return F.concat(kind, F.lit("_"), F.replace(uid, F.lit("/"), F.lit("_")))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))


def _if(value: Column, *parts: Column | str) -> Column:
    """The parts as one text where the value is there, else nothing."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def _listed(rows: DataFrame, order: list, limit: int, line: Column, name: str) -> DataFrame:
    """(uid, name, n_name): each uid's first lines in order, one below the other, and their number.

    Spark cuts each task's rows to the first ``limit`` of a uid before they are shuffled, so a node with many links sends few."""
    ranked = rows.select("uid", F.row_number().over(Window.partitionBy("uid").orderBy(*order)).alias("r"), F.concat(F.lit("- "), line).alias("line")).where(F.col("r") <= limit)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return ranked.groupBy("uid").agg(lines.alias(name), F.count("*").alias(f"n_{name}"))


def person_prompts(graph: Graph, uids: DataFrame, relations: int = 50, events: int = 30) -> DataFrame:
    """(uid, prompt) for persons."""
    wanted = uids.select("uid").distinct()
    edges = graph.edges.where(F.col("rel_type") != PARTICIPATED)
    out = edges.join(wanted.withColumnRenamed("uid", "src"), "src").select(F.col("src").alias("uid"), F.col("dst").alias("other"), "rel_type", "seq", F.lit("→").alias("way"))
    into = edges.where("src <> dst").join(wanted.withColumnRenamed("uid", "dst"), "dst").select(F.col("dst").alias("uid"), F.col("src").alias("other"), "rel_type", "seq", F.lit("←").alias("way"))
    near = labelled_relations(out.union(into), RELATION_LABELS).join(graph.nodes().select(F.col("uid").alias("other"), "name"), "other")
    ties = _listed(near, ["seq", "other", "rel_type", "way"], relations, F.concat_ws(" ", "way", "label", "name"), "ties")
    took = graph.edges.where(F.col("rel_type") == PARTICIPATED).join(wanted.withColumnRenamed("uid", "src"), "src").select(F.col("src").alias("uid"), F.col("dst").alias("event"))
    took = took.join(graph.event.withColumnRenamed("uid", "event"), "event")
    line = F.concat(_if(F.nullif("year", F.lit(0)), "[", F.col("year").cast("string"), "] "), F.col("name"), _if(F.col("event_type"), "（", F.col("event_type"), "）"), _if(F.col("description"), "：", F.substring("description", 1, 60)))
    done = _listed(took, [F.asc_nulls_last("year"), "event"], events, line, "events")
    p = graph.person.join(wanted, "uid").join(ties, "uid", "left").join(done, "uid", "left")
    year = lambda c: _or(F.nullif(F.col(c), F.lit(0)), "?")
    lines = [
        F.concat(F.lit("Name: "), F.col("original_name")), F.concat(F.lit("Also called: "), _or(F.array_join("aliases", "、"), NONE)), F.concat(F.lit("Role: "), _or(F.col("role"), UNKNOWN)),
        F.concat(F.lit("Served: "), _or(F.array_join("loyalty", " → "), UNKNOWN)), F.concat(F.lit("Lived: "), year("birth_year"), F.lit(" — "), year("death_year")), F.concat(F.lit("Died of: "), _or(F.col("death_cause"), UNKNOWN)),
        F.concat(F.lit("About: "), _or(F.col("description"), NONE)), F.concat(F.lit("Relations: "), _or(F.col("n_ties"), "0")), _or(F.col("ties"), NONE), F.concat(F.lit("Events: "), _or(F.col("n_events"), "0")), _or(F.col("events"), NONE),
    ]
    return p.select("uid", F.concat_ws("\n", *lines).alias("prompt"))


def event_prompts(graph: Graph, uids: DataFrame, books: DataFrame, snippets: int = 2, persons: int = 1000) -> DataFrame:
    """(uid, prompt) for events, with passages of books (name, text) that name them."""
    wanted = graph.event.join(uids.select("uid").distinct(), "uid")
    links = graph.edges.where(F.col("rel_type") == PARTICIPATED).select(F.col("dst").alias("uid"), F.col("src").alias("person"), F.col("role").alias("event_role"))
    people = links.join(wanted.select("uid"), "uid").join(graph.person.select(F.col("uid").alias("person"), "original_name", "role"), "person")
    line = F.concat(F.col("original_name"), _if(F.col("role"), "（", F.col("role"), "）"), _if(F.col("event_role"), "，", F.col("event_role")))
    total = people.groupBy("uid").agg(F.count("*").alias("all_people"))
    people = _listed(people, ["original_name", "person", "event_role"], persons, line, "people")
    said = event_snippets(wanted, books, snippets)
    said = _listed(said, ["book", "keyword_no", "at"], snippets, F.concat(F.lit("《"), F.col("book"), F.lit("》"), F.substring("text", 1, 200)), "said")
    e = wanted.join(people, "uid", "left").join(total, "uid", "left").join(said, "uid", "left")
    lines = [
        F.concat(F.lit("Event: "), F.col("name")), F.concat(F.lit("Kind: "), _or(F.col("event_type"), UNKNOWN)), F.concat(F.lit("Year: "), _or(F.nullif(F.col("year"), F.lit(0)), UNKNOWN)), F.concat(F.lit("Place: "), _or(F.col("location"), UNKNOWN)),
        F.concat(F.lit("Outcome: "), _or(F.col("outcome"), UNKNOWN)), F.concat(F.lit("About: "), _or(F.col("description"), NONE)), F.concat(F.lit("Present: "), _or(F.col("all_people"), "0")), _or(F.col("people"), NONE), F.concat(F.lit("Passages: "), _or(F.col("n_said"), "0")), _or(F.col("said"), NONE),
    ]
    return e.select("uid", F.concat_ws("\n", *lines).alias("prompt"))


def summaries(kind: str, prompts: DataFrame, cache: DataFrame, client: Callable[[], Client], ledger: str | None = None, per_second: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((uid, summary, from_cache), rows to append to the cache). Only uids that the cache lacks go to the model; a failed call gives no row.

    The calls are made here, once, and kept in a ledger (a new one below the checkpoint folder by default): both results are read from it, as often as wanted.
    """
    spark = prompts.sparkSession
    if ledger is None:
        checkpoint_dir(spark)
        ledger = f"{spark.sparkContext.getCheckpointDir()}/calls-{uuid.uuid4().hex}"
    keyed = prompts.withColumn("key", cache_key(F.lit(kind), F.col("uid")))
    hits, rest = cached_or(keyed, cache.where((F.col("type") == kind) & F.col("summary").isNotNull() & (F.col("summary") != "")), ["key"], "summary")
    asked = ask_once(rest, client, ledger, SYSTEM[kind], OPTIONS[kind], per_second)
    new = asked.where("output IS NOT NULL").select("key", F.lit(kind).alias("type"), "uid", F.col("output").alias("summary"))
    return hits.select("uid", "summary", F.lit(True).alias("from_cache")).unionByName(new.select("uid", "summary", F.lit(False).alias("from_cache"))), new
