"""The first repair phase: a model judges persons' aliases, with a ledger of who was judged and what was changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import json_text
from ..operators.graph import Graph
from ..operators.repair import alias_suspects, apply_alias_verdicts
from ..sources.files import read_or
from ..sources.models import Client, ask_once

LEDGER = "uid string, outcome string, name string, original_aliases array<string>, correct_aliases array<string>, removed_aliases array<string>"
#: How long and how free answers may be.
OPTIONS = {"temperature": 0.05, "max_tokens": 2048}
VERDICT = "struct<correct_aliases:array<string>,wrong_aliases:array<string>>"
SYSTEM = 'Say which of the aliases are this person\'s, as JSON: {"correct_aliases": [], "wrong_aliases": []}'


def alias_prompts(persons: DataFrame) -> DataFrame:
    """(uid, name, aliases, prompt) for rows of persons."""
    some = lambda title, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(title), value.cast("string")))
    year = lambda c: F.nullif(F.col(c), F.lit(0))
    listed = F.array_join(F.transform("aliases", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n")
    parts = [some("Name: ", F.col("original_name")), some("Role: ", F.col("role")), some("Served: ", F.array_join("loyalty", "、")), some("Born: ", year("birth_year")), some("Died: ", year("death_year")), some("About: ", F.substring("description", 1, 200)), F.concat(F.lit("Aliases: "), F.size("aliases").cast("string")), listed]
    return persons.select("uid", F.col("original_name").alias("name"), "aliases", F.concat_ws("\n", *parts).alias("prompt"))


def judge_aliases(persons: DataFrame, client: Callable[[], Client], ledger: str, per_second: float | None = None) -> DataFrame:
    """Rows of LEDGER. outcome: fixed (wrong aliases were named), skipped (none were) or error (no answer, or none that can be read)."""
    # failed calls of an earlier run are made again when their persons are
    asked = ask_once(alias_prompts(persons), client, ledger, SYSTEM, OPTIONS, per_second, again=True)
    said = asked.withColumn("v", F.from_json(json_text(F.col("output")), VERDICT))
    outcome = F.when(F.col("v.correct_aliases").isNull(), "error").when(F.size(F.coalesce("v.wrong_aliases", F.array().cast("array<string>"))) > 0, "fixed").otherwise("skipped")
    return said.select("uid", outcome.alias("outcome"), "name", F.col("aliases").alias("original_aliases"), F.col("v.correct_aliases").alias("correct_aliases"), F.col("v.wrong_aliases").alias("removed_aliases"))


def clean_aliases(graph: Graph, root: str, client: Callable[[], Client], at_least: int = 3, fixed: DataFrame | None = None, resume: bool = True, per_second: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(persons with their aliases set, (outcome, n) of this run). Persons in fixed (uid) are left out and, unless resume is off, those in the ledger below root too.

    Failed ones are entered in the ledger as well, so that they are not asked again.
    """
    spark = graph.person.sparkSession
    done = read_or(spark, f"{root}/alias_ledger", LEDGER).select("uid")
    skip = done if resume else done.limit(0)
    skip = skip if fixed is None or not resume else skip.union(fixed.select("uid"))
    wanted = graph.person.join(alias_suspects(graph, at_least, skip).select("uid"), "uid")
    path = f"{root}/alias_runs/{spark.sparkContext.applicationId}-{spark.sql('SELECT uuid()').first()[0]}"
    judge_aliases(wanted, client, f"{root}/alias_calls", per_second).write.parquet(path)
    judged = spark.read.schema(LEDGER).parquet(path)
    judged.write.mode("append").parquet(f"{root}/alias_ledger")
    person = apply_alias_verdicts(graph.person, judged.where("outcome = 'fixed'").select("uid", "correct_aliases", F.col("removed_aliases").alias("wrong_aliases")))
    return person, judged.groupBy("outcome").agg(F.count("*").alias("n"))
