"""Language models behind one call, with an offline stub; calls run in tasks, a batch of rows at a time."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import in_order
from .files import read_or

#: A call in the ledger.
CALL = "key string, output string, at timestamp"


class Client(Protocol):
    """chat() takes options of one call (temperature, max_tokens) besides the messages; callers that have none pass none."""

    def chat(self, messages: list[dict[str, str]], **options: float) -> str: ...


class Stub:
    """Answers by rule, the same for the same prompt: fixed answers by substring, else an empty extraction."""

    def __init__(self, answers: dict[str, str] | None = None) -> None:
        self.answers = answers or {}

    def chat(self, messages: list[dict[str, str]], **options: float) -> str:
        prompt = messages[-1]["content"]
        for part, answer in self.answers.items():
            if part in prompt:
                return answer
        mark = hashlib.sha256(prompt.encode()).hexdigest()[:8]
        return json.dumps({"persons": [], "dynasties": [], "events": [], "places": [], "relations": [], "source_text": mark})


class Http:
    """A chat endpoint: up to three tries, after one and two seconds, on timeouts, refused connections and error codes."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 300, temperature: float = 0.1, max_tokens: int = 8192) -> None:
        self.url, self.model, self.key = url, model, key
        self.timeout, self.temperature, self.max_tokens = timeout, temperature, max_tokens

    def chat(self, messages: list[dict[str, str]], **options: float) -> str:
        from urllib import error, request

        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, **options}).encode()
        for attempt in range(3):
            try:
                call = request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with request.urlopen(call, timeout=self.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except (error.URLError, TimeoutError, ConnectionError):
                if attempt == 2:
                    raise
                time.sleep(2**attempt)
        raise AssertionError("not reached")


def ask(rows: DataFrame, client: Callable[[], Client], prompt_col: str = "prompt", system: str = "", pause: float = 0.0, options: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """Adds output, null where the call failed. client() is made once a task; a task waits pause seconds after each call, and lets least seconds pass from the start of one to the next."""
    from pyspark.sql import types as T

    names = [c for c in rows.columns if c != "output"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("output", T.StringType())])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for batch in batches:
            out = []
            for prompt in batch[prompt_col]:
                began = time.monotonic()
                try:
                    out.append(model.chat([{"role": "system", "content": system}, {"role": "user", "content": prompt}], **(options or {})))
                except Exception:  # a failed call is a null, so that the other rows' results are kept
                    out.append(None)
                if pause or least:
                    time.sleep(max(pause, least - (time.monotonic() - began)))
            yield batch[names].assign(output=out)

    return rows.select(*names).mapInPandas(call, schema)


def ask_once(rows: DataFrame, client: Callable[[], Client], ledger: str, system: str = "", options: dict[str, float] | None = None, per_second: float | None = None, callers: int | None = None, calls: int | None = None, again: bool = False, seconds: float = 30.0) -> DataFrame:
    """Adds output to rows (prompt, ...), as ask(), but from a ledger of calls: a table in a shared folder, keyed by the hash of system text, options and prompt.

    Each distinct prompt that the ledger lacks is asked once, in rounds of ``callers`` tasks with ``calls`` prompts each. By default it is 16 at first; after a round that took less than a quarter of ``seconds`` the next has four times
    as many, after one that took more than ``seconds`` a quarter, but 16 at least: so a lost round costs a bounded time, and quick answers make few rounds. A round's answers are in the ledger before
    the next begins and before any is read, so reading a result twice asks nobody, and a run that was cut off goes on after its last whole round. Failed calls are
    entered without an answer; ``again`` asks those anew. per_second is the limit for all tasks together: each of the callers has its even share of it.
    """
    spark = rows.sparkSession
    callers = callers or max(1, spark.sparkContext.defaultParallelism)
    said = json.dumps(options or {}, sort_keys=True)
    keyed = rows.drop("output").withColumn("__key", F.sha2(F.concat_ws("\0", F.lit(system), F.lit(said), F.coalesce("prompt", F.lit(""))), 256))
    known = lambda: read_or(spark, ledger, CALL)
    done = known().where("output IS NOT NULL") if again else known()
    todo = keyed.select("__key", "prompt").where("prompt IS NOT NULL").dropDuplicates(["__key"]).join(done.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti")
    left = f"{ledger}_todo/{uuid.uuid4().hex}"
    # numbered, and stored in that order: a round is a range of numbers, which the files' statistics find
    in_order(todo.select(F.col("__key").alias("key"), "prompt"), ["key"], "no").sortWithinPartitions("no").write.parquet(left)
    held = spark.read.schema("key string, prompt string, no long").parquet(left)
    n, begin, size = held.count(), 0, calls or 16
    while begin < n:
        here = held.where((F.col("no") >= begin) & (F.col("no") < begin + callers * size)).select("key", "prompt").repartition(callers)
        asked = ask(here, client, system=system, options=options, least=callers / per_second if per_second else 0.0)
        began = time.monotonic()
        asked.select("key", "output", F.current_timestamp().alias("at")).write.mode("append").parquet(ledger)
        took, begin = time.monotonic() - began, begin + callers * size
        if calls is None:
            size = size * 4 if took < seconds / 4 else max(16, size // 4) if took > seconds else size
    answers = known().groupBy("key").agg(F.max_by("output", F.when(F.col("output").isNotNull(), F.col("at"))).alias("output"))
    return keyed.join(answers.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
