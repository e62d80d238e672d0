"""Calls to a model: each prompt once, with its options, under one limit for all tasks."""

import functools
import json
import time

import pytest
from pyspark.sql import functions as F

from kinloom.plans.alias_check import clean_aliases
from kinloom.plans.summaries import CACHE, OPTIONS, SYSTEM, summaries
from kinloom.sources.models import CALL, Http, ask_once
from kinloom.sources.tables import graph_of


class Counting:
    """Notes each call in a file; fails on prompts with "fail", and ends its process on those with "die"."""

    def __init__(self, log, die=True):
        self.log, self.die = log, die

    def chat(self, messages, **options):
        prompt = messages[-1]["content"]
        if "die" in prompt and self.die:
            raise SystemExit(1)
        with open(self.log, "a") as f:
            f.write(json.dumps([prompt, options, messages[0]["content"], time.time()]) + "\n")
        if "fail" in prompt:
            raise ValueError("no answer")
        return f"said {prompt}"


def calls(log):
    return [json.loads(x) for x in open(log)] if log.exists() else []


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    rows = spark.createDataFrame([(i, f"p{i % 20}") for i in range(60)] + [(99, None), (100, "fail")], "id long, prompt string").withColumn("output", F.lit("old"))
    found = ask_once(rows, functools.partial(Counting, log), ledger, callers=2, calls=3)
    for _ in range(2):
        assert {r.id: r.output for r in found.collect()} == {**{i: f"said p{i % 20}" for i in range(60)}, 99: None, 100: None}
    assert sorted(c[0] for c in calls(log)) == sorted({f"p{i}" for i in range(20)} | {"fail"})
    # what failed is asked again only where that is wanted, other options are another call
    for again, options, more in ((False, None, 0), (True, None, 1), (False, {"temperature": 0.3}, 21)):
        before = len(calls(log))
        ask_once(rows, functools.partial(Counting, log), ledger, options=options, again=again).collect()
        assert len(calls(log)) == before + more
    assert calls(log)[-1][1] == {"temperature": 0.3}


def test_a_run_that_is_cut_off_goes_on(spark, tmp_path):
    """A task that dies ends the run; the answers of the rounds before are there, and the next run asks only for the rest."""
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("prompt")).union(spark.createDataFrame([("die",)], "prompt string"))
    with pytest.raises(Exception, match="SystemExit|exited|Python worker"):
        ask_once(rows, functools.partial(Counting, log), ledger, callers=1, calls=5)
    kept = spark.read.schema(CALL).parquet(ledger).count() if (tmp_path / "ledger").exists() else 0
    before = len(calls(log))
    found = ask_once(rows, functools.partial(Counting, log, False), ledger, callers=1, calls=5)
    assert found.where("output = concat('said ', prompt)").count() == 41
    assert len(calls(log)) - before == 41 - kept
    assert len(calls(log)) - len({c[0] for c in calls(log)}) <= 12  # those of the round that was lost


def test_one_limit_for_all_tasks(spark, tmp_path):
    log = tmp_path / "log"
    rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("prompt"))
    ask_once(rows, functools.partial(Counting, log), str(tmp_path / "ledger"), per_second=20, callers=4, calls=100)
    at = sorted(c[3] for c in calls(log))
    assert len(at) == 40
    for i, began in enumerate(at):
        assert sum(began <= t < began + 1 for t in at[i:]) <= 20 + 4  # a caller may begin on either side of the second


def test_summaries_ask_once_and_take_a_stored_cache(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    spark.createDataFrame([], CACHE).write.parquet(cache)
    prompts = spark.range(12).select(F.concat(F.lit("x/"), "id").alias("uid"), F.concat(F.lit("about "), "id").alias("prompt"))
    found, new = summaries("person", prompts, spark.read.schema(CACHE).parquet(cache), functools.partial(Counting, log))
    new.write.mode("append").parquet(cache)
    assert {r.uid: r.summary for r in found.collect()} == {f"x/{i}": f"said about {i}" for i in range(12)} and found.where("from_cache").isEmpty()
    assert sorted(c[0] for c in calls(log)) == sorted(f"about {i}" for i in range(12))
    assert all(c[1] == OPTIONS["person"] and c[2] == SYSTEM["person"] for c in calls(log))
    held = spark.read.schema(CACHE).parquet(cache)
    assert {r.key for r in held.collect()} == {f"person_x_{i}" for i in range(12)}
    found, new = summaries("person", prompts, held, functools.partial(Counting, log))
    assert found.where("from_cache").count() == 12 and new.isEmpty() and len(calls(log)) == 12
    assert summaries("event", prompts.limit(0), held, functools.partial(Counting, log))[0].isEmpty()


def test_alias_check_asks_once(spark, tmp_path):
    log = tmp_path / "log"
    g = graph_of(spark, "/root/testdata/sf0.001")
    for _ in range(2):
        clean_aliases(g, str(tmp_path / "a"), functools.partial(Counting, log), 2)[1].collect()
    assert len(calls(log)) == g.person.count() and calls(log)[0][1]["temperature"] == 0.05


def test_endpoint_tries_three_times(monkeypatch):
    """One and two seconds lie between tries; options of a call go before the client's."""
    from urllib import error, request

    waits, bodies = [], []
    monkeypatch.setattr(time, "sleep", waits.append)

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self, *_):
            return b'{"choices": [{"message": {"content": "yes"}}]}'

    def urlopen(call, timeout):
        bodies.append(json.loads(call.data))
        if len(bodies) < 3:
            raise error.URLError("down")
        return Reply()

    monkeypatch.setattr(request, "urlopen", urlopen)
    assert Http("http://x", "m").chat([{"role": "user", "content": "q"}], max_tokens=7) == "yes"
    assert waits == [1, 2] and [b["max_tokens"] for b in bodies] == [7] * 3 and bodies[0]["temperature"] == 0.1
    monkeypatch.setattr(request, "urlopen", lambda *_, **__: (_ for _ in ()).throw(error.URLError("down")))
    with pytest.raises(error.URLError):
        Http("http://x", "m").chat([])
