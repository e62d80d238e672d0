"""What larger tables brought to light, at small sizes."""

import contextlib

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kinloom.operators import repair
from kinloom.operators.asof import resolve_at
from kinloom.operators.automaton import in_blocks
from kinloom.operators.merge import _FOLDED, _Fold, merge_persons
from kinloom.operators.order import spread
from kinloom.operators.repair import by_grams
from kinloom.operators.search import event_snippets, snippets, write_index
from kinloom.plans.queries import ORACLE_SQL, QUERIES
from kinloom.sources.models import Stub, ask_once
from kinloom.sources.tables import graph_of
from kinloom.streaming import ingest

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def settings(spark, **values):
    """Settings of the session for a while; _ stands for a point."""
    names = {k: k.replace("_", ".") for k in values}
    before = {n: spark.conf.get(n) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_names_resolved_without_broadcasts(spark):
    """Spark takes a union of semi-joins for rows dealt by name; skewed joins below it then have other numbers of partitions than the rest."""
    want = {q: QUERIES[q](spark, SF).count() for q in ("j13_relations_to_edges", "a9_ingest_counts")}
    skew = {"spark_sql_adaptive_forceOptimizeSkewedJoin": "true", "spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes": "1b", "spark_sql_adaptive_skewJoin_skewedPartitionFactor": "0.1", "spark_sql_adaptive_advisoryPartitionSizeInBytes": "1b"}
    with settings(spark, spark_sql_autoBroadcastJoinThreshold="-1", **skew):
        assert {q: QUERIES[q](spark, SF).count() for q in want} == want


def test_grams_are_not_broadcast(spark):
    """A row's q-grams are many rows, so no table of them is broadcast for its size as Spark takes it."""
    texts = spark.range(50).selectExpr("id", "concat('here was Name', id, ' once') AS text")
    names = spark.range(60).selectExpr("concat('Name', id) AS name", "concat('u', id) AS uid")
    found = by_grams(texts, names)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.distinct().count() == sum(f"Name{j}" in f"here was Name{i} once" for i in range(50) for j in range(60))


def test_keywords_in_blocks(spark):
    """More keywords than one automaton takes are dealt into blocks, not sought by runs of their shortest one's length."""
    books = spark.range(40).selectExpr("concat('b', lpad(id, 2, '0')) AS name", "concat('the word', id, ' and word', id + 1, ' of 之战') AS text")
    events = spark.range(30).selectExpr("concat('e', id) AS uid", "concat('word', id, '之战') AS name", "'' AS description")
    words = events.selectExpr("name AS keyword")
    assert [len(b) > 0 for b in in_blocks(words, 9, 100)] == [True] * 3 and in_blocks(words, 2, 100) is None
    rows = lambda bound: sorted(map(tuple, event_snippets(events, books, 2, 5, bound).collect()))
    assert rows(200) == rows(2_000_000) != []


def test_quick_answers_make_few_rounds(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('p', id) AS prompt")
    ledger = str(tmp_path / "ledger")
    assert ask_once(rows, Stub, ledger, callers=1).where("output IS NOT NULL").count() == 400
    assert spark.read.parquet(ledger).select("at").distinct().count() <= 4


def test_snippets_hold_the_first_alone(spark):
    """A task sends no more than the first ones; order and copies are as in a plain search."""
    books = spark.range(300).selectExpr("lpad(299 - id, 3, '0') AS name", "repeat(concat(id % 250, ' the thing '), 20) AS text").union(spark.createDataFrame([(None, "the first")], "name string, text string"))
    found = [tuple(r) for r in snippets(books, ["the", "thing"], 7, 4).collect()]
    plain = {}
    for name, text in books.collect():
        for no, word in enumerate(["the", "thing"]):
            at = text.find(word)
            while at >= 0:
                cut = text[max(at - 4, 0) : at + len(word) + 4].strip()
                row = (name or "", no, at, word, cut, name)
                plain[cut[:80]] = min(plain.get(cut[:80], row), row)
                at = text.find(word, at + len(word) + 4)
    assert found == [(name, word, cut, no, at) for _, no, at, word, cut, name in sorted(plain.values())[:7]]


def test_work_of_small_files_is_spread(spark, tmp_path):
    """One split of a file becomes the tasks of all cores before its terms are counted."""
    docs = spark.range(200).selectExpr("id AS uid", "concat('word', id, ' is here') AS text").coalesce(1)
    write_index(docs, F.col("text"), str(tmp_path / "i"))
    assert spread(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() == 600


def test_small_groups_leave_a_task_together():
    """Groups of a pair each make one batch, not one batch each."""
    state = _Fold()
    for k, name in enumerate(("Ann", "Bea")):
        state.add({"uid": f"u{k}", "original_name": name, "aliases": [], "role": None, "loyalty": [], "birth_year": None, "death_year": 5, "death_cause": None, "description": "", "seq": k})
    out = pa.RecordBatch.from_pylist(list(state.rows()), _FOLDED)
    assert out.num_rows == 2 and out.column("death_year").to_pylist() == [5, 5]


def test_keys_of_a_batch_are_not_broadcast(spark, monkeypatch):
    """Keys, labels and uids of a batch grow with it, so no step of the fold sends them whole through the driver, however few Spark takes them for."""
    plans = []
    cut = DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *a))
    blank = {"role": F.lit("x"), "loyalty": F.expr("CAST(array() AS array<string>)"), "birth_year": F.lit(1), "death_year": F.lit(1), "death_cause": F.lit(""), "description": F.lit("")}
    stored = spark.range(6).selectExpr("concat('s', id) AS uid", "concat('Old', id) AS original_name", "array(concat('Nick', id)) AS aliases", "id AS seq").withColumns(blank)
    records = spark.range(3, 9).selectExpr("concat('r', id) AS uid", "concat('New', id) AS original_name", "array(concat('Nick', id)) AS aliases", "id + 10 AS seq").withColumns(blank)
    nodes = merge_persons(records, stored)
    plans.append(nodes._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.uid, *r.aliases) for r in nodes.collect()) == [(f"r{k}", f"Nick{k}") for k in (6, 7, 8)] + [(f"s{k}", f"Nick{k}") for k in range(3)] + [(f"s{k}", f"New{k}", f"Nick{k}") for k in (3, 4, 5)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_wanted_names_are_not_broadcast(spark):
    """Names wanted at an arrival are as many as a batch's mentions, however small a table Spark takes them for."""
    history = spark.range(3).selectExpr("concat('n', id) AS name", "concat('u', id) AS uid", "'Person' AS label", "0 AS priority", "id AS seq", "CAST(NULL AS bigint) AS since", "CAST(NULL AS bigint) AS until")
    found = resolve_at(history, spark.range(4).selectExpr("concat('n', id) AS name", "id AS at"))
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "since" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert sorted((r.name, r.uid) for r in found.collect() if r.uid) == [("n0", "u0"), ("n1", "u1"), ("n2", "u2")]


def test_results_are_parsed_by_all_cores(spark, monkeypatch):
    """as_of_edges makes its results from a file of one split."""
    seen = []
    apply = ingest.apply_results
    monkeypatch.setattr(ingest, "apply_results", lambda graph, rows: seen.append(rows.rdd.getNumPartitions()) or apply(graph, rows))
    QUERIES["as_of_edges"](spark, SF)
    assert seen[0] >= spark.sparkContext.defaultParallelism


def _rows_joined(plan):
    """Rows that each join by merging has put out."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName().startswith("SortMergeJoin") else []
    return own + [n for k in range(plan.children().size()) for n in _rows_joined(plan.children().apply(k))]


def test_names_alike_make_no_candidates(spark):
    """Digits of a text are parts of many names; only names that the text has leave it or meet it."""
    names = spark.range(20_000).selectExpr("concat('Nick', id) AS name", "concat('u', id) AS uid")
    texts = spark.range(300).selectExpr("id", "concat('Order ', 1000000 + id * 7919, ' of Nick', id, '!') AS text")
    with settings(spark, spark_sql_adaptive_enabled="false"):
        found = by_grams(texts, names)
        rows = sorted((r.id, r.uid) for r in found.collect())
    assert rows == sorted({(i, f"u{str(i)[:n]}") for i in range(300) for n in range(1, len(str(i)) + 1)})
    assert max(_rows_joined(found._jdf.queryExecution().executedPlan())) == len(rows)


def test_repair_of_many_names_alike(spark, tmp_path, monkeypatch):
    """No step of the repair holds more rows than there are edges and links, however many names share digits with an event, and rows are as in its SQL."""
    customer = spark.range(2000).selectExpr("id + 1000 AS c_custkey", "if(id = 0, 'Zz', format_string('Customer#%09d', id * 11)) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment")
    orders = spark.range(1500).selectExpr("100000100100 + id * 101 AS o_orderkey", "1000 + id AS o_custkey", "timestamp'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    con = duckdb.connect()
    for name, table in (("customer", customer), ("orders", orders), ("nation", spark.read.parquet(f"{SF}/nation.parquet")), ("region", spark.read.parquet(f"{SF}/region.parquet"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(repair, "small", lambda *_: None)
    edges, links = graph_of(spark, str(tmp_path)).edges.count(), 2 * 1500
    for name in ("j17_missing_links", "g16_repair_events"):
        with settings(spark, spark_sql_adaptive_enabled="false"):
            found = QUERIES[name](spark, str(tmp_path))
            rows = sorted(map(tuple, found.collect()))
        assert rows == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall())
        assert max(_rows_joined(found._jdf.queryExecution().executedPlan())) <= edges + links
