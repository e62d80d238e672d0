"""A property graph and books made from the standard tables, so that every operator can be run and checked on them.

Each part is one SQL text that Spark and DuckDB read alike; ARR( stands for the array constructor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph

PERSON = """
SELECT concat('p', CAST(c_custkey AS STRING)) AS uid, c_name AS original_name,
  ARR(concat('Alias', CAST(c_custkey % 97 AS STRING)), concat('Nick', CAST(c_custkey AS STRING))) AS aliases,
  c_mktsegment AS role, ARR(concat('d', CAST(c_nationkey AS STRING))) AS loyalty,
  CAST(1900 + c_custkey % 40 AS INT) AS birth_year,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(1993 + c_custkey % 5 AS INT) END AS death_year,
  CASE WHEN c_custkey % 6 = 0 THEN 'illness' END AS death_cause,
  concat('trades in ', lower(c_mktsegment), ' as number ', CAST(c_custkey % 13 AS STRING)) AS description,
  c_custkey AS seq
FROM {customer}
"""
DYNASTY = """
SELECT concat('d', CAST(n_nationkey AS STRING)) AS uid, n_name AS name, concat('Nick', CAST(n_nationkey + 1 AS STRING)) AS founder,
  CAST(NULL AS STRING) AS capital, CAST(900 + n_nationkey AS INT) AS start_year, CAST(NULL AS INT) AS end_year, '' AS description,
  CAST(n_nationkey AS BIGINT) AS seq
FROM {nation}
"""
PLACE = """
SELECT concat('l', CAST(r_regionkey AS STRING)) AS uid, r_name AS name, CAST(NULL AS STRING) AS modern_name, '' AS description,
  CAST(r_regionkey AS BIGINT) AS seq
FROM {region}
"""
EVENT = """
SELECT concat('e', CAST(o_orderkey AS STRING)) AS uid,
  concat('Order ', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 11 = 0 THEN ' 追封' ELSE '' END) AS name,
  o_orderpriority AS event_type, CASE WHEN o_orderkey % 17 > 0 THEN CAST(year(o_orderdate) AS INT) END AS year,
  CAST(NULL AS STRING) AS location, ARR(concat('Nick', CAST(o_orderkey % 140 + 1 AS STRING))) AS participants,
  CAST(NULL AS STRING) AS outcome,
  concat('placed before Customer#', lpad(CAST(o_orderkey % 130 + 1 AS STRING), 9, '0'), ' was there') AS description, o_orderkey AS seq
FROM {orders}
"""
EDGES = """
SELECT concat('p', CAST(o_custkey AS STRING)) AS src, 'PARTICIPATED_IN' AS rel_type, concat('e', CAST(o_orderkey AS STRING)) AS dst,
  CAST(NULL AS INT) AS year, '' AS description, '参与者' AS role, o_orderkey AS seq FROM {orders}
UNION ALL SELECT concat('p', CAST(c_custkey AS STRING)), CASE c_custkey % 4 WHEN 0 THEN 'FATHER_OF' WHEN 1 THEN 'ADOPTED_SON' WHEN 2 THEN 'SIBLING' ELSE 'SERVED' END,
  concat('p', CAST((c_custkey * 3) % 149 + 1 AS STRING)), CAST(NULL AS INT), 'kin', CAST(NULL AS STRING), c_custkey FROM {customer}
UNION ALL SELECT concat('p', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 2 = 0 THEN 'REPLACED' ELSE 'SUCCEEDED' END,
  CASE WHEN c_custkey % 4 = 0 THEN concat('d', CAST(c_custkey % 25 AS STRING)) ELSE concat('p', CAST(c_custkey % 149 + 1 AS STRING)) END,
  CASE WHEN c_custkey % 15 > 0 THEN CAST(900 + c_custkey % 60 AS INT) END, 'throne', CAST(NULL AS STRING), c_custkey FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT concat('p', CAST(c_custkey AS STRING)), 'KILLED', concat('p', CAST(c_custkey AS STRING)), CAST(NULL AS INT), 'loop', CAST(NULL AS STRING), c_custkey
  FROM {customer} WHERE c_custkey % 50 = 0
UNION ALL SELECT concat('p', CAST(c_custkey AS STRING)), 'FATHER_OF', concat('p', CAST((c_custkey * 3) % 149 + 1 AS STRING)), CAST(930 AS INT), 'again', CAST(NULL AS STRING),
  1000000000 + c_custkey FROM {customer} WHERE c_custkey % 40 = 0
"""
PARTS = {"person": PERSON, "dynasty": DYNASTY, "event": EVENT, "place": PLACE, "edges": EDGES}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "nation", "region", "orders")}
    sql = lambda part: spark.sql(PARTS[part].replace("ARR(", "array("), **{k: v for k, v in read.items() if f"{{{k}}}" in PARTS[part]})
    return Graph(sql("person"), sql("dynasty"), sql("event"), sql("place"), sql("edges"))


def duckdb_ctes() -> str:
    """The same graph for DuckDB, as the start of a WITH clause."""
    text = ", ".join(f"{name} AS ({sql})" for name, sql in PARTS.items()).replace("ARR(", "list_value(")
    for name in ("customer", "nation", "region", "orders"):
        text = text.replace(f"{{{name}}}", name)
    nodes = "SELECT uid, 'Person' AS label, original_name AS name, seq FROM person" + "".join(f" UNION ALL SELECT uid, '{x.title()}', name, seq FROM {x}" for x in ("dynasty", "event", "place"))
    return f"{text}, nodes AS ({nodes})"


def books_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as books: name, text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lpad(CAST(doc_id AS STRING), 12, '0') AS name", "text")
