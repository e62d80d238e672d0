"""Upserts and deletes as set operations; a snapshot is written anew, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import relation_type
from ..functions.values import DEFAULT_EDGE_ROLE, FOUNDED, OCCURRED, PARTICIPATED
from .graph import Graph, resolve_names, resolve_participants


def upsert_nodes(old: DataFrame, new: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """One row a uid. Required columns take the latest value by seq; optional ones the latest that is not null (nor empty, for
    strings); seq stays that of the first row."""
    both = old.unionByName(new)
    text = {c for c, t in both.dtypes if t == "string"}
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "") if c in text else F.col(c).isNotNull()
    aggs = [F.max_by(c, "seq").alias(c) for c in required]
    aggs += [F.max_by(F.when(some(c), F.col(c)), F.when(some(c), F.col("seq"))).alias(c) for c in optional]
    return both.groupBy("uid").agg(*aggs, F.min("seq").alias("seq")).select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (src, rel_type, dst): of year, description and role each the latest that is not null, as an upsert sets only what it has."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return old.unionByName(new).groupBy("src", "rel_type", "dst").agg(latest("year"), latest("description"), latest("role"), F.min("seq").alias("seq")).select(*old.columns)


def relation_rows(relations: DataFrame) -> DataFrame:
    """Edges of (src, dst, relation_type, year, description, seq)."""
    return relations.select("src", relation_type(F.col("relation_type")).alias("rel_type"), "dst", "year", "description", F.lit(None).cast("string").alias("role"), "seq")


def relations_to_edges(graph: Graph, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved rows) of (source, target, relation_type, year, description, seq): names are resolved over all labels."""
    names = relations.select("source").union(relations.select("target")).where("source IS NOT NULL")
    found = resolve_names(graph, names).select("name", "uid")
    a, b = found.toDF("source", "src"), found.toDF("target", "dst")
    out = relations.join(a, "source", "left").join(b, "target", "left")
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return relation_rows(out.where(both)), out.where(~both).select(*relations.columns)


def participation_rows(links: DataFrame) -> DataFrame:
    """Edges of (uid, event_uid, seq); they set the role alone."""
    null = F.lit(None)
    return links.select(F.col("uid").alias("src"), F.lit(PARTICIPATED).alias("rel_type"), F.col("event_uid").alias("dst"), null.cast("int").alias("year"), null.cast("string").alias("description"), F.lit(DEFAULT_EDGE_ROLE).alias("role"), "seq")


def participation_edges(graph: Graph, events: DataFrame) -> DataFrame:
    """Edges for the participants that events (uid, participants, seq) list."""
    links = events.select(F.col("uid").alias("event_uid"), F.explode("participants").alias("name"))
    return participation_rows(resolve_participants(graph, links).join(events.select(F.col("uid").alias("event_uid"), "seq"), "event_uid"))


def typed_edges(pairs: DataFrame, kind: str, seq: int = 0) -> DataFrame:
    """Bare edges of one kind (FOUNDED, OCCURRED_AT) from (src, dst)."""
    if kind not in (FOUNDED, OCCURRED):
        raise ValueError(f"no bare edges of kind {kind}")
    null = F.lit(None)
    return pairs.distinct().select("src", F.lit(kind).alias("rel_type"), "dst", null.cast("int").alias("year"), null.cast("string").alias("description"), null.cast("string").alias("role"), F.lit(seq).cast("long").alias("seq"))


def founder_edges(graph: Graph, seq: int = 0) -> DataFrame:
    """Founders by name: person to dynasty."""
    named = graph.dynasty.where("founder IS NOT NULL").select("uid", "founder")
    found = resolve_names(graph, named.select("founder"), "Person").select(F.col("name").alias("founder"), F.col("uid").alias("src"))
    return typed_edges(named.join(found, "founder").where("src IS NOT NULL").select("src", F.col("uid").alias("dst")), FOUNDED, seq)


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def without_parallels(edges: DataFrame) -> DataFrame:
    """The first edge by seq of each (src, rel_type, dst); the partial minimum is taken before the shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "rel_type", "dst")]
    first = F.min(F.struct(*["seq", *[c for c in rest if c != "seq"]])).alias("__e")
    return edges.groupBy("src", "rel_type", "dst").agg(first).select("src", "rel_type", "dst", *[F.col(f"__e.{c}").alias(c) for c in rest]).select(*edges.columns)


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those listed as (src, rel_type, dst)."""
    return edges.join(gone.select("src", "rel_type", "dst").distinct().hint("merge"), ["src", "rel_type", "dst"], "left_anti")
