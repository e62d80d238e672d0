"""Names as they stood at a point of arrival: who bore a name when a relation came in, not who bears it in the end.

A history has a row for each time a node bore a name: name, uid, label, priority (of the label), seq (the node's creation), since and until (arrivals; null is open).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import LABELS

HISTORY = ["name", "uid", "label", "priority", "seq", "since", "until"]
SALTS = 64


def stored_history(index: DataFrame) -> DataFrame:
    """The history of nodes that a batch leaves alone, from Graph.name_index()."""
    null = F.lit(None).cast("long")
    return index.select("name", "uid", "label", "priority", "seq", null.alias("since"), null.alias("until"))


def person_history(folded: DataFrame) -> DataFrame:
    """From fold_persons()."""
    rows = folded.select("uid", F.col("seq").cast("long").alias("seq"), F.explode("names").alias("n"))
    return rows.select("n.name", "uid", F.lit("Person").alias("label"), F.lit(0).alias("priority"), "seq", "n.since", "n.until")


def upsert_history(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Of nodes whose name is the latest one by seq: all of old, changed by the rows of new (uid, name, seq).

    Nodes that keep one name, however often they come in, are settled by a partial minimum; only those with several go through a window over their rows.
    """
    rows = old.select("uid", "name", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("since")).union(new.select("uid", "name", "seq", F.col("seq").alias("since")))
    always = F.lit(-(1 << 62))
    first = rows.groupBy("uid").agg(F.min("seq").alias("first"), F.count_distinct(F.coalesce("name", F.lit("\0"))).alias("n_names"))
    rows = rows.join(first, "uid")
    one = rows.where("n_names = 1").groupBy("uid", "name").agg(F.min("first").alias("seq"), F.min(F.coalesce("since", always)).alias("since"), F.lit(None).cast("long").alias("until"))
    line = Window.partitionBy("uid").orderBy(F.coalesce("since", always), "name")
    many = rows.where("n_names > 1").select("uid", "name", F.col("first").alias("seq"), F.coalesce("since", always).alias("since"), F.lead("since").over(line).alias("until"))
    return one.union(many).where("name IS NOT NULL").select("name", "uid", F.lit(label).alias("label"), F.lit(LABELS.index(label)).alias("priority"), "seq", "since", "until")


def at_the_end(history: DataFrame) -> DataFrame:
    """The names that are left in the end, as if they had been there always."""
    return history.where("until IS NULL").withColumn("since", F.lit(None).cast("long"))


def resolve_at(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, at, uid, label) for each distinct (name, at): the first by priority and creation of the nodes that bore the name at that arrival; uid is null where none did. Empty and null names stand for nobody and have no row.

    Of the open intervals of a name only those are joined that a better node does not cover: as they are ordered by creation, a handful is left of any number of
    nodes with one name. They are thinned out within salted parts of a name first, so no task meets all nodes of a hot name.
    Wanted names are joined by merging: they come out of parsed and exploded rows, of which Spark takes any number for a small table to broadcast.
    """
    wanted = wanted.select("name", "at").where("name <> ''").distinct()
    # a plain join, as in graph.resolve_names()
    rows = history.join(wanted.select("name").distinct(), "name")
    rows = rows.select("name", F.struct("priority", "seq", "uid", "label").alias("node"), F.coalesce("since", F.lit(-(1 << 62))).alias("since"), "until")
    opened = rows.where("until IS NULL").withColumn("salt", F.pmod(F.xxhash64("node.uid"), F.lit(SALTS)))
    for part in (["name", "salt"], ["name"]):
        before = Window.partitionBy(*part).orderBy("since", "node").rowsBetween(Window.unboundedPreceding, -1)
        opened = opened.withColumn("best", F.min("node").over(before)).where("best IS NULL OR node < best").drop("best")
    kept = opened.drop("salt").unionByName(rows.where("until IS NOT NULL"))
    met = wanted.hint("merge").join(kept, "name").where("since <= at AND (until IS NULL OR until > at)").groupBy("name", "at").agg(F.min("node").alias("node"))
    return wanted.join(met, ["name", "at"], "left").select("name", "at", F.col("node.uid").alias("uid"), F.col("node.label").alias("label"))
