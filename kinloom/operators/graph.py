"""The property graph as DataFrames, and its lookups, traversals and counts.

Nodes are one DataFrame a label; edges are one DataFrame with a plain type column. Lookups are equi-joins or filters that reach
the scan; sets of names or uids come as DataFrames, so they join instead of being collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import all_names
from ..functions.values import FAMILY_TYPES, PARTICIPATED, SUCCESSION_TYPES
from ..sources.files import checkpoint_dir
from .store import WIDTH, read_version, write_version

#: Order in which labels are searched for a name.
LABELS = ("Person", "Dynasty", "Event", "Place")
#: What tells rows of the stored tables apart.
KEYS = {"person": ["uid"], "dynasty": ["uid"], "event": ["uid"], "place": ["uid"], "edges": ["src", "rel_type", "dst"]}


@dataclass(frozen=True)
class Graph:
    """person, dynasty, event, place: nodes with uid, seq (creation order) and their properties; edges: src, rel_type, dst, year,
    description, role, seq."""

    person: DataFrame
    dynasty: DataFrame
    event: DataFrame
    place: DataFrame
    edges: DataFrame

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def labelled(self) -> list[tuple[str, DataFrame]]:
        return list(zip(LABELS, (self.person, self.dynasty, self.event, self.place), strict=True))

    def nodes(self) -> DataFrame:
        """uid, label, name, seq of all nodes."""
        parts = [df.select("uid", F.lit(label).alias("label"), F.col("original_name" if label == "Person" else "name").alias("name"), F.col("seq").cast("long").alias("seq")) for label, df in self.labelled()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def node_properties(self) -> DataFrame:
        """uid, label, props (JSON without nulls)."""
        parts = [df.select("uid", F.lit(label).alias("label"), F.to_json(F.struct(*[c for c in df.columns if c != "seq"])).alias("props")) for label, df in self.labelled()]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def name_index(self) -> DataFrame:
        """A row for each name a node goes by: name, uid, label, priority, seq, is_primary."""
        persons = self.person.select(F.explode(all_names(F.col("original_name"), F.col("aliases"))).alias("name"), "uid", F.lit("Person").alias("label"), F.lit(0).alias("priority"), F.col("seq").cast("long").alias("seq"), "original_name")
        out = persons.withColumn("is_primary", F.col("name") == F.col("original_name")).drop("original_name")
        for priority, (label, df) in enumerate(self.labelled()[1:], 1):
            out = out.unionByName(df.where("name IS NOT NULL").select("name", "uid", F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.col("seq").cast("long").alias("seq"), F.lit(True).alias("is_primary")))
        return out


def load(spark: SparkSession, path: str) -> Graph:
    """A version that save() or save_changes() wrote."""
    root, version = path.rstrip("/").rsplit("/", 1)
    return Graph(**read_version(spark, root, version, KEYS))


def save(graph: Graph, path: str) -> None:
    """Writes a snapshot to a new folder; edges are clustered by type."""
    for label, df in graph.labelled():
        df.write.parquet(f"{path}/{label.lower()}")
    graph.edges.sortWithinPartitions("rel_type", "src").write.parquet(f"{path}/edges")


def save_changes(changed: Graph, root: str, version: str, last: str | None, gone: dict[str, DataFrame] | None = None, width: int = WIDTH) -> None:
    """Writes the nodes and edges that change a version (None: the empty graph), each as a whole row, and the keys (KEYS) that are gone, as a new version below root."""
    write_version({name: getattr(changed, name) for name in KEYS}, root, version, last, KEYS, gone, width)


def persons_named(graph: Graph, name: str) -> DataFrame:
    """Persons with that name or alias."""
    return graph.person.where((F.col("original_name") == name) | F.array_contains("aliases", name))


def resolve_names(graph: Graph, names: DataFrame, label: str | None = None) -> DataFrame:
    """(name, uid, label) for each distinct name of a one-column DataFrame; uid is null where nothing bears it.

    Persons come first, then dynasties, events and places; among those the node created first.
    """
    wanted = names.toDF("name").distinct()
    index = graph.name_index() if label is None else graph.name_index().where(F.col("label") == label)
    # the names are distinct, so a plain join keeps each row once; a semi-join would go below the index's union, whose rows then count as dealt by name when they are not
    best = index.join(wanted, "name").groupBy("name").agg(F.min(F.struct("priority", "seq", "uid", "label")).alias("b"))
    return wanted.join(best, "name", "left").select("name", F.col("b.uid").alias("uid"), F.col("b.label").alias("label"))


def resolve_participants(graph: Graph, links: DataFrame) -> DataFrame:
    """(event_uid, uid) from (event_uid, name): a person by name, else by uid; the rest is dropped."""
    by_name = resolve_names(graph, links.select("name"), "Person").select("name", F.col("uid").alias("__found"))
    uids = graph.person.select(F.col("uid").alias("__uid"))
    out = links.join(by_name, "name", "left").join(uids, F.col("name") == F.col("__uid"), "left")
    return out.select("event_uid", F.coalesce("__found", "__uid").alias("uid")).where("uid IS NOT NULL").distinct()


def neighbourhood(graph: Graph, uid: str, participation: bool = True) -> DataFrame:
    """Edges at a node, both directions; a self-loop once, as outgoing."""
    edges = graph.edges if participation else graph.edges.where(F.col("rel_type") != PARTICIPATED)
    here = edges.where((F.col("src") == uid) | (F.col("dst") == uid))
    out = F.col("src") == uid
    here = here.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other_uid"), "rel_type", F.when(out, "outgoing").otherwise("incoming").alias("direction"), "year", "description", "role", "seq")
    nodes = graph.nodes().select(F.col("uid").alias("other_uid"), F.col("label").alias("other_label"), F.col("name").alias("other_name"))
    return here.join(nodes, "other_uid")


def adopted_sons(graph: Graph, uid: str) -> DataFrame:
    sons = graph.edges.where((F.col("src") == uid) & (F.col("rel_type") == "ADOPTED_SON")).select(F.col("dst").alias("uid"), F.col("description").alias("relation"))
    return sons.join(graph.person, "uid").select("uid", F.col("original_name").alias("name"), "role", "relation")


def person_events(graph: Graph, uid: str, limit: int | None = None) -> DataFrame:
    links = graph.edges.where((F.col("src") == uid) & (F.col("rel_type") == PARTICIPATED)).select(F.col("dst").alias("uid"), "role")
    out = links.join(graph.event, "uid").select("uid", "name", "event_type", "year", "role", F.col("description").alias("description"))
    out = out.orderBy(F.asc_nulls_last("year"), "uid")
    return out if limit is None else out.limit(limit)


def event_participants(graph: Graph, uid: str) -> DataFrame:
    links = graph.edges.where((F.col("dst") == uid) & (F.col("rel_type") == PARTICIPATED)).select(F.col("src").alias("uid"), F.col("role").alias("event_role"))
    return links.join(graph.person, "uid").select("uid", F.col("original_name").alias("name"), "role", "event_role").orderBy("name", "uid")


def succession(graph: Graph) -> DataFrame:
    edges = graph.edges.where(F.col("rel_type").isin(*SUCCESSION_TYPES)).select("src", "dst", "rel_type", "year", "description")
    persons = graph.person.select(F.col("uid").alias("src"), F.col("original_name").alias("person_name"))
    targets = graph.nodes().select(F.col("uid").alias("dst"), F.col("name").alias("target_name"))
    out = edges.join(persons, "src").join(targets, "dst")
    return out.select(F.col("src").alias("person_uid"), "person_name", "rel_type", F.col("dst").alias("target_uid"), "target_name", "year", "description").orderBy(F.asc_nulls_last("year"), "person_uid", "target_uid", "rel_type")


def family_tree(graph: Graph, start: DataFrame, depth: int = 3) -> DataFrame:
    """Family edges within ``depth`` steps of each start person (one column of uids), as (root, from_uid, to_uid, rel_type, ...).

    A frontier join a step: an edge belongs to the tree if its nearer end is less than ``depth`` steps away. Only edges between
    persons count. Beyond three steps each is cut by checkpoint(), so that the plan does not double with each.
    """
    if int(depth) < 1:
        raise ValueError("depth must be 1 or more")
    persons = graph.person.select("uid", F.col("original_name").alias("name"))
    ends = graph.edges.where(F.col("rel_type").isin(*FAMILY_TYPES)).select("src", "dst", "rel_type").distinct()
    ends = ends.join(persons.select(F.col("uid").alias("src"), F.col("name").alias("from_name")), "src").join(persons.select(F.col("uid").alias("dst"), F.col("name").alias("to_name")), "dst")
    both = ends.select("src", F.col("dst").alias("next")).union(ends.select(F.col("dst"), F.col("src"))).where("src <> next").distinct()
    reached = frontier = start.toDF("root").distinct().select("root", F.col("root").alias("at"))
    deep = int(depth) > 3
    if deep:
        checkpoint_dir(start.sparkSession)
        both = both.checkpoint()
    for _ in range(int(depth) - 1):
        step = frontier.join(both, F.col("at") == F.col("src")).select("root", F.col("next").alias("at")).distinct()
        frontier = step.join(reached, ["root", "at"], "left_anti")
        frontier = frontier.checkpoint() if deep else frontier
        reached = reached.union(frontier)
    hit = reached.join(ends, F.col("at") == F.col("src")).select("root", "src", "dst", "rel_type", "from_name", "to_name")
    back = reached.join(ends, F.col("at") == F.col("dst")).select("root", "src", "dst", "rel_type", "from_name", "to_name")
    return hit.union(back).distinct().select("root", F.col("src").alias("from_uid"), "from_name", F.col("dst").alias("to_uid"), "to_name", "rel_type")


def family_trails(graph: Graph, start: DataFrame, depth: int = 3) -> DataFrame:
    """Family edges on trails (no edge twice) of at most ``depth`` edges from each start person (one column of uids) to any person, in family_tree()'s columns.

    Nodes of other labels may lie on the way; they have no name here. An edge between persons is on such a trail if its nearer end is less than ``depth`` steps away, so those
    are found by distance. Only edges with an end that is no person need the trails themselves: trails grow by joins, an edge's number only once, and are dropped as soon as no such
    node is near enough. Without such nodes there are no trails; around them their number grows with the degree at each step.
    """
    if int(depth) < 1:
        raise ValueError("depth must be 1 or more")
    depth = int(depth)
    checkpoint_dir(start.sparkSession)
    person = F.col("label") == "Person"
    nodes = graph.nodes().select("uid", person.alias("person"), F.when(person, F.col("name")).alias("name"))
    edges = graph.edges.where(F.col("rel_type").isin(*FAMILY_TYPES)).select("src", "dst", "rel_type")
    edges = edges.join(nodes.toDF("src", "from_person", "from_name"), "src").join(nodes.toDF("dst", "to_person", "to_name"), "dst")
    edges = edges.withColumn("edge", F.monotonically_increasing_id()).checkpoint()
    arcs = edges.select(F.col("src").alias("at"), "edge", F.col("dst").alias("next"), F.col("to_person").alias("next_person"))
    arcs = arcs.union(edges.where("src <> dst").select("dst", "edge", "src", "from_person"))
    steps = arcs.select("at", "next").where("at <> next").distinct().checkpoint()

    def within(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
        """Adds to rows (keys, at) all that is at most n steps away, with the distance."""
        reached = frontier = rows.withColumn("steps", F.lit(0))
        for k in range(1, n + 1):
            moved = frontier.join(steps, "at").select(*keys, F.col("next").alias("at")).distinct()
            frontier = moved.join(reached, [*keys, "at"], "left_anti").withColumn("steps", F.lit(k)).checkpoint()
            reached = reached.union(frontier)
        return reached

    roots = start.toDF("root").distinct().join(graph.person.select(F.col("uid").alias("root")), "root", "left_semi")
    reached = within(roots.withColumn("at", F.col("root")), ["root"], depth - 1)
    by_distance = reached.join(arcs.select("at", "edge"), "at").select("root", "edge").distinct().join(edges.where("from_person AND to_person"), "edge")
    others = arcs.where("NOT next_person").select(F.col("next").alias("at")).distinct()
    near = within(others, [], depth - 1).select(F.col("at").alias("next"), F.col("steps").alias("to_other"))
    arcs = arcs.join(near, "next", "left").checkpoint()
    trails = roots.join(near.select(F.col("next").alias("root")), "root", "left_semi").select("root", F.col("root").alias("at"), F.array().cast("array<bigint>").alias("path"), F.lit(False).alias("met"))
    found = None
    for k in range(1, depth + 1):
        moved = trails.join(arcs, "at").where(~F.array_contains("path", F.col("edge")))
        met = F.col("met") | ~F.col("next_person")
        moved = moved.select("root", F.col("next").alias("at"), F.array_append("path", F.col("edge")).alias("path"), met.alias("met"), "next_person", "to_other")
        trails = moved.where(F.col("met") | (F.col("to_other") < depth - k)).checkpoint()
        ended = trails.where("met AND next_person").select("root", F.explode("path").alias("edge"))
        found = ended if found is None else found.union(ended)
        trails = trails.drop("next_person", "to_other")
    by_trails = found.distinct().join(edges.where("NOT (from_person AND to_person)"), "edge")
    out = by_distance.unionByName(by_trails)
    return out.select("root", F.col("src").alias("from_uid"), "from_name", F.col("dst").alias("to_uid"), "to_name", "rel_type").distinct()


def edge_list(graph: Graph) -> DataFrame:
    """All edges whose ends exist, with their ends' names."""
    a = graph.nodes().select(F.col("uid").alias("src"), F.col("name").alias("source_name"))
    b = graph.nodes().select(F.col("uid").alias("dst"), F.col("name").alias("target_name"))
    return graph.edges.join(a, "src").join(b, "dst").select("src", "source_name", "rel_type", "dst", "target_name", "year", "description", "role")


def sample(graph: Graph, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first nodes by uid and, apart from them, the first edges by ends and type."""
    return graph.nodes().orderBy("uid").limit(limit), graph.edges.orderBy("src", "dst", "rel_type", "seq").limit(limit)


def stats(graph: Graph) -> DataFrame:
    """(kind, n): nodes by label, 0 included, and all edges."""
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    out = count("Edge", graph.edges)
    for label, df in graph.labelled():
        out = out.unionByName(count(label, df))
    return out


def known_persons(graph: Graph, limit: int = 200) -> DataFrame:
    return graph.person.select("uid", F.col("original_name").alias("name"), "aliases").orderBy("name", "uid").limit(limit)


def labelled_relations(edges: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Adds the label of each edge's type; a type without one is its own."""
    table = edges.sparkSession.createDataFrame(list(labels.items()), "rel_type string, __label string")
    return edges.join(F.broadcast(table), "rel_type", "left").withColumn("label", F.coalesce("__label", "rel_type")).drop("__label")
