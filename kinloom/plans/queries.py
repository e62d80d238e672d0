"""The registered queries of the graph engine over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import EXTRACTION, extraction, json_text, query_text
from ..functions.text import all_names, chunk_table, clean, numbered, relation_type, specific_names, split_chapters
from ..functions.values import DEFAULT_EDGE_ROLE, MEMORIAL_KEYWORDS, PARTICIPATED, RELATION_LABELS
from ..operators import graph as G
from ..operators import repair as R
from ..operators import search as S
from ..operators import write as W
from ..operators.merge import merge_persons
from ..operators.order import spread
from ..sources.files import checkpoint_dir
from ..sources.models import Stub
from ..sources.tables import books_of, duckdb_ctes, graph_of
from ..streaming import ingest
from . import qa
from .alias_check import clean_aliases
from .summaries import cache_key, event_prompts, person_prompts, summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
P, E = "p7", "e7"
_CTES = duckdb_ctes()
_MEMORIAL = "regexp_matches(concat_ws(' ', coalesce({d}, ''), coalesce({n}, '')), '" + "|".join(MEMORIAL_KEYWORDS) + "')"


def _scratch(spark: SparkSession, what: str) -> str:
    """A new place in the session's checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def _query(name: str, sql: str | None = None, graph: bool = True):
    """Registers f(graph) or f(spark, sf_dir) under a name; sql goes behind the graph's own CTEs."""

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(graph_of(spark, sf_dir))) if graph else f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH RECURSIVE {_CTES}, " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else f"WITH {_CTES} {sql}") if graph else sql
        return f

    return add


@_query("f1_persons_named", "SELECT uid, original_name, role FROM person WHERE original_name = 'Alias7' OR list_contains(aliases, 'Alias7')")
def _(g):
    return G.persons_named(g, "Alias7").select("uid", "original_name", "role")


@_query(
    "j1_neighbourhood",
    f"""SELECT o AS other_uid, n.label AS other_label, n.name AS other_name, rel_type, direction, year, description FROM (
    SELECT CASE WHEN src = '{P}' THEN dst ELSE src END AS o, rel_type, CASE WHEN src = '{P}' THEN 'outgoing' ELSE 'incoming' END AS direction, year, description
    FROM edges WHERE src = '{P}' OR dst = '{P}') x JOIN nodes n ON n.uid = x.o""",
)
def _(g):
    return G.neighbourhood(g, P).select("other_uid", "other_label", "other_name", "rel_type", "direction", "year", "description")


@_query(
    "j2_relations_without_events",
    """SELECT CASE WHEN src = 'p50' THEN dst ELSE src END AS other_uid, rel_type, description FROM edges
    WHERE (src = 'p50' OR dst = 'p50') AND rel_type <> 'PARTICIPATED_IN' AND (CASE WHEN src = 'p50' THEN dst ELSE src END) IN (SELECT uid FROM nodes)""",
)
def _(g):
    return G.neighbourhood(g, "p50", participation=False).select("other_uid", "rel_type", "description")


@_query("j3_adopted_sons", "SELECT p.uid, p.original_name AS name, p.role, e.description AS relation FROM edges e JOIN person p ON p.uid = e.dst WHERE e.src = 'p5' AND rel_type = 'ADOPTED_SON'")
def _(g):
    return G.adopted_sons(g, "p5")


@_query("j4_person_events", f"SELECT v.uid, v.name, v.event_type, v.year, e.role, v.description FROM edges e JOIN event v ON v.uid = e.dst WHERE e.src = '{P}' AND rel_type = 'PARTICIPATED_IN' ORDER BY v.year ASC NULLS LAST, v.uid LIMIT 50")
def _(g):
    return G.person_events(g, P, 50)


@_query("j5_event_participants", f"SELECT p.uid, p.original_name AS name, p.role, e.role AS event_role FROM edges e JOIN person p ON p.uid = e.src WHERE e.dst = '{E}' AND rel_type = 'PARTICIPATED_IN'")
def _(g):
    return G.event_participants(g, E)


@_query("j6_succession", "SELECT e.src AS person_uid, p.original_name AS person_name, e.rel_type, e.dst AS target_uid, n.name AS target_name, e.year, e.description FROM edges e JOIN person p ON p.uid = e.src JOIN nodes n ON n.uid = e.dst WHERE e.rel_type IN ('REPLACED', 'SUCCEEDED')")
def _(g):
    return G.succession(g)


@_query(
    "j7_family_tree",
    """WITH fam AS (SELECT DISTINCT src, dst, rel_type FROM edges WHERE rel_type IN ('FATHER_OF', 'ADOPTED_SON', 'SPOUSE', 'SIBLING')
        AND src IN (SELECT uid FROM person) AND dst IN (SELECT uid FROM person)),
    reach(root, pt, d) AS (SELECT uid, uid, 0 FROM person WHERE uid IN ('p7', 'p8', 'p300')
        UNION SELECT r.root, CASE WHEN f.src = r.pt THEN f.dst ELSE f.src END, r.d + 1 FROM reach r JOIN fam f ON f.src = r.pt OR f.dst = r.pt WHERE r.d < 2)
    SELECT DISTINCT r.root, f.src AS from_uid, a.original_name AS from_name, f.dst AS to_uid, b.original_name AS to_name, f.rel_type
    FROM reach r JOIN fam f ON f.src = r.pt OR f.dst = r.pt JOIN person a ON a.uid = f.src JOIN person b ON b.uid = f.dst""",
)
def _(g):
    return G.family_tree(g, g.person.where(F.col("uid").isin("p7", "p8", "p300")).select("uid"), 3)


@_query(
    "j7_family_trails",
    """WITH kin AS (SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('FATHER_OF', 'ADOPTED_SON', 'SPOUSE', 'SIBLING')
        UNION ALL SELECT uid, 'd' || CAST(seq % 25 AS VARCHAR), 'FATHER_OF' FROM person WHERE seq % 60 = 7
        UNION ALL SELECT 'd' || CAST(seq % 25 AS VARCHAR), uid, 'SIBLING' FROM person WHERE seq % 60 = 8),
    ext AS (SELECT *, row_number() OVER (ORDER BY src, dst, rel_type) AS e FROM kin WHERE src IN (SELECT uid FROM nodes) AND dst IN (SELECT uid FROM nodes)),
    arc AS (SELECT e, src AS x, dst AS y FROM ext UNION ALL SELECT e, dst, src FROM ext WHERE src <> dst),
    trail(root, x, path) AS (SELECT uid, uid, CAST([] AS BIGINT[]) FROM person WHERE uid IN ('p7', 'p8', 'p300')
        UNION ALL SELECT t.root, a.y, list_append(t.path, a.e) FROM trail t JOIN arc a ON a.x = t.x WHERE len(t.path) < 3 AND NOT list_contains(t.path, a.e))
    SELECT DISTINCT t.root, f.src AS from_uid, a.original_name AS from_name, f.dst AS to_uid, b.original_name AS to_name, f.rel_type
    FROM (SELECT root, unnest(path) AS e FROM trail WHERE x IN (SELECT uid FROM person)) t JOIN ext f ON f.e = t.e LEFT JOIN person a ON a.uid = f.src LEFT JOIN person b ON b.uid = f.dst""",
)
def _(g):
    """With dynasties on the trails."""
    dynasty, null = F.concat(F.lit("d"), (F.col("seq") % 25).cast("string")), F.lit(None)

    def more(src, kind, dst, rest):
        return g.person.where(F.col("seq") % 60 == rest).select(src.alias("src"), F.lit(kind).alias("rel_type"), dst.alias("dst"), null.cast("int").alias("year"), null.cast("string").alias("description"), null.cast("string").alias("role"), "seq")

    kin = g.edges.unionByName(more(F.col("uid"), "FATHER_OF", dynasty, 7)).unionByName(more(dynasty, "SIBLING", F.col("uid"), 8))
    return G.family_trails(g.with_edges(kin), g.person.where(F.col("uid").isin("p7", "p8", "p300")).select("uid"), 3)


@_query("s12_versions", """SELECT 'person' AS kind, uid AS key, CASE WHEN seq % 7 = 0 AND seq % 10 < 5 THEN 'role ' || CAST(least(seq % 10, 3) AS VARCHAR) ELSE role END AS value FROM person
    UNION ALL SELECT 'person', 'x' || CAST(seq AS VARCHAR), 'new' FROM person WHERE seq % 9 = 2
    UNION ALL SELECT 'edge', src || ' ' || rel_type || ' ' || dst, CASE WHEN rel_type = 'REPLACED' THEN 'changed' ELSE description END FROM edges WHERE rel_type <> 'KILLED'""")
def _(g):
    """A snapshot and six versions of changes on it, read back: later ones change rows of earlier ones, and parts are merged on the way."""
    spark, root = g.person.sparkSession, _scratch(g.person.sparkSession, "versions")
    none = {name: df.limit(0) for name, df in (("person", g.person), ("dynasty", g.dynasty), ("event", g.event), ("place", g.place), ("edges", g.edges))}
    G.save(g, f"{root}/v0")
    last = "v0"

    def version(name, gone=None, **changed):
        nonlocal last
        G.save_changes(G.Graph(**none | changed), root, name, last, gone, width=2)
        last = name

    for k in range(4):
        # version k changes what the ones before it changed, and more
        version(f"v{k + 1}", person=g.person.where((F.col("seq") % 7 == 0) & (F.col("seq") % 10 >= k) & (F.col("seq") % 10 < 5)).withColumn("role", F.lit(f"role {k}")))
    version("v5", {"edges": g.edges.where("rel_type = 'KILLED'")}, edges=g.edges.where("rel_type = 'REPLACED'").withColumn("description", F.lit("changed")))
    version("v6", person=g.person.where("seq % 9 = 2").withColumns({"uid": F.concat(F.lit("x"), F.col("seq").cast("string")), "role": F.lit("new")}))
    found = G.load(spark, f"{root}/{last}")
    persons = found.person.select(F.lit("person").alias("kind"), F.col("uid").alias("key"), F.col("role").alias("value"))
    return persons.union(found.edges.select(F.lit("edge"), F.concat_ws(" ", "src", "rel_type", "dst"), "description"))


@_query("j8_edge_list", "SELECT e.src, a.name AS source_name, e.rel_type, e.dst, b.name AS target_name, e.year, e.description, e.role FROM edges e JOIN nodes a ON a.uid = e.src JOIN nodes b ON b.uid = e.dst")
def _(g):
    return G.edge_list(g)


_INDEX = """idx AS (SELECT unnest(list_concat([original_name], aliases)) AS name, uid, 'Person' AS label, 0 AS priority, seq FROM person
    UNION ALL SELECT name, uid, 'Dynasty', 1, seq FROM dynasty UNION ALL SELECT name, uid, 'Event', 2, seq FROM event UNION ALL SELECT name, uid, 'Place', 3, seq FROM place)"""


@_query(
    "j9_resolve_names",
    f"""WITH {_INDEX}, wanted AS (SELECT DISTINCT name FROM (SELECT founder AS name FROM dynasty UNION ALL SELECT unnest(participants) FROM event UNION ALL SELECT name FROM place UNION ALL SELECT 'nobody'))
    SELECT w.name, arg_min(i.uid, (i.priority, i.seq, i.uid)) AS uid, arg_min(i.label, (i.priority, i.seq, i.uid)) AS label FROM wanted w LEFT JOIN idx i ON i.name = w.name GROUP BY w.name""",
)
def _(g):
    names = g.dynasty.select(F.col("founder").alias("name")).union(g.event.select(F.explode("participants"))).union(g.place.select("name"))
    return G.resolve_names(g, names.union(names.sparkSession.createDataFrame([("nobody",)], "name string")))


@_query("j11_participants", """WITH idx AS (SELECT unnest(list_concat([original_name], aliases)) AS name, uid, seq FROM person),
    wanted AS (SELECT uid AS event_uid, CASE seq % 3 WHEN 0 THEN 'p' || CAST(seq % 90 + 1 AS VARCHAR) WHEN 1 THEN 'nobody' || CAST(seq AS VARCHAR) ELSE unnest(participants) END AS n FROM event),
    named AS (SELECT event_uid, n, arg_min(i.uid, (i.seq, i.uid)) AS u FROM wanted JOIN idx i ON i.name = n GROUP BY event_uid, n)
    SELECT DISTINCT w.event_uid, coalesce(u, p.uid) AS uid FROM wanted w LEFT JOIN named m ON m.event_uid = w.event_uid AND m.n = w.n LEFT JOIN person p ON p.uid = w.n WHERE coalesce(u, p.uid) IS NOT NULL""")
def _(g):
    name = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("p"), (F.col("seq") % 90 + 1).cast("string"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("nobody"), F.col("seq").cast("string"))).otherwise(F.col("name"))
    links = g.event.select("uid", "seq", F.explode("participants").alias("name"))
    return G.resolve_participants(g, links.select(F.col("uid").alias("event_uid"), name.alias("name")))


@_query("j13_relations_to_edges", """WITH found AS (SELECT name, arg_min(uid, seq) AS uid FROM (SELECT unnest(list_concat([original_name], aliases)) AS name, uid, seq FROM person) GROUP BY name)
    SELECT a.uid AS src, 'KNEW_OF' AS rel_type, b.uid AS dst, p.seq FROM person p JOIN found a ON a.name = p.original_name JOIN found b ON b.name = 'Nick' || CAST(p.seq * 2 AS VARCHAR)""")
def _(g):
    rows = g.person.select(F.col("original_name").alias("source"), F.concat(F.lit("Nick"), (F.col("seq") * 2).cast("string")).alias("target"), F.lit("knew of").alias("relation_type"), F.lit(None).cast("int").alias("year"), F.lit("").alias("description"), "seq")
    return W.relations_to_edges(g, rows)[0].select("src", "rel_type", "dst", "seq")


@_query("j20_relation_labels", f"WITH lab(rel_type, l) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in RELATION_LABELS.items())}) SELECT e.rel_type, coalesce(l, e.rel_type) AS label, count(*) AS n FROM edges e LEFT JOIN lab USING (rel_type) GROUP BY ALL")
def _(g):
    return G.labelled_relations(g.edges, RELATION_LABELS).groupBy("rel_type", "label").agg(F.count("*").alias("n"))


@_query("a1_stats", "SELECT label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'Edge', count(*) FROM edges")
def _(g):
    return G.stats(g)


@_query("a4_parallel_groups", "SELECT src, rel_type, dst, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def _(g):
    return R.parallel_groups(g.edges)


_DEAD = f"dead AS (SELECT e.src, e.dst, p.original_name AS person_name, p.death_year, v.year AS event_year, {_MEMORIAL.format(d='v.description', n='v.name')} AS memorial FROM edges e JOIN person p ON p.uid = e.src JOIN event v ON v.uid = e.dst WHERE rel_type = 'PARTICIPATED_IN' AND v.year > p.death_year)"


@_query("a5_post_death_report", f"WITH {_DEAD} SELECT src AS uid, person_name AS name, count(*) AS n_post_death FROM dead GROUP BY ALL HAVING count(*) > 3")
def _(g):
    return R.post_death_report(g, 3, None)


@_query("a6_event_counts", "SELECT src AS uid, count(*) AS n_events FROM edges WHERE rel_type = 'PARTICIPATED_IN' AND src IN (SELECT uid FROM person WHERE role = 'BUILDING') GROUP BY src")
def _(g):
    return R.event_counts(g, g.person.where("role = 'BUILDING'"))


_NAMES = """names AS (SELECT coalesce(x.name, y.name) AS name, coalesce(p, a) AS uid FROM (SELECT original_name AS name, arg_max(uid, seq) AS p FROM person GROUP BY 1) x
    FULL JOIN (SELECT name, arg_min(uid, seq) AS a FROM (SELECT unnest(aliases) AS name, uid, seq FROM person) WHERE length(name) > 1 GROUP BY 1) y ON x.name = y.name)"""


@_query("a10_name_map", f"WITH {_NAMES} SELECT name, uid FROM names")
def _(g):
    return R.name_map(g)


@_query("j14_post_death_links", f"WITH {_DEAD} SELECT * FROM dead")
def _(g):
    return R.post_death_links(g).select("src", "dst", "person_name", "death_year", "event_year", "memorial")


@_query("j15_mentions", "SELECT v.uid AS id, p.uid FROM event v JOIN person p ON contains(v.description, p.original_name)")
def _(g):
    return R.mentions(g.event.select(F.col("uid").alias("id"), F.col("description").alias("text")), g.person.select(F.col("original_name").alias("name"), "uid"))


@_query(
    "j17_missing_links",
    f"""WITH {_NAMES}, listed AS (SELECT x.id, n.uid FROM (SELECT uid AS id, unnest(participants) AS name FROM event) x JOIN names n USING (name)),
    found AS (SELECT DISTINCT v.uid AS id, n.uid FROM event v JOIN (SELECT * FROM names WHERE length(name) >= 2 AND name LIKE 'Customer%') n ON contains(concat_ws(' ', v.description, v.name), n.name)),
    links AS (SELECT * FROM listed UNION SELECT * FROM found)
    SELECT l.uid AS src, l.id AS dst FROM links l JOIN person p ON p.uid = l.uid JOIN event v ON v.uid = l.id
    WHERE (coalesce(v.year <= p.death_year, true) OR {_MEMORIAL.format(d='v.description', n='v.name')})
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel_type = 'PARTICIPATED_IN' AND e.src = l.uid AND e.dst = l.id)""",
)
def _(g):
    return R.missing_links(g)


@_query("d1_d2_clean_edges", "SELECT src, rel_type, dst, arg_min(description, seq) AS description, min(seq) AS seq FROM edges WHERE src <> dst GROUP BY src, rel_type, dst")
def _(g):
    return W.without_parallels(W.without_self_loops(g.edges)).select("src", "rel_type", "dst", "description", "seq")


@_query("d3_prune_post_death", f"WITH {_DEAD} SELECT src, rel_type, dst, seq FROM edges e WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE NOT memorial AND d.src = e.src AND d.dst = e.dst AND e.rel_type = 'PARTICIPATED_IN')")
def _(g):
    return R.prune_post_death(g).select("src", "rel_type", "dst", "seq")


@_query("k1_upsert_nodes", """WITH both_ AS (SELECT uid, name, founder, description, capital, start_year, end_year, seq FROM dynasty
    UNION ALL SELECT uid, name || ' II', '', 'new', CASE WHEN seq % 2 = 0 THEN 'Cap' || CAST(seq AS VARCHAR) ELSE '' END, CASE WHEN seq % 2 = 0 THEN 0 END, 950, seq + 1000 FROM dynasty WHERE seq % 3 = 0)
    SELECT uid, arg_max(name, seq) AS name, arg_max(description, seq) AS description, arg_max(founder, seq) FILTER (WHERE founder <> '') AS founder, arg_max(capital, seq) FILTER (WHERE capital <> '') AS capital,
    arg_max(start_year, seq) FILTER (WHERE start_year IS NOT NULL) AS start_year, arg_max(end_year, seq) FILTER (WHERE end_year IS NOT NULL) AS end_year, min(seq) AS seq FROM both_ GROUP BY uid""")
def _(g):
    even = F.col("seq") % 2 == 0
    new = g.dynasty.where("seq % 3 = 0").select("uid", F.concat("name", F.lit(" II")).alias("name"), F.lit("").alias("founder"), F.when(even, F.concat(F.lit("Cap"), F.col("seq").cast("string"))).otherwise("").alias("capital"), F.when(even, F.lit(0)).alias("start_year"), F.lit(950).alias("end_year"), F.lit("new").alias("description"), (F.col("seq") + 1000).alias("seq"))
    return W.upsert_nodes(g.dynasty, new, ["name", "description"], ["founder", "capital", "start_year", "end_year"])


@_query("k3_upsert_edges", "SELECT src, rel_type, dst, arg_max(year, seq) FILTER (WHERE year IS NOT NULL) AS year, arg_max(description, seq) AS description, min(seq) AS seq FROM edges GROUP BY src, rel_type, dst")
def _(g):
    return W.upsert_edges(g.edges.where("seq < 1000000000"), g.edges.where("seq >= 1000000000")).select("src", "rel_type", "dst", "year", "description", "seq")


@_query("k4_participation_edges", "WITH idx AS (SELECT unnest(list_concat([original_name], aliases)) AS name, uid, seq FROM person) SELECT arg_min(i.uid, (i.seq, i.uid)) AS src, x.uid AS dst, any_value(x.seq) AS seq FROM (SELECT uid, seq, unnest(participants) AS n FROM event) x JOIN idx i ON i.name = x.n GROUP BY x.uid, x.n")
def _(g):
    return W.participation_edges(g, g.event).where((F.col("role") == DEFAULT_EDGE_ROLE) & (F.col("rel_type") == PARTICIPATED)).select("src", "dst", "seq")


@_query("k6_founder_edges", "WITH idx AS (SELECT unnest(list_concat([original_name], aliases)) AS name, uid, seq FROM person) SELECT arg_min(i.uid, i.seq) AS src, 'FOUNDED' AS rel_type, d.uid AS dst FROM dynasty d JOIN idx i ON i.name = d.founder GROUP BY d.uid")
def _(g):
    return W.founder_edges(g).select("src", "rel_type", "dst")


@_query("k2_merge_persons", """SELECT uid, original_name, CASE WHEN seq % 5 = 0 THEN 'Nick' || CAST(seq AS VARCHAR) || ',Second' || CAST(seq AS VARCHAR) ELSE 'Nick' || CAST(seq AS VARCHAR) END AS aliases,
    CASE WHEN seq % 20 = 0 THEN '其他' WHEN seq % 10 = 0 THEN 'SPY' ELSE role END AS role, array_to_string(loyalty, ',') || CASE WHEN seq % 5 = 0 THEN ',x' ELSE '' END AS loyalty,
    CASE WHEN seq % 30 = 0 THEN NULL WHEN seq % 15 = 0 THEN 880 ELSE birth_year END AS birth_year, CASE WHEN seq % 5 = 0 THEN coalesce(death_year, 950) ELSE death_year END AS death_year,
    CASE WHEN seq % 5 = 0 THEN coalesce(death_cause, 'unknown') ELSE death_cause END AS death_cause, CASE WHEN seq % 25 = 0 THEN description || ' and more' ELSE description END AS description, seq FROM person""")
def _(g):
    number, every = F.col("seq").cast("string"), lambda n: F.col("seq") % n == 0
    twins = g.person.where(every(5)).select(
        F.concat("uid", F.lit("x")).alias("uid"), F.concat(F.lit("Nick"), number).alias("original_name"), F.array(F.concat(F.lit("Second"), number)).alias("aliases"),
        F.when(every(20), F.lit(None)).when(every(10), "SPY").otherwise("其他").alias("role"), F.array_append("loyalty", F.lit("x")).alias("loyalty"), F.when(every(30), 0).otherwise(880).alias("birth_year"), F.lit(950).alias("death_year"),
        F.lit("unknown").alias("death_cause"), F.when(every(25), F.concat("description", F.lit(" and more"))).otherwise("short").alias("description"), (F.col("seq") + 10_000_000).alias("seq"))
    plain = g.person.withColumns({"aliases": F.slice("aliases", 2, 1), "role": F.when(every(10), "其他").otherwise(F.col("role")), "birth_year": F.when(~every(15), F.col("birth_year"))})
    return merge_persons(plain.unionByName(twins)).withColumns({c: F.array_join(c, ",") for c in ("aliases", "loyalty")})


@_query("k2_batches", """WITH n AS (SELECT max(seq) AS m FROM person), nick AS (SELECT *, CAST(seq AS VARCHAR) AS k, seq % 10 = 0 AS t FROM person, n)
    SELECT uid, original_name, CASE WHEN t THEN array_to_string(list_sort(list_distinct(list_concat(aliases, ['Nick' || CAST(seq + 1 AS VARCHAR), 'Extra' || k, 'Late' || k], CASE WHEN seq + 5 > m THEN ['New' || CAST(seq + 5 AS VARCHAR)] ELSE [] END))), ',') ELSE array_to_string(aliases, ',') END AS aliases,
      CASE WHEN t THEN coalesce(death_cause, 'known') ELSE death_cause END AS death_cause FROM nick
    UNION ALL SELECT 'n' || k, 'New' || k, CASE WHEN seq >= 5 THEN 'Late' || CAST(seq - 5 AS VARCHAR) ELSE '' END, NULL FROM nick WHERE seq % 10 = 5""")
def _(g):
    """Three batches on the stored persons: records that bear names of two stored nodes, records that the batch before made match, and new nodes that the same batch matches."""
    k = lambda prefix, add=0: F.concat(F.lit(prefix), (F.col("seq") + add).cast("string"))

    def batch(where, uid, name, aliases, arrival, cause=None):
        blank = {c: F.lit(None).cast(t) for c, t in (("birth_year", "int"), ("death_year", "int"))}
        rows = g.person.where(where).select(uid.alias("uid"), name.alias("original_name"), F.array(*aliases).cast("array<string>").alias("aliases"), F.lit("其他").alias("role"), "loyalty", F.lit("").alias("description"), (F.col("seq") + arrival).alias("seq"), F.lit(cause).cast("string").alias("death_cause"))
        return rows.withColumns(blank)

    tens, fives = "seq % 10 = 0", "seq % 10 = 5"
    nodes = merge_persons(batch(tens, k("b"), k("Nick"), [k("Nick", 1), k("Extra")], 10**9), g.person)
    nodes = merge_persons(batch(tens, k("c"), k("Nick", 1), [k("Late")], 2 * 10**9, "known"), nodes)
    last = batch(fives, k("n"), k("New"), [], 3 * 10**9).unionByName(batch(tens, k("f"), k("Late"), [k("New", 5)], 4 * 10**9))
    return merge_persons(last, nodes).select("uid", "original_name", F.array_join("aliases", ",").alias("aliases"), "death_cause")


@_query("as_of_edges", """WITH c AS (SELECT seq AS k, 'q' || CAST(seq AS VARCHAR) AS q FROM person)
    SELECT q AS src, 'BEFORE' AS rel_type, 'q' || CAST(k - 1 AS VARCHAR) AS dst FROM c WHERE k > 0 AND k % 7 > 0 UNION ALL SELECT q, 'KNOWS', 'p' || CAST(k AS VARCHAR) FROM c
    UNION ALL SELECT q, 'PARTICIPATED_IN', 'y' || CAST(k AS VARCHAR) FROM c UNION ALL SELECT q, 'AGAIN', 'q' || CAST(k - 1 AS VARCHAR) FROM c WHERE k % 7 = 0""")
def _(g):
    """One batch of a chunk for each person: names of later chunks are not known yet, and a name that a chunk took from a node is gone."""
    # every seventh chunk renames the node of the chunk before
    said = """'{"dynasties":[],"places":[],"persons":[{"uid":"q', k, '","original_name":"Chunk', k, '"}', if(seq % 7 = 0, concat(',{"uid":"q', p, '","original_name":"Again', p, '"}'), ''), '],"events":[{"uid":"y', k, '","name":"y","participants":["Chunk', k, '","Chunk', n, '"]}],"relations":[',
        '{"source":"Chunk', k, '","target":"Chunk', p, '","relation_type":"before"},{"source":"Chunk', k, '","target":"Chunk', n, '","relation_type":"after"},{"source":"Chunk', k, '","target":"Again', p, '","relation_type":"again"},{"source":"Chunk', k, '","target":"', original_name, '","relation_type":"knows"}]}'"""
    rows = g.person.selectExpr("seq", "original_name", "CAST(seq AS STRING) AS k", "CAST(seq - 1 AS STRING) AS p", "CAST(seq + 1 AS STRING) AS n")
    rows = spread(rows).select("seq", F.from_json(F.expr(f"concat({said})"), EXTRACTION).alias("result"))
    return ingest.apply_results(g, rows).edges.where("src LIKE 'q%'").select("src", "rel_type", "dst")


@_query("k7_correct_known", """SELECT uid, CASE WHEN seq % 10 = 0 THEN 'Fixed' || CAST(seq AS VARCHAR) ELSE original_name END AS original_name, CASE WHEN seq % 10 = 0 THEN 'A,B' ELSE array_to_string(aliases, ',') END AS aliases,
    CASE WHEN seq % 10 = 0 THEN 'king' ELSE role END AS role, CASE WHEN seq % 10 = 0 THEN 'l1,l2' ELSE array_to_string(loyalty, ',') END AS loyalty, CASE WHEN seq % 20 = 0 THEN 850 ELSE birth_year END AS birth_year, death_year,
    CASE WHEN seq % 10 = 0 THEN 'sword' ELSE death_cause END AS death_cause, CASE WHEN seq % 10 = 0 THEN 'checked' ELSE description END AS description FROM person""")
def _(g):
    known = g.person.where("seq % 10 = 0").select("uid", F.concat(F.lit("Fixed"), F.col("seq").cast("string")).alias("original_name"), F.array(F.lit("B"), F.lit("A")).alias("correct_aliases"), F.lit("king").alias("role"), F.when(F.col("seq") % 20 == 0, 850).alias("birth_year"), F.lit(None).cast("int").alias("death_year"), F.lit("sword").alias("death_cause"), F.array(F.lit("l1"), F.lit("l2")).alias("loyalty"), F.lit("checked").alias("description"))
    right = g.person.where("seq % 7 = 0 AND seq % 10 > 0").select("uid", "original_name", F.col("aliases").alias("correct_aliases"), F.lit("not used").alias("role"), "birth_year", "death_year", "death_cause", "loyalty", "description")
    return R.correct_known(g, known.unionByName(right))[0].person.drop("seq").withColumns({c: F.array_join(c, ",") for c in ("aliases", "loyalty")})


@_query("k8_alias_verdicts", "SELECT uid, CASE WHEN seq % 4 = 0 THEN 'A,B' ELSE array_to_string(aliases, ',') END AS aliases FROM person")
def _(g):
    verdicts = g.person.select("uid", F.array(F.lit("B"), F.lit("A"), F.lit("B")).alias("correct_aliases"), F.when(F.col("seq") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("wrong_aliases"))
    return R.apply_alias_verdicts(g.person, verdicts).select("uid", F.array_join("aliases", ",").alias("aliases"))


@_query("o5_alias_suspects", "SELECT uid, original_name AS name, len(aliases) AS n_aliases FROM person WHERE len(aliases) >= 2 ORDER BY n_aliases DESC, uid LIMIT 20")
def _(g):
    return R.alias_suspects(g, 2, limit=20).withColumn("n_aliases", F.col("n_aliases").cast("long"))


@_query("o6_sample_nodes", "SELECT uid, label, name FROM nodes ORDER BY uid LIMIT 500")
def _(g):
    return G.sample(g)[0].select("uid", "label", "name")


@_query("o6_sample_edges", "SELECT src, rel_type, dst, seq FROM edges ORDER BY src, dst, rel_type, seq LIMIT 500")
def _(g):
    return G.sample(g)[1].select("src", "rel_type", "dst", "seq")


@_query("o7_known_persons", "SELECT uid, original_name AS name FROM person ORDER BY original_name, uid LIMIT 200")
def _(g):
    return G.known_persons(g).select("uid", "name")


def _bm25(table: str, text: str, one: str, two: str, key: str = "uid") -> str:
    """SQL for the ten best rows by the terms one and two."""
    return f"""WITH d AS (SELECT uid, regexp_extract_all(lower({text}), '[a-z0-9]+|[一-鿿]') AS t FROM {table}),
    f AS (SELECT uid, len(t) * 1.0 AS n, len(list_filter(t, lambda x: x = '{one}')) * 1.0 AS f1, len(list_filter(t, lambda x: x = '{two}')) * 1.0 AS f2 FROM d),
    s AS (SELECT count(*) AS c, avg(n) AS m, count_if(f1 > 0) AS d1, count_if(f2 > 0) AS d2 FROM f)
    SELECT uid AS {key}, round(ln(1 + (c - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (c - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score
    FROM f, s WHERE f1 > 0 OR f2 > 0 ORDER BY score DESC, uid LIMIT 10"""


_PERSON_TEXT = "concat_ws(' ', original_name, description)"


@_query("t1_fulltext", _bm25("person", _PERSON_TEXT, "building", "7"))
def _(g):
    return S.search(g.person, F.concat_ws(" ", "original_name", "description"), "Building 7")


@_query("t1_indexed", _bm25("person", _PERSON_TEXT, "building", "7", "key"))
def _(g):
    path = _scratch(g.person.sparkSession, "index")
    S.write_index(g.person, F.concat_ws(" ", "original_name", "description"), path)
    return S.search_index(g.person.sparkSession, path, "Building 7")


@_query("t2_events_fulltext", _bm25("event", "concat_ws(' ', name, description)", "order", "17"))
def _(g):
    return S.search(g.event, F.concat_ws(" ", "name", "description"), "Order 17")


@_query("u2_search_persons", "SELECT uid FROM person WHERE original_name = 'Nick7' OR list_contains(aliases, 'Nick7')")
def _(g):
    return S.search_persons(g.person, "Nick7").select("uid")


@_query("u2_search_by_text", _bm25("person", _PERSON_TEXT, "building", "7"))
def _(g):
    return S.search_persons(g.person, "Building 7")


@_query("x17_names", """SELECT uid, array_to_string(list_sort(list_distinct(list_filter(list_concat([original_name], aliases, [role, '太宗', 'x', '', uid]), lambda x: x <> ''))), ',') AS names,
    array_to_string(list_sort(list_distinct(list_filter(list_concat([original_name], aliases, [role, 'x', uid]), lambda x: length(x) > 1))), ',') AS specific FROM person""")
def _(g):
    names = all_names(F.col("original_name"), F.concat("aliases", F.array("role", F.lit("太宗"), F.lit("x"), F.lit(""), "uid", "original_name")))
    return g.person.select("uid", F.array_join(F.array_sort(names), ",").alias("names"), F.array_join(F.array_sort(specific_names(names)), ",").alias("specific"))


_G5 = ORACLE_SQL["j6_succession"].removeprefix(f"WITH {_CTES} ")


@_query("g5_canned_routes", f"""WITH own AS (SELECT uid FROM person WHERE original_name = 'Nick7' OR list_contains(aliases, 'Nick7') ORDER BY seq, uid LIMIT 1),
    fam AS (SELECT DISTINCT src, dst, rel_type FROM edges WHERE rel_type IN ('FATHER_OF', 'ADOPTED_SON', 'SPOUSE', 'SIBLING') AND src IN (SELECT uid FROM person) AND dst IN (SELECT uid FROM person)),
    reach(pt, d) AS (SELECT uid, 0 FROM own UNION SELECT CASE WHEN f.src = r.pt THEN f.dst ELSE f.src END, r.d + 1 FROM reach r JOIN fam f ON f.src = r.pt OR f.dst = r.pt WHERE r.d < 2)
    SELECT 'succession' AS source, person_uid AS a, rel_type AS kind, target_uid AS b FROM ({_G5})
    UNION ALL SELECT 'adopted_sons', p.uid, NULL, p.original_name FROM edges e JOIN person p ON p.uid = e.dst WHERE e.src IN (SELECT uid FROM own) AND rel_type = 'ADOPTED_SON'
    UNION ALL SELECT DISTINCT 'family', f.src, f.rel_type, f.dst FROM reach r JOIN fam f ON f.src = r.pt OR f.dst = r.pt
    UNION ALL SELECT 'relations', o, rel_type, d FROM (SELECT CASE WHEN e.src = w.uid THEN e.dst ELSE e.src END AS o, rel_type, CASE WHEN e.src = w.uid THEN 'outgoing' ELSE 'incoming' END AS d FROM edges e JOIN own w ON e.src = w.uid OR e.dst = w.uid) JOIN nodes n ON n.uid = o""")
def _(g):
    found = qa.canned(g, "Nick7的义子，皇位更替").unionByName(qa.canned(g, "Nick7家族")).unionByName(qa.canned(g, "Nick7的关系"))
    get = lambda *names: F.coalesce(*[F.get_json_object("row", f"$.{n}") for n in names])
    return found.select("source", get("person_uid", "from_uid", "other_uid", "uid").alias("a"), get("rel_type").alias("kind"), get("target_uid", "to_uid", "direction", "name").alias("b"))


@_query("g2_guarded_query", "SELECT label, count(*) AS n FROM nodes GROUP BY label")
def _(g):
    return qa.run_query(g, "WITH x AS (SELECT label FROM nodes) SELECT label, count(*) AS n FROM x GROUP BY label")


@_query("x6_clean", "SELECT doc_id, md5(trim(array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\n{3,}', '\n\n', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13))) AS h FROM documents".replace("'\n\n'", "chr(10) || chr(10)"), graph=False)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(clean(F.coalesce("text", F.lit("")))).alias("h"))


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
#: Chunks of the documents as books without headings, cut sentence by sentence.
_CHUNKS = f"""WITH RECURSIVE lines AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    body AS (SELECT name, l, list_position(list_transform(l, lambda x: length(trim(x, {_BLANK})) > 100), true) AS b FROM lines),
    books AS (SELECT name, array_to_string(CASE WHEN b > 1 THEN l[b:] ELSE l END, chr(10)) AS t FROM body),
    cut AS (SELECT name, list_filter(list_transform(string_split(regexp_replace(t, '([。！？；\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS s FROM books),
    fold(name, i, s, open_, done) AS (SELECT name, 0, s, '', NULL::VARCHAR FROM cut
        UNION ALL SELECT name, i + 1, s, CASE WHEN length(open_) + length(s[i + 1]) <= 1500 THEN open_ || s[i + 1] ELSE right(open_, 200) || s[i + 1] END,
            CASE WHEN length(open_) + length(s[i + 1]) > 1500 AND open_ <> '' THEN open_ END FROM fold WHERE i < len(s)),
    chunk AS (SELECT name, i, done AS c FROM fold WHERE done IS NOT NULL UNION ALL SELECT name, i + 1, open_ FROM fold WHERE i = len(s) AND open_ <> '')"""


@_query("x7_chunks", f"{_CHUNKS} SELECT name, 0 AS chapter_no, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS chunk_no, '全文' AS chapter, md5(c) AS content, length(c) AS char_count, 'chunk_' || lpad(CAST(row_number() OVER (ORDER BY name, i) - 1 AS VARCHAR), 5, '0') AS chunk_id FROM chunk", graph=False)
def _(spark, sf_dir):
    return numbered(chunk_table(books_of(spark, sf_dir))).withColumns({"content": F.md5("content"), "chunk_no": F.col("chunk_no").cast("long"), "char_count": F.col("char_count").cast("long")})


@_query("a8_chunks_by_chapter", f"{_CHUNKS} SELECT '全文' AS chapter, count(*) AS n_chunks FROM chunk HAVING count(*) > 0", graph=False)
def _(spark, sf_dir):
    rows = chunk_table(books_of(spark, sf_dir))
    return rows.groupBy("chapter").agg(F.count("*").alias("n_chunks"), F.min(F.struct("name", "chapter_no")).alias("first")).orderBy("first").select("chapter", "n_chunks").limit(20)


_TIDY = f"trim(array_to_string(list_transform(string_split(regexp_replace(BODY, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x, {_BLANK})), chr(10)), {_BLANK})"


@_query(
    "x1_chapters",
    f"""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS name, doc_id % 3 AS k, repeat('x', 120) || chr(10) || coalesce(text, '') AS t FROM documents),
    c AS (SELECT name, k, {_TIDY.replace('BODY', 't')} AS content FROM b)
    SELECT name, 0 AS chapter_no, '第一章 Start' AS chapter, md5(content) AS content FROM c UNION ALL SELECT name, 1, CASE k WHEN 0 THEN '第二章 Sub' WHEN 1 THEN '第二章' ELSE '第2回 Plain' END, md5(content) FROM c""",
    graph=False,
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.concat(F.repeat(F.lit("x"), 120), F.lit("\n"), F.coalesce("text", F.lit("")))
    second = F.element_at(F.array(F.lit("\n| 第二章 |\n Sub \n"), F.lit("\n| 第二章|\n"), F.lit("\n第2回 Plain\n")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.lit("目录\n第一章\n第二章\n第一章 Start\n"), body, second, body, F.lit("\n第三章 too short\nend"))
    return split_chapters(docs.select(F.col("doc_id").cast("string").alias("name"), text.alias("text"))).withColumn("content", F.md5("content"))


@_query(
    "x9_snippets",
    """WITH RECURSIVE books AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS book, text FROM documents WHERE text IS NOT NULL), kw(no, kw) AS (VALUES (0, 'the'), (1, 'and'), (2, 'aa')),
    hit(book, text, no, kw, pos) AS (SELECT book, text, no, kw, instr(text, kw) - 1 FROM books, kw WHERE contains(text, kw)
        UNION ALL SELECT book, text, no, kw, pos + length(kw) + 200 + instr(substr(text, pos + length(kw) + 201), kw) - 1 FROM hit WHERE contains(substr(text, pos + length(kw) + 201), kw)),
    cut AS (SELECT book, kw, no, pos, trim(substr(text, greatest(pos - 200, 0) + 1, pos + length(kw) + 200 - greatest(pos - 200, 0)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM hit)
    SELECT book, keyword, md5(t) AS text, keyword_no, pos AS place FROM (SELECT book, kw AS keyword, t, no AS keyword_no, pos, row_number() OVER (PARTITION BY substr(t, 1, 80) ORDER BY book, no, pos) AS r FROM cut) WHERE r = 1 ORDER BY book, keyword_no, place LIMIT 50""",
    graph=False,
)
def _(spark, sf_dir):
    return S.snippets(books_of(spark, sf_dir), ["the", "and", "aa"], limit=50).select("book", "keyword", F.md5("text").alias("text"), "keyword_no", F.col("at").cast("long").alias("place"))


@_query("x10_relation_types", "SELECT t AS raw, coalesce(nullif(regexp_replace(upper(t), '[^\\p{L}\\p{N}_]', '_', 'g'), ''), 'RELATED_TO') AS rel_type, count(*) AS n FROM (SELECT substr(replace(coalesce(text, ''), 'ß', '-'), 1, 12 * CAST(doc_id % 5 AS INT)) AS t FROM documents) GROUP BY ALL", graph=False)
def _(spark, sf_dir):
    raw = F.expr("substr(replace(coalesce(text, ''), 'ß', '-'), 1, 12 * CAST(doc_id % 5 AS INT))")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(raw.alias("raw"))
    return docs.groupBy("raw", relation_type(F.col("raw")).alias("rel_type")).agg(F.count("*").alias("n"))


@_query("x12_lenient_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", graph=False)
def _(spark, sf_dir):
    said = F.concat(F.lit("<think>{ not this }</think>Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.get_json_object(json_text(said), "$.k").cast("long").alias("k"))


@_query("x12_extraction", """SELECT c_custkey, c_name AS name, c_mktsegment AS role, 'a,' || c_name AS aliases, CAST(c_nationkey AS INT) AS birth_year, 'E' || c_name AS event, 'x,y' AS participants, 'D' AS dynasty, 'P' AS place, c_name || '>' || c_mktsegment AS relation FROM customer""", graph=False)
def _(spark, sf_dir):
    text = F.concat(
        F.lit('{"persons":[{"uid":"u","original_name":"'), "c_name", F.lit('","role":"'), "c_mktsegment", F.lit('","aliases":["a","'), "c_name", F.lit('"],"birth_year":'), F.col("c_nationkey").cast("string"),
        F.lit('}],"events":[{"uid":"e","name":"E'), "c_name", F.lit('","participants":["x","y"]}],"dynasties":[{"uid":"d","name":"D"}],"places":[{"uid":"l","name":"P"}],"relations":[{"source":"'), "c_name", F.lit('","target":"'), "c_mktsegment", F.lit('"}]}'))
    found = extraction(F.concat(F.lit("Sure: "), text, F.lit(" end")))
    rows = spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", found.alias("f"))
    person, event, tie = F.col("f.persons")[0], F.col("f.events")[0], F.col("f.relations")[0]
    return rows.select("c_custkey", person["original_name"].alias("name"), person["role"].alias("role"), F.array_join(person["aliases"], ",").alias("aliases"), person["birth_year"].alias("birth_year"), event["name"].alias("event"), F.array_join(event["participants"], ",").alias("participants"), F.col("f.dynasties")[0]["name"].alias("dynasty"), F.col("f.places")[0]["name"].alias("place"), F.concat(tie["source"], F.lit(">"), tie["target"]).alias("relation"))


@_query("x13_query_text", "SELECT r_regionkey, 'SELECT ' || r_name AS q FROM region", graph=False)
def _(spark, sf_dir):
    said = F.concat(F.lit("```sql\nSELECT "), "r_name", F.lit("\n```"))
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", query_text(said).alias("q"))


_LABELS = f"lab(rel_type, l) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in RELATION_LABELS.items())})"
_IF_NONE = "coalesce(nullif(CAST({} AS VARCHAR), ''), '{}')".format


@_query(
    "g8_person_prompts",
    f"""WITH {_LABELS}, near AS (SELECT src AS uid, dst AS other, rel_type, seq, '→' AS way FROM edges WHERE rel_type <> 'PARTICIPATED_IN' UNION ALL SELECT dst, src, rel_type, seq, '←' FROM edges WHERE rel_type <> 'PARTICIPATED_IN' AND src <> dst),
    ties AS (SELECT uid, string_agg('- ' || way || ' ' || l || ' ' || name, chr(10) ORDER BY r) AS ties, count(*) AS n FROM (SELECT x.uid, way, coalesce(l, x.rel_type) AS l, n.name, row_number() OVER (PARTITION BY x.uid ORDER BY x.seq, other, x.rel_type, way) AS r
        FROM near x JOIN nodes n ON n.uid = other LEFT JOIN lab ON lab.rel_type = x.rel_type) WHERE r <= 50 GROUP BY uid),
    took AS (SELECT uid, string_agg(line, chr(10) ORDER BY r) AS evs, count(*) AS n FROM (SELECT e.src AS uid, '- ' || coalesce('[' || CAST(nullif(v.year, 0) AS VARCHAR) || '] ', '') || v.name || '（' || event_type || '）：' || substr(v.description, 1, 60) AS line,
        row_number() OVER (PARTITION BY e.src ORDER BY v.year ASC NULLS LAST, v.uid) AS r FROM edges e JOIN event v ON v.uid = e.dst WHERE e.rel_type = 'PARTICIPATED_IN') WHERE r <= 30 GROUP BY uid)
    SELECT p.uid, md5(concat_ws(chr(10), 'Name: ' || original_name, 'Also called: ' || {_IF_NONE("array_to_string(aliases, '、')", "无")}, 'Role: ' || {_IF_NONE("role", "未知")}, 'Served: ' || {_IF_NONE("array_to_string(loyalty, ' → ')", "未知")},
        'Lived: ' || {_IF_NONE("birth_year", "?")} || ' — ' || {_IF_NONE("death_year", "?")}, 'Died of: ' || {_IF_NONE("death_cause", "未知")}, 'About: ' || {_IF_NONE("description", "无")},
        'Relations: ' || coalesce(t.n, 0), coalesce(ties, '无'), 'Events: ' || coalesce(k.n, 0), coalesce(evs, '无'))) AS prompt FROM person p LEFT JOIN ties t ON t.uid = p.uid LEFT JOIN took k ON k.uid = p.uid""",
)
def _(g):
    return person_prompts(g, g.person).withColumn("prompt", F.md5("prompt"))


def _stories(g):
    """Books that name events: one a person."""
    return g.person.select(F.concat(F.lit("b"), "uid").alias("name"), F.concat(F.lit("in Order "), F.col("seq").cast("string"), F.lit(" they met")).alias("text"))


_STORIES = "stories AS (SELECT 'b' || uid AS name, 'in Order ' || CAST(seq AS VARCHAR) || ' they met' AS text FROM person)"


@_query(
    "g9_event_prompts",
    f"""WITH {_STORIES}, here AS (SELECT e.dst AS uid, string_agg('- ' || original_name || '（' || p.role || '），' || e.role, chr(10) ORDER BY original_name, p.uid, e.role) AS people, count(*) AS n FROM edges e JOIN person p ON p.uid = e.src WHERE rel_type = 'PARTICIPATED_IN' GROUP BY e.dst),
    said AS (SELECT uid, string_agg('- 《' || book || '》' || text, chr(10) ORDER BY book) AS said, count(*) AS n FROM (SELECT v.uid, b.name AS book, b.text, row_number() OVER (PARTITION BY v.uid ORDER BY b.name) AS r FROM event v JOIN stories b ON contains(b.text, v.name)) WHERE r <= 2 GROUP BY uid)
    SELECT v.uid, md5(concat_ws(chr(10), 'Event: ' || v.name, 'Kind: ' || {_IF_NONE("event_type", "未知")}, 'Year: ' || {_IF_NONE("year", "未知")}, 'Place: ' || {_IF_NONE("location", "未知")}, 'Outcome: ' || {_IF_NONE("outcome", "未知")}, 'About: ' || {_IF_NONE("description", "无")},
        'Present: ' || coalesce(h.n, 0), coalesce(people, '无'), 'Passages: ' || coalesce(s.n, 0), coalesce(said, '无'))) AS prompt FROM event v LEFT JOIN here h ON h.uid = v.uid LEFT JOIN said s ON s.uid = v.uid""",
)
def _(g):
    return event_prompts(g, g.event, _stories(g)).withColumn("prompt", F.md5("prompt"))


_WORD = "regexp_extract(coalesce(text, ''), '[a-z]{6,}', 0)"


@_query(
    "g9_passages",
    f"""WITH RECURSIVE texts AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS book, text FROM documents WHERE text IS NOT NULL),
    named AS (SELECT 'w' || CAST(doc_id AS VARCHAR) AS uid, {_WORD} AS word FROM documents),
    wanted AS (SELECT uid, 0 AS keyword_no, word || '之战' AS name, word AS keyword FROM named WHERE length(word) > 0 UNION ALL SELECT uid, 1, word, word || '之战' FROM named WHERE length(word) > 0 UNION ALL SELECT uid, 0, '', '之战' FROM named WHERE length(word) = 0),
    hit(book, text, kw, pos) AS (SELECT book, text, keyword, instr(text, keyword) - 1 FROM texts, (SELECT DISTINCT keyword FROM wanted) WHERE contains(text, keyword)
        UNION ALL SELECT book, text, kw, pos + length(kw) + 200 + instr(substr(text, pos + length(kw) + 201), kw) - 1 FROM hit WHERE contains(substr(text, pos + length(kw) + 201), kw)),
    cut AS (SELECT book, kw, pos, trim(substr(text, greatest(pos - 200, 0) + 1, pos + length(kw) + 200 - greatest(pos - 200, 0)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM hit),
    own AS (SELECT uid, book, keyword_no, pos, t, row_number() OVER (PARTITION BY uid, substr(t, 1, 80) ORDER BY book, keyword_no, pos) AS same FROM cut JOIN wanted ON keyword = kw)
    SELECT uid, book, keyword_no, pos AS place, md5(t) AS text FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY book, keyword_no, pos) AS r FROM own WHERE same = 1) WHERE r <= 2""",
    graph=False,
)
def _(spark, sf_dir):
    """Passages of the documents for an event each, named by a word of it."""
    events = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("uid"), F.concat(F.expr(_WORD), F.lit("之战")).alias("name"), F.lit("").alias("description"))
    found = S.event_snippets(events, books_of(spark, sf_dir))
    return found.select("uid", "book", F.col("keyword_no").cast("int").alias("keyword_no"), F.col("at").cast("long").alias("place"), F.md5("text").alias("text"))


@_query("s10_cached_summaries", "SELECT 'p/' || CAST(seq AS VARCHAR) AS uid, CASE WHEN seq % 3 = 0 AND seq % 9 > 0 THEN 'old ' || uid ELSE 'fresh' END AS summary, seq % 3 = 0 AND seq % 9 > 0 AS from_cache FROM person")
def _(g):
    uid = F.concat(F.lit("p/"), F.col("seq").cast("string"))
    cache = g.person.where("seq % 3 = 0").select(cache_key(F.lit("person"), uid).alias("key"), F.lit("person").alias("type"), uid.alias("uid"), F.when(F.col("seq") % 9 > 0, F.concat(F.lit("old "), "uid")).otherwise("").alias("summary"))
    return summaries("person", g.person.select(uid.alias("uid"), F.col("description").alias("prompt")), cache, functools.partial(Stub, {"": "fresh"}))[0]


_VERDICTS = {"Alias3": '{"correct_aliases": ["B", "A", "B"], "wrong_aliases": ["x"]}', "Alias5": "broken {", "": 'Well: {"correct_aliases": ["z"], "wrong_aliases": []}'}


@_query("g15_alias_cleanup", """SELECT uid, CASE WHEN contains(aliases[1], 'Alias3') AND seq % 4 > 0 THEN 'A,B' ELSE array_to_string(aliases, ',') END AS aliases,
    CASE WHEN seq % 4 = 0 THEN NULL WHEN contains(aliases[1], 'Alias3') THEN 'fixed' WHEN contains(aliases[1], 'Alias5') THEN 'error' ELSE 'skipped' END AS outcome FROM person""")
def _(g):
    spark, root, client = g.person.sparkSession, _scratch(g.person.sparkSession, "aliases"), functools.partial(Stub, _VERDICTS)
    fixed = g.person.where("seq % 4 = 0").select("uid")
    person, _ = clean_aliases(g, root, client, 2, fixed)
    clean_aliases(g, root, client, 2, fixed)  # the ledger leaves nobody to judge
    ledger = spark.read.parquet(f"{root}/alias_ledger").select("uid", "outcome")
    return person.join(ledger, "uid", "left").select("uid", F.array_join("aliases", ",").alias("aliases"), "outcome")


@_query("s17_seed", """SELECT * FROM (VALUES ('Orrin Vale', 'PARTICIPATED_IN', 'Battle of Stone Ford'), ('Bram Vale', 'PARTICIPATED_IN', 'Battle of Stone Ford'), ('Tamsin Reed', 'PARTICIPATED_IN', 'Crowning at Lowmere'), ('Corin Ash', 'PARTICIPATED_IN', 'Crowning at Lowmere'),
    ('Corin Ash', 'PARTICIPATED_IN', 'Burial of Bram'), ('Orrin Vale', 'FATHER_OF', 'Ilse Vale'), ('Orrin Vale', 'ADOPTED_SON', 'Bram Vale'), ('Tamsin Reed', 'REPLACED', 'Ilse Vale'), ('Corin Ash', 'SERVED', 'Tamsin Reed'), ('Bram Vale', 'FLED_TO', 'Lowmere'),
    ('Orrin Vale', 'FOUNDED', 'Vale'), ('Tamsin Reed', 'FOUNDED', 'Marsh')) t(source_name, rel_type, target_name)""", graph=False)
def _(spark, sf_dir):
    return G.edge_list(ingest.load_seed(spark)).select("source_name", "rel_type", "target_name")


@_query("a9_ingest_counts", """WITH r AS (SELECT seq, 'Nick' || CAST(seq * 2 AS VARCHAR) IN (SELECT unnest(aliases) FROM person) AS ok FROM person)
    SELECT kind, n FROM (SELECT count(*) AS c, count_if(ok) AS k FROM r), LATERAL (VALUES ('persons', 0), ('dynasties', 0), ('events', c), ('places', 0), ('relations_ok', k), ('relations_failed', c - k), ('participants', 2 * c), ('participants_ok', c), ('failed_chunks', 1)) t(kind, n)""")
def _(g):
    said = F.concat(F.lit('{"persons":[],"dynasties":[],"places":[],"events":[{"uid":"x'), F.col("seq").cast("string"), F.lit('","name":"n","participants":["'), "original_name", F.lit('","nobody"]}],"relations":[{"source":"'), "original_name", F.lit('","target":"Nick'), (F.col("seq") * 2).cast("string"), F.lit('","relation_type":"x"}]}'))
    rows = g.person.select("seq", F.from_json(said, EXTRACTION).alias("result"))
    return ingest.result_counts(g, rows.union(rows.limit(1).select("seq", F.lit(None).cast(EXTRACTION))))


@_query("r3_extraction_prompts", """WITH k AS (SELECT string_agg('- ' || original_name || ' (' || array_to_string(aliases, '、') || ')', chr(10) ORDER BY original_name, uid) AS t FROM (SELECT * FROM person ORDER BY original_name, uid LIMIT 200))
    SELECT d.uid AS chunk_id, md5('List the persons, dynasties, events, places and relations of this text as JSON.' || chr(10) || 'Known persons; use these names for them and for their aliases:' || chr(10) || t || chr(10) || 'Chapter: ' || name || chr(10) || d.description) AS prompt FROM event d, k""")
def _(g):
    chunks = g.event.select(F.col("uid").alias("chunk_id"), F.col("name").alias("chapter"), F.col("description").alias("content"))
    return ingest.extraction_prompts(chunks, ingest.known_text(g)).select("chunk_id", F.md5("prompt").alias("prompt"))


@_query("p4_node_properties", """SELECT uid, 'Person' AS label, original_name AS name, CAST(birth_year AS VARCHAR) AS year, 7 + CAST(death_year IS NOT NULL AS INT) + CAST(death_cause IS NOT NULL AS INT) AS n_properties FROM person
    UNION ALL SELECT uid, 'Dynasty', name, CAST(start_year AS VARCHAR), 5 FROM dynasty UNION ALL SELECT uid, 'Place', name, NULL, 3 FROM place UNION ALL SELECT uid, 'Event', name, CAST(year AS VARCHAR), 5 + CAST(year IS NOT NULL AS INT) FROM event""")
def _(g):
    get = lambda *names: F.coalesce(*[F.get_json_object("props", f"$.{n}") for n in names])
    return g.node_properties().select("uid", "label", get("original_name", "name").alias("name"), get("birth_year", "start_year", "year").alias("year"), F.size(F.json_object_keys("props")).alias("n_properties"))


@_query("g6_person_detail", f"""SELECT 'person' AS part, uid, original_name AS name FROM person WHERE uid = '{P}' UNION ALL SELECT 'events', v.uid, v.name FROM edges e JOIN event v ON v.uid = e.dst WHERE e.src = '{P}' AND rel_type = 'PARTICIPATED_IN'
    UNION ALL SELECT 'relations', o, n.name FROM (SELECT CASE WHEN src = '{P}' THEN dst ELSE src END AS o FROM edges WHERE (src = '{P}' OR dst = '{P}') AND rel_type <> 'PARTICIPATED_IN') x JOIN nodes n ON n.uid = o""")
def _(g):
    found = qa.person_detail(g, P)
    names = {"person": ("uid", "original_name"), "events": ("uid", "name"), "relations": ("other_uid", "other_name")}
    parts = [found[k].select(F.lit(k).alias("part"), F.col(a).alias("uid"), F.col(b).alias("name")) for k, (a, b) in names.items()]
    return parts[0].union(parts[1]).union(parts[2])


@_query("g7_event_detail", f"""WITH {_STORIES} SELECT 'event' AS part, uid, name FROM event WHERE uid = '{E}' UNION ALL SELECT 'participants', p.uid, p.original_name FROM edges e JOIN person p ON p.uid = e.src WHERE e.dst = '{E}' AND rel_type = 'PARTICIPATED_IN'
    UNION ALL SELECT * FROM (SELECT 'snippets', name, text FROM stories WHERE contains(text, 'Order 7') ORDER BY name LIMIT 3)""")
def _(g):
    found = qa.event_detail(g, E, _stories(g))
    names = {"event": ("uid", "name"), "participants": ("uid", "name"), "snippets": ("book", "text")}
    parts = [found[k].select(F.lit(k).alias("part"), F.col(a).alias("uid"), F.col(b).alias("name")) for k, (a, b) in names.items()]
    return parts[0].union(parts[1]).union(parts[2])


@_query(
    "g16_repair_events",
    f"""WITH {_DEAD}, {_NAMES}, kept AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE NOT memorial AND d.src = e.src AND d.dst = e.dst AND e.rel_type = 'PARTICIPATED_IN')),
    links AS (SELECT x.id, n.uid FROM (SELECT uid AS id, unnest(participants) AS name FROM event) x JOIN names n USING (name) UNION SELECT v.uid, n.uid FROM event v JOIN (SELECT * FROM names WHERE length(name) >= 2) n ON contains(concat_ws(' ', v.description, v.name), n.name))
    SELECT DISTINCT src, rel_type, dst FROM kept WHERE src <> dst UNION SELECT l.uid, 'PARTICIPATED_IN', l.id FROM links l JOIN person p ON p.uid = l.uid JOIN event v ON v.uid = l.id WHERE coalesce(v.year <= p.death_year, true) OR {_MEMORIAL.format(d='v.description', n='v.name')}""",
)
def _(g):
    return R.repair_events(g, 10**12).edges.select("src", "rel_type", "dst")
