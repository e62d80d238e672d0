"""Ingestion: chunks to extractions to graph, as a batch step and as a stream that resumes where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parse import extraction
from ..operators.asof import at_the_end, person_history, resolve_at, stored_history, upsert_history
from ..operators.graph import KEYS, Graph, known_persons, load, resolve_participants, save_changes
from ..operators.merge import fold_persons
from ..operators.order import in_order
from ..operators.write import founder_edges, participation_rows, relation_rows, relations_to_edges, upsert_edges, upsert_nodes
from ..sources.files import CHUNK, RESULT, checkpoint_dir, read_or
from ..sources.models import Client, ask
from ..sources.seed import seed_result

NODE_COLUMNS = {
    "dynasty": ("dynasties", ["name", "description"], ["founder", "capital", "start_year", "end_year"]),
    "event": ("events", ["name", "event_type", "participants", "description"], ["year", "location", "outcome"]),
    "place": ("places", ["name", "description"], ["modern_name"]),
}
#: Kinds of items in the order in which a chunk's are written, and arrival numbers that a chunk has for each.
KINDS = ("dynasties", "places", "persons", "events", "relations")
ITEMS = 1_000_000
EMPTY = {
    "person": "uid string, original_name string, aliases array<string>, role string, loyalty array<string>, birth_year int, death_year int, death_cause string, description string, seq long",
    "dynasty": "uid string, name string, founder string, capital string, start_year int, end_year int, description string, seq long",
    "event": "uid string, name string, event_type string, year int, location string, participants array<string>, outcome string, description string, seq long",
    "place": "uid string, name string, modern_name string, description string, seq long",
    "edges": "src string, rel_type string, dst string, year int, description string, role string, seq long",
}


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(*[spark.createDataFrame([], EMPTY[k]) for k in ("person", "dynasty", "event", "place", "edges")])


def known_text(graph: Graph, limit: int = 200) -> str:
    """The first persons by name, with their aliases, one a line: what extraction aligns names with. Only these rows reach the driver."""
    rows = known_persons(graph, limit).collect()
    return "\n".join(f"- {r.name}" + (f" ({'、'.join(r.aliases)})" if r.aliases else "") for r in rows)


def extraction_prompts(chunks: DataFrame, known: str = "") -> DataFrame:
    """Adds prompt to chunks (chapter, content)."""
    task = "List the persons, dynasties, events, places and relations of this text as JSON."
    align = f"Known persons; use these names for them and for their aliases:\n{known}\n" if known else ""
    return chunks.withColumn("prompt", F.concat(F.lit(f"{task}\n{align}Chapter: "), F.coalesce("chapter", F.lit("")), F.lit("\n"), "content"))


def extract(chunks: DataFrame, client: Callable[[], Client], pause: float = 0.0, known: str = "") -> DataFrame:
    """chunk_id and the parsed result of each chunk; the result is null where the call or its JSON failed."""
    out = ask(extraction_prompts(chunks, known), client, system="You answer with JSON only.", pause=pause)
    found = extraction(F.col("output"))
    return out.select("chunk_id", F.when(found.isNotNull(), found.withField("source_text", F.substring("content", 1, 500)).withField("source_chapter", F.col("chapter"))).alias("result"))


def result_counts(graph: Graph, results: DataFrame) -> DataFrame:
    """(kind, n): what results (seq, result) hold, and how many relations and participants find both their ends in the graph written from them."""
    rows = results.where("result IS NOT NULL")
    listed = lambda field: rows.select(F.explode(f"result.{field}").alias("n")).select("n.*")
    relations = listed("relations").withColumn("seq", F.lit(0).cast("long"))
    edges, lost = relations_to_edges(graph, relations)
    links = listed("events").where("uid IS NOT NULL").select(F.col("uid").alias("event_uid"), F.explode("participants").alias("name")).distinct()
    ends = edges.select(F.lit(1).alias("ok")).union(lost.select(F.lit(0)))
    return _counts(results, ends, links.select(F.lit(0).alias("ok")).union(resolve_participants(graph, links).select(F.lit(1))), True)


def _counts(results: DataFrame, relations: DataFrame, participants: DataFrame, apart: bool = False) -> DataFrame:
    """One pass over each: what the results hold; relations and participants have ok (1 or 0). With ``apart`` a participant that was found has a row of each kind."""
    fields = ["persons", "dynasties", "events", "places"]
    size = lambda f: F.coalesce(F.sum(F.size(F.coalesce(f"result.{f}", F.expr(f"array()").cast(results.schema["result"].dataType[f].dataType)))), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    pairs = lambda df, **kinds: df.agg(*[c.alias(k) for k, c in kinds.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("e")).select("e.*")
    held = pairs(results, **{f: size(f) for f in fields}, failed_chunks=F.count_if(F.col("result").isNull()))
    ends = pairs(relations, relations_ok=total("ok"), relations_failed=total(1 - F.col("ok")))
    return held.union(ends).union(pairs(participants, participants=total(1 - F.col("ok")) if apart else F.count("*"), participants_ok=total("ok")))


@dataclass(frozen=True)
class Written:
    """A graph with results in it, and those of its nodes and edges alone that the results touch; relations and participants of the results, with the uids that their names stood for (null: nobody)."""

    graph: Graph
    changed: Graph
    relations: DataFrame
    participants: DataFrame

    def counts(self, results: DataFrame) -> DataFrame:
        """(kind, n), as result_counts()."""
        ok = (F.col("src").isNotNull() & F.col("dst").isNotNull()).cast("int")
        links = self.participants.groupBy("event_uid", "name").agg(F.max(F.col("uid").isNotNull().cast("int")).alias("ok"))
        return _counts(results, self.relations.select(ok.alias("ok")), links)


def load_seed(spark: SparkSession, graph: Graph | None = None) -> Graph:
    """The seed rows written to a graph (an empty one by default): nodes, participants and relations, then the founders of dynasties."""
    out = apply_results(empty_graph(spark) if graph is None else graph, seed_result(spark))
    return out.with_edges(upsert_edges(out.edges, founder_edges(out, last_seq(out) + 1).select(*out.edges.columns)))


def last_seq(graph: Graph) -> int:
    """The highest number that a node or an edge of the graph has; 0 for an empty graph."""
    parts = [df.agg(F.max("seq").alias("seq")) for _, df in graph.labelled()] + [graph.edges.agg(F.max("seq").alias("seq"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.agg(F.max("seq")).first()[0] or 0


def write_results(graph: Graph, results: DataFrame, names: str = "as_of") -> Written:
    """Results (seq, result) written to a graph.

    Chunks arrive in the order of seq, after all that the graph holds: whatever numbers chunks have, arrivals go on above the graph's highest number, so books and runs
    may number theirs alike. Within a chunk come dynasties, places, persons, events and relations. Names of relations and participants stand for who bore them
    when their chunk had come in ("as_of"), as if chunks were written one by one, or for who bears them in the end ("final"). Unresolved ones are dropped.
    """
    if names not in ("as_of", "final"):
        raise ValueError("names is as_of or final")
    checkpoint_dir(results.sparkSession)
    rows = in_order(results.where("result IS NOT NULL").select("seq", "result"), ["seq"], "chunk")
    first = F.lit(last_seq(graph) + 1).cast("long") + F.col("chunk") * (ITEMS * len(KINDS))
    item = lambda field: rows.select(first.alias("__f"), F.posexplode(f"result.{field}").alias("__p", "n")).select("n.*", (F.col("__f") + F.lit(KINDS.index(field) * ITEMS) + F.col("__p")).alias("seq"), (F.col("__f") + F.lit(len(KINDS) * ITEMS - 1)).alias("at"))
    listed = {"aliases": F.array().cast("array<string>"), "loyalty": F.array().cast("array<string>"), "participants": F.array().cast("array<string>")}
    fill = lambda df: df.withColumns({c: F.coalesce(c, v) for c, v in listed.items() if c in df.columns}).where("uid IS NOT NULL")
    touched = lambda old, new, name: old.join(new.select(*KEYS[name]).distinct(), KEYS[name], "left_semi").select(*old.columns)
    nodes, changed, history = {}, {}, {}
    for name, (field, required, optional) in NODE_COLUMNS.items():
        old, new = getattr(graph, name), fill(item(field))
        nodes[name] = upsert_nodes(old, new.select(*old.columns), required, optional)
        changed[name] = upsert_nodes(touched(old, new, name), new.select(*old.columns), required, optional)
        history[name] = upsert_history(old, new, name.title())
    persons = fill(item("persons")).withColumns({"role": F.coalesce("role", F.lit("其他")), "description": F.coalesce("description", F.lit(""))})
    folded = fold_persons(persons.select(*graph.person.columns), graph.person).checkpoint()
    rest = graph.person.join(folded.select("uid"), "uid", "left_anti").select(*graph.person.columns)
    out = Graph(rest.unionByName(folded.select(*graph.person.columns)), nodes["dynasty"], nodes["event"], nodes["place"], graph.edges)
    bearers = person_history(folded).union(stored_history(replace(graph, person=rest).name_index().where("label = 'Person'")))
    anyone = bearers.union(history["dynasty"]).union(history["event"]).union(history["place"])
    if names == "final":
        bearers, anyone = at_the_end(bearers), at_the_end(anyone)
    links = fill(item("events")).select(F.col("uid").alias("event_uid"), F.explode("participants").alias("name"), "at", "seq")
    found = links.join(resolve_at(bearers, links).select("name", "at", F.col("uid").alias("__by_name")), ["name", "at"], "left")
    uids = out.person.select(F.col("uid").alias("__uid"), F.col("seq").alias("__created"))
    found = found.join(uids, (F.col("name") == F.col("__uid")) & ((F.col("__created") <= F.col("at")) | F.lit(names == "final")), "left")
    participants = found.select("event_uid", "name", F.coalesce("__by_name", "__uid").alias("uid"), "seq").checkpoint()
    said = item("relations")
    ends = resolve_at(anyone, said.select(F.col("source").alias("name"), "at").union(said.select("target", "at"))).select("name", "at", "uid")
    a, b = ends.toDF("source", "at", "src"), ends.toDF("target", "at", "dst")
    relations = said.join(a, ["source", "at"], "left").join(b, ["target", "at"], "left").drop("at").checkpoint()
    links = participation_rows(participants.where("uid IS NOT NULL"))
    edges = relation_rows(relations.where("src IS NOT NULL AND dst IS NOT NULL"))
    # one arrival an edge row: participants of one chunk come before its relations
    new = links.select(*graph.edges.columns).union(edges.select(*graph.edges.columns))
    changed = Graph(folded.select(*graph.person.columns), **changed, edges=upsert_edges(touched(graph.edges, new, "edges"), new))
    return Written(out.with_edges(upsert_edges(graph.edges, new)), changed, relations, participants)


def apply_results(graph: Graph, results: DataFrame, names: str = "as_of") -> Graph:
    """The graph of write_results()."""
    return write_results(graph, results, names).graph


def ingest_batch(spark: SparkSession, chunks: DataFrame, root: str, client: Callable[[], Client]) -> None:
    """Extracts chunks, and writes results, the nodes and edges that they change as a new version of the graph, and the ledger below root. Failed chunks count as done."""
    version = uuid.uuid4().hex
    last = current_version(spark, root)
    graph = load(spark, f"{root}/graph/{last}") if last else empty_graph(spark)
    found = extract(chunks, client, known=known_text(graph))
    found.write.parquet(f"{root}/results/{version}")
    found = spark.read.parquet(f"{root}/results/{version}").withColumn("seq", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long"))
    written = write_results(graph, found)
    save_changes(written.changed, f"{root}/graph", version, last)
    written.counts(found).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{root}/counts")
    found.select("chunk_id", F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/ledger")


def current_version(spark: SparkSession, root: str) -> str | None:
    ledger = read_or(spark, f"{root}/ledger", "chunk_id string, version string, at timestamp")
    newest = ledger.agg(F.max_by("version", "at").alias("v")).first()
    return newest["v"]


def ingest_stream(spark: SparkSession, chunks_dir: str, root: str, client: Callable[[], Client], files_per_batch: int = 1) -> StreamingQuery:
    """Follows a folder of chunk files (JSON lines): what is there is ingested and the stream ends; a restart goes on from its checkpoint.
    Chunks in the ledger are left out, so a batch that is run again writes nothing twice."""
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).json(chunks_dir)

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        done = read_or(session, f"{root}/ledger", "chunk_id string, version string, at timestamp")
        new = rows.join(done.select("chunk_id"), "chunk_id", "left_anti")
        if not new.isEmpty():
            ingest_batch(session, new, root, client)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results (files of RESULT objects) as rows for apply_results."""
    from ..sources.files import read_results

    rows = read_results(spark, path)
    names = [f.split(":")[0] for f in ("persons:", "dynasties:", "events:", "places:", "relations:", "source_text:", "source_chapter:")]
    assert all(n in RESULT for n in names)
    held = rows.select("_metadata.file_path", F.monotonically_increasing_id().alias("__id"), F.struct(*names).alias("result"))
    return in_order(held, ["file_path", "__id"], "seq").select("seq", "result")
