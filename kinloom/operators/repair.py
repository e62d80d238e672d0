"""Data-quality repair as set operations: corrections, temporal pruning, missing links, reports."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any
from ..functions.values import DEFAULT_EDGE_ROLE, MEMORIAL_KEYWORDS, PARTICIPATED
from ..sources.files import checkpoint_dir
from .automaton import SMALL, automaton, places, small
from .graph import Graph
from .order import spread
from .write import upsert_edges, without, without_parallels, without_self_loops


#: Bits of a table of marks.
MARKS = 1 << 26


def _memorial(description: Column, name: Column) -> Column:
    return contains_any(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(name, F.lit(""))), MEMORIAL_KEYWORDS)


def post_death_links(graph: Graph) -> DataFrame:
    """Participation in events after the person's death, with whether the event is a memorial. One equi-join a side."""
    dead = graph.person.where(F.nullif("death_year", F.lit(0)).isNotNull()).select(F.col("uid").alias("src"), F.col("original_name").alias("person_name"), "death_year")
    events = graph.event.where("year IS NOT NULL").select(F.col("uid").alias("dst"), F.col("name").alias("event_name"), F.col("year").alias("event_year"), F.col("description").alias("event_description"))
    links = graph.edges.where(F.col("rel_type") == PARTICIPATED).select("src", "rel_type", "dst")
    # by merging: tables that grow with the graph are not broadcast, however small Spark takes them for
    out = links.join(dead.hint("merge"), "src").join(events.hint("merge"), "dst").where("event_year > death_year")
    return out.withColumn("memorial", _memorial(F.col("event_description"), F.col("event_name"))).drop("event_description")


def prune_post_death(graph: Graph) -> DataFrame:
    """Edges without participation after death; memorials stay."""
    return without(graph.edges, post_death_links(graph).where("NOT memorial"))


def name_map(graph: Graph) -> DataFrame:
    """(name, uid): the last person of a name by seq; else the first person with the alias, of two characters or more."""
    primary = graph.person.where("original_name IS NOT NULL").groupBy(F.col("original_name").alias("name")).agg(F.max_by("uid", "seq").alias("p"))
    aliases = graph.person.select(F.explode("aliases").alias("name"), "uid", "seq").where(F.length("name") > 1)
    alias = aliases.groupBy("name").agg(F.min_by("uid", "seq").alias("a"))
    return primary.join(alias, "name", "full").select("name", F.coalesce("p", "a").alias("uid"))


def mentions(texts: DataFrame, names: DataFrame, shortest: int = 2, bound: int = SMALL) -> DataFrame:
    """(id, uid) where a text contains a name of ``shortest`` characters or more. texts: (id, text); names: (name, uid). Null texts and names find nothing."""
    named = names.where((F.length("name") >= shortest) & F.col("uid").isNotNull()).select("name", "uid").distinct()
    return words_in(texts, named.select("name").distinct(), bound).join(named.hint("merge"), "name").select("id", "uid").distinct()


def words_in(texts: DataFrame, words: DataFrame, bound: int = SMALL) -> DataFrame:
    """(id, name): the words, a column name, that a text contains, each once, and perhaps some that are not among the words; those go when the words are joined.

    Words whose characters number up to ``bound`` go to all tasks, and each text is read once by their automaton; of more, runs() finds them.
    """
    held = small(words, bound)
    if held is None:
        return runs(texts, words)
    shared = texts.sparkSession.sparkContext.broadcast([word for (word,) in held])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = automaton(shared.value)
        for batch in batches:
            found = [sorted({word for word, _ in places(look, text)}) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.string()))], names=["id", "names"])

    schema = T.StructType([texts.schema["id"], T.StructField("names", T.ArrayType(T.StringType()))])
    return texts.select("id", "text").mapInArrow(find, schema).select("id", F.explode("names").alias("name"))


def by_grams(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(id, uid) where a text contains a name, for any number of distinct (name, uid)."""
    return runs(texts, named.select("name")).join(named.hint("merge"), "name").select("id", "uid")


def runs(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, name): of each text the distinct runs of characters that may be one of any number of words, a column name; all that are words are among them.

    A run is sent if it is as long as some word that begins with the same q characters, q being the shortest word's length, and shares a mark with a word. So a text
    sends the words that it contains and few others, however many words have parts in common with it; an equi-join with the words tells.
    The lengths of words and the marks, two tables of fixed size, reach the driver and all tasks. Joins are by merging: Spark takes a text's runs for one row and would broadcast them.
    """
    checkpoint_dir(texts.sparkSession)
    words = words.where("name IS NOT NULL").checkpoint()
    lengths = sorted(row.n for row in words.select(F.length("name").alias("n")).distinct().collect())
    if not lengths:
        return texts.select("id", F.lit(None).cast("string").alias("name")).where("false")
    start = F.substring("name", 1, lengths[0])
    starts = words.select(F.explode(F.array(start, F.concat(F.length("name").cast("string"), F.lit(" "), start))).alias("name"))
    return _runs_in(spread(texts.select("id", "text")), lengths, _marks(starts), _marks(words))


def _marks(words: DataFrame) -> dict[int, bytes]:
    """A bit for the CRC of each word, in pieces of 32,768 bits."""
    mark = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(MARKS)) + 1
    pieces = words.select(mark.alias("m")).groupBy(F.bitmap_bucket_number("m").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    return {row.k - 1: bytes(row.bits) for row in pieces.collect()}


def _marked(bits: dict[int, bytes], word: str) -> bool:
    piece, at = divmod(zlib.crc32(word.encode()) % MARKS, 32_768)
    return piece in bits and bits[piece][at >> 3] >> (at & 7) & 1 == 1


def _runs_in(texts: DataFrame, lengths: list[int], starts: dict[int, bytes], marks: dict[int, bytes]) -> DataFrame:
    """(id, name): each text's distinct marked runs of one of the lengths that their start, of the least length, is marked with."""
    shared = texts.sparkSession.sparkContext.broadcast((starts, marks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, marks), q = shared.value, lengths[0]
        known: dict[str, list[int]] = {}

        def sizes_of(start: str) -> list[int]:
            if len(known) == 500_000:
                known.clear()
            known[start] = found = [n for n in lengths if _marked(starts, f"{n} {start}")] if _marked(starts, start) else []
            return found

        for batch in batches:
            def found_in(places: list[int], names: list[str], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(places, pa.int32())), pa.array(names, pa.string())], names=["id", "name"])

            places, names = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text is None:
                    continue
                found = set()
                for i in range(len(text) - q + 1):
                    start = text[i : i + q]
                    if (sizes := known.get(start)) is None:
                        sizes = sizes_of(start)
                    for n in sizes:
                        if i + n <= len(text):
                            found.add(text[i : i + n])
                for run in found:
                    if _marked(marks, run):
                        places.append(k)
                        names.append(run)
                if len(names) > 200_000:
                    yield found_in(places, names)
                    places, names = [], []
            yield found_in(places, names)

    return texts.mapInArrow(cut, T.StructType([texts.schema["id"], T.StructField("name", T.StringType())]))


def missing_links(graph: Graph) -> DataFrame:
    """(src, dst) participations that an event's participants or text imply and the graph lacks; none after death, but memorials."""
    # years of death go with the names, which are fewer than the links
    deaths = graph.person.groupBy("uid").agg(F.collect_list(F.struct(F.nullif("death_year", F.lit(0)).alias("death"))).alias("deaths"))
    names = name_map(graph).where("name IS NOT NULL").join(deaths.hint("merge"), "uid")
    text = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("name", F.lit("")))
    listed = graph.event.select(F.col("uid").alias("id"), F.explode("participants").alias("name"))
    found = words_in(graph.event.select(F.col("uid").alias("id"), text.alias("text")), names.where(F.length("name") >= 2).select("name"))
    # dealt by event once, for telling links apart and for their events
    links = listed.union(found).join(names.hint("merge"), "name").select("id", "uid", "deaths").repartition("id").distinct()
    events = graph.event.select(F.col("uid").alias("id"), F.nullif("year", F.lit(0)).alias("year"), _memorial(F.col("description"), F.col("name")).alias("memorial"))
    dated = links.join(events.hint("merge"), "id").select("uid", "id", "year", "memorial", F.explode("deaths.death").alias("death"))
    alive = dated.where(F.coalesce(F.col("year") <= F.col("death"), F.lit(True)) | F.col("memorial")).select("uid", "id")
    have = graph.edges.where(F.col("rel_type") == PARTICIPATED).select(F.col("src").alias("uid"), F.col("dst").alias("id"))
    return alive.join(have.hint("merge"), ["uid", "id"], "left_anti").select(F.col("uid").alias("src"), F.col("id").alias("dst"))


def repair_events(graph: Graph, seq: int) -> Graph:
    """Pruning, missing links, self-loops and parallel edges, in this order."""
    pruned = graph.with_edges(prune_post_death(graph))
    new = missing_links(pruned).select("src", F.lit(PARTICIPATED).alias("rel_type"), "dst", F.lit(None).cast("int").alias("year"), F.lit("").alias("description"), F.lit(DEFAULT_EDGE_ROLE).alias("role"), F.lit(seq).cast("long").alias("seq"))
    edges = upsert_edges(without_parallels(without_self_loops(pruned.edges)), new.select(*pruned.edges.columns))
    return graph.with_edges(without_self_loops(edges))


def correct_known(graph: Graph, known: DataFrame) -> tuple[Graph, DataFrame]:
    """Corrects persons by a checked table (uid, original_name, correct_aliases, role, birth_year, death_year, death_cause,
    loyalty, description); also returns (uid, name, removed) of those that needed it."""
    fix = known.select("uid", *[F.col(c).alias(f"__{c}") for c in known.columns if c != "uid"])
    joined = graph.person.join(fix, "uid", "left")
    wrong = F.array_except(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("__correct_aliases", F.array().cast("array<string>")))
    needs = F.col("__original_name").isNotNull() & ((F.size(wrong) > 0) | (F.col("original_name") != F.col("__original_name")))
    fixed = {"original_name": F.col("__original_name"), "aliases": F.array_sort("__correct_aliases"), "role": F.col("__role"), "description": F.col("__description"), "loyalty": F.col("__loyalty")}
    fixed |= {c: F.coalesce(f"__{c}", c) for c in ("birth_year", "death_year", "death_cause")}
    joined = joined.withColumns({"__needs": needs, "__wrong": wrong})
    person = joined.select(*[F.when(F.col("__needs"), fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in graph.person.columns])
    return replace(graph, person=person), joined.where("__needs").select("uid", F.col("original_name").alias("name"), F.col("__wrong").alias("removed"))


def apply_alias_verdicts(person: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sets aliases from verdicts (uid, correct_aliases, wrong_aliases) that name wrong ones."""
    good = verdicts.where(F.size("wrong_aliases") > 0).select("uid", F.array_sort(F.array_distinct("correct_aliases")).alias("__a"))
    return person.join(good, "uid", "left").withColumn("aliases", F.coalesce("__a", "aliases")).select(*person.columns)


def alias_suspects(graph: Graph, at_least: int = 2, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Persons with that many aliases, most first; without those in done (uid)."""
    out = graph.person.where(F.size("aliases") >= at_least).select("uid", F.col("original_name").alias("name"), F.size("aliases").alias("n_aliases"))
    out = out if done is None else out.join(done.select("uid"), "uid", "left_anti")
    out = out.orderBy(F.desc("n_aliases"), "uid")
    return out if limit is None else out.limit(limit)


def post_death_report(graph: Graph, over: int = 3, limit: int | None = 15) -> DataFrame:
    """Persons with more than ``over`` events after death."""
    out = post_death_links(graph).groupBy(F.col("src").alias("uid"), F.col("person_name").alias("name")).agg(F.count("*").alias("n_post_death")).where(F.col("n_post_death") > over)
    out = out.orderBy(F.desc("n_post_death"), "uid")
    return out if limit is None else out.limit(limit)


def event_counts(graph: Graph, persons: DataFrame) -> DataFrame:
    """Events of each listed person (uid); no row where there are none."""
    links = graph.edges.where(F.col("rel_type") == PARTICIPATED).select(F.col("src").alias("uid"), F.col("dst").alias("event"))
    return links.join(persons.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.count("*").alias("n_events"))


def parallel_groups(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "rel_type", "dst").agg(F.count("*").alias("n")).where("n > 1")
