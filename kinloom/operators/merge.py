"""Entity resolution: persons that share a specific name become one node, in order of arrival.

The outcome depends on order, but only among records that share names or uids, directly, through other records or through a stored node. So those
connected groups are found by joins on names, and each is folded in order by itself. A group's records stream through one task, sorted by
Spark; the task holds the group's nodes and a name index, not its records, so groups of any number of records are folded.

Stored nodes are never records: they enter a group as they are, are matched by records, and are never merged with each other. Only those that bear a name or uid of the batch
enter one, so a batch costs what it touches, besides one scan of the names.

Defined cases: a person without specific names matches nobody. Of several matches the node created first is taken; an exact name comes
before an alias. A merge that would leave more than 25 aliases is not made. Records are told apart by a number of their own, so equal seq (and even equal rows) are
records like others; they arrive in no set order among themselves.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_names, specific_names
from ..functions.values import AMBIGUOUS_TITLES, OTHER_ROLE
from ..sources.files import checkpoint_dir

MAX_ALIASES = 25
PERSON_SCHEMA = "uid string, original_name string, aliases array<string>, role string, loyalty array<string>, birth_year int, death_year int, death_cause string, description string, seq long"
PERSON_COLUMNS = [x.split()[0] for x in PERSON_SCHEMA.split(", ")]
#: Names that a node had, with the arrival that gave it (null: it was stored with it) and the one that took it away (null: none).
NAMES = "array<struct<name:string,since:bigint,until:bigint>>"
_LIST = pa.list_(pa.string())
_FOLDED = pa.schema([("uid", pa.string()), ("original_name", pa.string()), ("aliases", _LIST), ("role", pa.string()), ("loyalty", _LIST), ("birth_year", pa.int32()), ("death_year", pa.int32()), ("death_cause", pa.string()), ("description", pa.string()), ("seq", pa.int64()),
    ("names", pa.list_(pa.struct([("name", pa.string()), ("since", pa.int64()), ("until", pa.int64())])))])
#: So many nodes leave a task at a time; most groups have a few.
_AT_ONCE = 5_000
_AMBIGUOUS = frozenset(AMBIGUOUS_TITLES)


def connected(pairs: DataFrame) -> DataFrame:
    """(node, group) for the rows (node, key): nodes that share a key, or are joined through others, get one group. Nodes that share no key have no row.

    Keys of one node are left out first. Smallest labels go from nodes to keys and back until nothing changes; each round is cut by checkpoint() in the session's
    checkpoint folder. A hot key is a partial minimum and a join, never pairs. Joins are by merging: keys grow with the rows, and Spark may take checkpointed or exploded ones for few.
    """
    spark = pairs.sparkSession
    checkpoint_dir(spark)
    pairs = pairs.distinct()
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    pairs = pairs.join(shared.hint("merge"), "key", "left_semi").select("node", "key").checkpoint()
    labels = pairs.select("node").distinct().withColumn("group", F.col("node")).checkpoint()
    while True:
        least = pairs.join(labels.hint("merge"), "node").groupBy("key").agg(F.min("group").alias("g"))
        moved = pairs.join(least.hint("merge"), "key").groupBy("node").agg(F.min("g").alias("g"))
        following = labels.join(moved.hint("merge"), "node").select("node", F.least("group", "g").alias("group"), (F.col("g") < F.col("group")).alias("changed"))
        # a node also takes the label of the node that its label names
        jump = following.select(F.col("node").alias("group"), F.col("group").alias("up"))
        following = following.join(jump.hint("merge"), "group", "left").select("node", F.least("group", F.coalesce("up", "group")).alias("group"), "changed").checkpoint()
        labels = following.drop("changed")
        if following.where("changed").isEmpty():
            return labels


class _Fold:
    """Nodes of one group, in order of creation."""

    def __init__(self) -> None:
        self.nodes: dict[str, dict] = {}
        self.order: dict[str, int] = {}
        #: By name, a heap of (order, uid); entries that no longer hold are dropped when they come up.
        self.named: dict[str, list] = {}
        self.aliased: dict[str, list] = {}
        #: By uid, the arrival that gave each present name, and past names with both arrivals.
        self.since: dict[str, dict[str, int | None]] = {}
        self.past: dict[str, list[tuple]] = {}

    def _note(self, uid: str, at: int | None) -> None:
        """Names after a change at an arrival."""
        node, known = self.nodes[uid], self.since.setdefault(uid, {})
        names = {n for n in (node["original_name"], *node["aliases"]) if n}
        for name in known.keys() - names:
            self.past.setdefault(uid, []).append((name, known.pop(name), at))
        for name in names - known.keys():
            known[name] = at

    def load(self, p: dict) -> None:
        """A stored node, as it is; they come in order of creation, before all records."""
        self._upsert(p)
        self._note(p["uid"], None)

    def names_of(self, uid: str) -> list[dict]:
        rows = [(n, a, None) for n, a in self.since[uid].items()] + self.past.get(uid, [])
        return [dict(zip(("name", "since", "until"), r, strict=True)) for r in rows]

    def rows(self) -> Iterator[dict]:
        return (node | {"names": self.names_of(uid)} for uid, node in self.nodes.items())

    def _index(self, uid: str, index: dict[str, list], names: set[str]) -> None:
        for name in names:
            if name:
                heapq.heappush(index.setdefault(name, []), (self.order[uid], uid))

    def _match(self, names: set[str]) -> dict | None:
        for index, field in ((self.named, "original_name"), (self.aliased, "aliases")):
            found = []
            for name in names:
                heap = index.get(name, [])
                while heap and not (name == self.nodes[heap[0][1]][field] if field == "original_name" else name in self.nodes[heap[0][1]][field]):
                    heapq.heappop(heap)
                found += heap[:1]
            if found:
                return self.nodes[min(found)[1]]
        return None

    def _upsert(self, p: dict) -> None:
        held = self.nodes.get(p["uid"])
        self.order.setdefault(p["uid"], len(self.order))
        self._index(p["uid"], self.named, {p["original_name"]} - ({held["original_name"]} if held else set()))
        self._index(p["uid"], self.aliased, set(p["aliases"]).difference(held["aliases"] if held else ()))
        if held is None:
            self.nodes[p["uid"]] = p
            return
        for k in ("original_name", "aliases", "role", "loyalty", "description"):
            held[k] = p[k]
        for k in ("birth_year", "death_year", "death_cause"):
            held[k] = held[k] if p[k] is None else p[k]

    def add(self, p: dict) -> None:
        names = {n for n in (p["original_name"], *p["aliases"]) if n}
        specific = {n for n in names if len(n) > 1 and n not in _AMBIGUOUS}
        held = self._match(specific) if specific else None
        merged = held and sorted(({*held["aliases"], *names}) - {held["original_name"], ""})
        if held is None or len(merged) > MAX_ALIASES:
            self._upsert(p)
            self._note(p["uid"], p["seq"])
            return
        self._index(held["uid"], self.aliased, set(merged).difference(held["aliases"]))
        held["aliases"] = merged
        held["loyalty"] = list(dict.fromkeys([*held["loyalty"], *p["loyalty"]]))
        held["description"] = max(held["description"] or "", p["description"] or "", key=len)  # the first of two as long
        for k in ("birth_year", "death_year", "death_cause"):
            if p[k] and not held[k]:
                held[k] = p[k]
        if p["role"] not in (None, "", OTHER_ROLE) and held["role"] in (None, "", OTHER_ROLE):
            held["role"] = p["role"]
        self._note(held["uid"], p["seq"])


def fold_persons(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What the records (PERSON_SCHEMA; seq is the order of arrival) make of the stored nodes: new nodes and the stored ones that share a name or uid with a record, as they
    are afterwards, with names (NAMES), their history in this batch. Other stored nodes have no row."""
    checkpoint_dir(records.sparkSession)
    # numbered once: a record keeps its number in all joins below
    records = records.select(*PERSON_COLUMNS).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    specific = specific_names(all_names(F.col("original_name"), F.col("aliases")))
    keyed = lambda df, *more: df.select(*more, F.explode(F.array_append(F.transform(specific, lambda n: F.concat(F.lit("n:"), n)), F.concat(F.lit("u:"), "uid"))).alias("key"))
    record_keys = keyed(records, F.concat(F.lit("r"), F.col("id").cast("string")).alias("node"))
    pairs = record_keys
    if stored is not None:
        stored = stored.select(*PERSON_COLUMNS)
        near = keyed(stored, "uid").join(record_keys.select("key").distinct().hint("merge"), "key", "left_semi")
        pairs = record_keys.union(near.select(F.concat(F.lit("s"), "uid").alias("node"), "key"))
    groups = connected(pairs)
    empty = F.array().cast("array<string>")
    listed = lambda df: df.withColumns({c: F.coalesce(c, empty) for c in ("aliases", "loyalty")})

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state, current = _Fold(), None
        for batch in batches:
            for row in batch.to_pylist():
                group, new = row.pop("group"), row.pop("id") is not None
                if group != current:
                    yield from state.rows()
                    state = _Fold()
                current = group
                (state.add if new else state.load)(row | {k: row[k] or [] for k in ("aliases", "loyalty")})
        yield from state.rows()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = folded(batches)
        while some := list(itertools.islice(rows, _AT_ONCE)):
            yield pa.RecordBatch.from_pylist(some, _FOLDED)

    many = groups.where("node LIKE 'r%'").select(F.substring("node", 2, 30).cast("long").alias("id"), "group")
    # a record that shares nothing becomes a node as it is, and never goes to Python
    names = F.transform(all_names(F.col("original_name"), F.col("aliases")), lambda n: F.struct(n.alias("name"), F.col("seq").alias("since"), F.lit(None).cast("long").alias("until")))
    alone = listed(records.join(many.select("id").hint("merge"), "id", "left_anti")).withColumn("names", names).select(*PERSON_COLUMNS, "names")
    rows = records.join(many.hint("merge"), "id").select(*PERSON_COLUMNS, "id", "group")
    if stored is not None:
        held = groups.where("node LIKE 's%'").select(F.expr("substring(node, 2)").alias("uid"), "group")
        rows = stored.join(held.hint("merge"), "uid").select(*PERSON_COLUMNS, F.lit(None).cast("long").alias("id"), "group").union(rows)
    # nulls come first: stored nodes by creation, then records by arrival
    order = ["group", F.col("id").isNotNull(), "seq", "id", "uid"]
    return alone.union(rows.repartition("group").sortWithinPartitions(*order).mapInArrow(fold, f"{PERSON_SCHEMA}, names {NAMES}"))


def merge_persons(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All nodes after the records (PERSON_SCHEMA; seq is the order of arrival) have been merged into the stored ones."""
    folded = fold_persons(records, stored)
    if stored is None:
        return folded.select(*PERSON_COLUMNS)
    folded = folded.checkpoint()
    return stored.select(*PERSON_COLUMNS).join(folded.select("uid").hint("merge"), "uid", "left_anti").select(*PERSON_COLUMNS).union(folded.select(*PERSON_COLUMNS))
