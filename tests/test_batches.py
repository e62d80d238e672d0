"""Ingestion over several batches against the rule applied to one chunk after the other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions.values import AMBIGUOUS_TITLES
from kinloom.operators.asof import HISTORY, resolve_at
from kinloom.operators.graph import Graph, load, save
from kinloom.operators.merge import merge_persons
from kinloom.sources.files import RESULT
from kinloom.streaming.ingest import apply_results, empty_graph, load_seed, write_results


class Model:
    """The graph as it is after each chunk, every record held against every node."""

    def __init__(self):
        self.person, self.other, self.edges, self.counts = {}, {"dynasty": {}, "event": {}, "place": {}}, {}, [0, 0]

    def add_person(self, p):
        p = {"aliases": [], "loyalty": [], "role": "其他", "description": "", "birth_year": None, "death_year": None, "death_cause": None} | p
        names = {n for n in [p["original_name"], *p["aliases"]] if n}
        specific = {n for n in names if len(n) > 1 and n not in AMBIGUOUS_TITLES}
        nodes = self.person.values()
        match = next((n for n in nodes if n["original_name"] in specific), None) or next((n for n in nodes if specific & set(n["aliases"])), None)
        aliases = match and (set(match["aliases"]) | names) - {match["original_name"], ""}
        if match is None or len(aliases) > 25:
            self.person.setdefault(p["uid"], dict(p)).update({k: v for k, v in p.items() if v is not None or k not in ("birth_year", "death_year", "death_cause")})
            return
        match |= {"aliases": sorted(aliases), "loyalty": list(dict.fromkeys(match["loyalty"] + p["loyalty"]))}
        match["description"] = max(match["description"], p["description"], key=len)
        match |= {k: p[k] for k in ("birth_year", "death_year", "death_cause") if p[k] and not match[k]}

    def person_uid(self, name):
        return next((u for u, n in self.person.items() if name and (name == n["original_name"] or name in n["aliases"])), None)

    def uid(self, name):
        found = self.person_uid(name)
        for nodes in self.other.values():
            found = found or next((u for u, n in nodes.items() if n == name), None)
        return found

    def edge(self, key, **values):
        self.edges.setdefault(key, {"year": None, "description": None, "role": None}).update({k: v for k, v in values.items() if v is not None})

    def add_chunk(self, c):
        for kind, field in (("dynasty", "dynasties"), ("place", "places")):
            self.other[kind] |= {x["uid"]: x["name"] for x in c[field]}
        for p in c["persons"]:
            self.add_person(p)
        for e in c["events"]:
            self.other["event"][e["uid"]] = e["name"]
            for n in e["participants"]:
                who = self.person_uid(n) or (n if n in self.person else None)
                if who:
                    self.edge((who, "PARTICIPATED_IN", e["uid"]), role="参与者")
        for r in c["relations"]:
            a, b = self.uid(r["source"]), self.uid(r["target"])
            self.counts[not (a and b)] += 1
            if a and b:
                self.edge((a, r["relation_type"], b), year=r.get("year"), description=r["description"])


def chunks(seed, n):
    rng = random.Random(seed)
    names = [f"名{k}" for k in range(40)] + ["太祖", "王", ""]
    places = [f"地{k}" for k in range(4)]
    out = []
    for _ in range(n):
        c = {"dynasties": [{"uid": f"d{rng.randrange(3)}", "name": rng.choice(["唐", "梁", names[0], "晋"]), "description": ""}], "places": [{"uid": f"l{k}", "name": rng.choice(places), "description": ""} for k in range(2)]}
        c["persons"] = [
            {"uid": f"u{rng.randrange(25)}", "original_name": rng.choice(names), "aliases": rng.sample(names, rng.choice([0, 0, 1, 2, 14])), "loyalty": rng.sample("xyz", rng.randrange(3)), "description": rng.choice(["", "a", "bb"]), "birth_year": rng.choice([None, 0, 900])}
            for _ in range(rng.randrange(5))
        ]
        c["events"] = [{"uid": f"e{rng.randrange(5)}", "name": rng.choice(["战", names[1], "变"]), "event_type": "t", "description": "", "participants": rng.sample([*names, "u1", "u2"], 4)} for _ in range(2)]
        c["relations"] = [{"source": rng.choice([*names, *places]), "target": rng.choice([*names, "唐", "战", "变"]), "relation_type": rng.choice(["R", "S", "PARTICIPATED_IN"]), "year": rng.choice([None, 910]), "description": rng.choice(["", "d"])} for _ in range(8)]
        out.append(c)
    return out


def results(spark, rows):
    return spark.createDataFrame([(s, json.dumps(c, ensure_ascii=False)) for s, c in rows], "seq long, j string").select("seq", F.from_json("j", RESULT).alias("result"))


def seen(graph: Graph):
    persons = {r.uid: (r.original_name, sorted(r.aliases), list(r.loyalty), r.description, r.birth_year) for r in graph.person.collect()}
    nodes = {label: {r.uid: r.name for r in getattr(graph, label).collect()} for label in ("dynasty", "event", "place")}
    rows = graph.edges.collect()
    uids = {r.uid for r in graph.nodes().collect()}
    assert all(r.src in uids and r.dst in uids for r in rows), "an edge has lost an end"
    return persons, nodes, {(r.src, r.rel_type, r.dst): {"year": r.year, "description": r.description, "role": r.role} for r in rows}


@pytest.mark.parametrize(("seed", "sizes"), [(1, (10,)), (3, (4,)), (4, (1,))])
def test_batches_equal_chunk_by_chunk(spark, tmp_path, seed, sizes):
    rows = chunks(seed, 3 if sizes == (1,) else 10)
    model = Model()
    for c in rows:
        model.add_chunk(c)
    want = ({u: (n["original_name"], sorted(n["aliases"]), n["loyalty"], n["description"], n["birth_year"]) for u, n in model.person.items()}, model.other, model.edges)
    for size in sizes:
        graph, counts = empty_graph(spark), [0, 0]
        for k, a in enumerate(range(0, len(rows), size)):
            # each run numbers its chunks from 0, as books do
            batch = results(spark, list(enumerate(rows[a : a + size])))
            written = write_results(graph, batch)
            save(written.graph, str(tmp_path / f"{size}-{k}"))
            graph = load(spark, str(tmp_path / f"{size}-{k}"))
            counted = {r.kind: r.n for r in written.counts(batch).collect()}
            counts = [counts[0] + counted["relations_ok"], counts[1] + counted["relations_failed"]]
            assert counted["persons"] == sum(len(c["persons"]) for c in rows[a : a + size])
        assert seen(graph) == want
        assert counts == model.counts


def chunk(persons=(), relations=()):
    person = lambda uid, name, *aliases: {"uid": uid, "original_name": name, "aliases": list(aliases), "loyalty": [], "description": ""}
    return {"dynasties": [], "places": [], "events": [], "persons": [person(*p) for p in persons], "relations": [{"source": a, "target": b, "relation_type": "R", "description": ""} for a, b in relations]}


PERSON = "uid string, original_name string, aliases array<string>, seq long"


def merged(spark, stored, *rows):
    """merge_persons() of rows (seq, uid, name, aliases) into stored nodes, written so that the next batch reads it."""
    fill = {"role": F.lit("其他"), "loyalty": F.expr("CAST(array() AS array<string>)"), "birth_year": F.lit(None).cast("int"), "death_year": F.lit(None).cast("int"), "death_cause": F.lit(None).cast("string"), "description": F.lit("")}
    records = spark.createDataFrame([(u, n, a, s) for s, u, n, a in rows], PERSON).withColumns(fill)
    return merge_persons(records, stored).checkpoint()


def test_stored_nodes_are_never_merged(spark):
    """A record that bears the names of two stored nodes joins one of them; the other stays through later batches."""
    nodes = merged(spark, None, (1, "a", "李存勖", []), (2, "b", "亚子", []), (3, "d", "王彦章", []))
    nodes = merged(spark, nodes, (4, "x", "李存勖", ["亚子"]))
    nodes = merged(spark, nodes, (5, "z", "不相干", []), (6, "y", "亚子", ["小李"]))
    assert {r.uid: r.aliases for r in nodes.collect()} == {"a": ["亚子"], "b": ["小李"], "d": [], "z": []}


def test_equal_numbers_are_records_of_their_own(spark):
    nodes = merged(spark, None, (5, "a", "李存勖", ["亚子"]), (5, "b", "亚子", ["小李"]), (5, "b", "亚子", ["小李"])).collect()
    assert len(nodes) == 1 and {"小李", "亚子", "李存勖"} == {nodes[0].original_name, *nodes[0].aliases}


def test_arrival_counts_not_the_chunks_number(spark):
    """The seed's chunk has number 0 like a book's first; a later run may have smaller numbers than the one before."""
    graph = apply_results(load_seed(spark), results(spark, [(9, chunk([("old", "王彦章", "铁枪"), ("m", "The Miller", "Orrin Vale")]))]))
    persons = seen(apply_results(graph, results(spark, [(3, chunk([("new", "铁枪")]))])))[0]
    assert persons["old"] == ("王彦章", ["铁枪"], [], "", None)
    assert persons["person_orrin"][0] == "Orrin Vale" and not {"new", "m"} & set(persons)


def test_final_names(spark):
    rows = results(spark, [(0, chunk([("a", "甲甲")], [("甲甲", "乙乙")])), (1, chunk([("b", "乙乙")]))])
    assert set(seen(apply_results(empty_graph(spark), rows, "final"))[2]) == {("a", "R", "b")}


def test_resolve_at_matches_a_scan(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        since = rng.choice([None, rng.randrange(50)])
        until = rng.choice([None, None, None, (since or 0) + rng.randrange(1, 20)])
        label = rng.randrange(3)
        rows.append((rng.choice(["hot", "a", "b", "c"]), f"u{k}", ["Person", "Dynasty", "Event"][label], label, rng.randrange(60), since, until))
    wanted = [(n, at) for n in ("hot", "a", "b", "none") for at in range(-1, 55, 3)]
    history = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('name', 'uid', 'label') else 'int' if c == 'priority' else 'long'}" for c in HISTORY))
    got = {(r.name, r.at): r.uid for r in resolve_at(history, spark.createDataFrame(wanted * 2, "name string, at long")).collect()}
    want = {}
    for name, at in wanted:
        live = [(r[3], r[4], r[1]) for r in rows if r[0] == name and (r[5] is None or r[5] <= at) and (r[6] is None or r[6] > at)]
        want[name, at] = min(live)[2] if live else None
    assert got == want
