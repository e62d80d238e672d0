"""Versions as a log against a dictionary, and ingestion that writes its own rows alone."""

import random
from dataclasses import replace

from kinloom.operators.graph import Graph, family_trails, load, save, save_changes
from kinloom.operators.store import parts_of, read_version, write_version
from kinloom.sources.files import read_or
from kinloom.streaming.ingest import EMPTY, empty_graph, write_results
from tests.test_batches import Model, chunks, results, seen

KEYS = {"t": ["a", "b"]}


def test_versions_equal_a_dictionary(spark, tmp_path):
    rng, root, want, last = random.Random(3), str(tmp_path), {}, None
    frame = lambda rows: spark.createDataFrame(rows, "a string, b long, v string")
    for n in range(14):
        rows = {(rng.choice("xyz"), rng.randrange(6)): f"{n}" for _ in range(rng.choice([0, 1, 4]))}
        gone = rng.sample(sorted(want), min(len(want), rng.choice([0, 0, 2])))
        want = {k: v for k, v in (want | rows).items() if k not in gone}
        write_version({"t": frame([(*k, v) for k, v in rows.items()])}, root, f"v{n}", last, KEYS, {"t": frame([(*k, "") for k in gone])} if gone else None, width=3)
        last = f"v{n}"
        assert len(parts_of(spark, root, last)) <= 2 * 3
        if n % 4 == 1 or n == 13:
            got = read_version(spark, root, last, KEYS)["t"].collect()
            assert {(r.a, r.b): r.v for r in got} == want and len(got) == len(want)
    # versions are never changed
    assert read_version(spark, root, "v0", KEYS)["t"].count() <= 4


def test_parallel_rows_of_a_snapshot_stay_until_touched(spark, tmp_path):
    spark.createDataFrame([("x", 1, "p"), ("x", 1, "q"), ("y", 1, "p"), ("y", 1, "q")], "a string, b long, v string").write.parquet(str(tmp_path / "s/t"))
    new = spark.createDataFrame([("x", 1, "r")], "a string, b long, v string")
    write_version({"t": new}, str(tmp_path), "n", "s", KEYS)
    assert sorted(map(tuple, read_version(spark, str(tmp_path), "n", KEYS)["t"].collect())) == [("x", 1, "r"), ("y", 1, "p"), ("y", 1, "q")]


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    """Versions above a graph of ten thousand persons are as large as above an empty one, and give what chunk by chunk gives."""
    rows, model = chunks(5, 6), Model()
    for c in rows:
        model.add_chunk(c)
    many = spark.range(10_000).selectExpr("concat('old', id) AS uid", "concat('Old ', id) AS original_name", "CAST(array() AS array<string>) AS aliases", "'r' AS role", "CAST(array() AS array<string>) AS loyalty", "CAST(NULL AS int) AS birth_year", "CAST(NULL AS int) AS death_year", "CAST(NULL AS string) AS death_cause", "'long ago' AS description", "-1 - id AS seq")
    save(replace(empty_graph(spark), person=many), str(tmp_path / "large/base"))
    sizes = {}
    for name, last in (("small", None), ("large", "base")):
        root = str(tmp_path / name)
        for k in range(3):
            graph = load(spark, f"{root}/{last}") if last else empty_graph(spark)
            written = write_results(graph, results(spark, list(enumerate(rows[2 * k : 2 * k + 2]))))
            save_changes(written.changed, root, f"v{k}", last, width=2)
            last = f"v{k}"
        graph = load(spark, f"{root}/{last}")
        if name == "large":
            assert graph.person.where("uid LIKE 'old%'").count() == 10_000
            graph = replace(graph, person=graph.person.where("uid NOT LIKE 'old%'"))
        want = {u: (n["original_name"], sorted(n["aliases"]), n["loyalty"], n["description"], n["birth_year"]) for u, n in model.person.items()}
        assert seen(graph) == (want, model.other, model.edges)
        sizes[name] = [size(tmp_path / name / f"v{k}") for k in range(3)]
    assert all(b < 1.2 * a for a, b in zip(sizes["small"], sizes["large"], strict=True))
    assert max(sizes["large"]) < size(tmp_path / "large/base") / 3
    assert read_or(spark, str(tmp_path / "large/v2/parts"), "place int, version string, level int").count() == 3


def trails(nodes, edges, root, depth):
    """Edges on all trails, one after the other."""
    found, open_ = set(), [(root, ())]
    for _ in range(depth):
        longer = []
        for at, path in open_:
            for e, (a, _, b) in enumerate(edges):
                for x, y in {(a, b), (b, a)}:
                    if x == at and e not in path:
                        longer.append((y, (*path, e)))
        open_ = longer
        found |= {edges[e] for at, path in open_ if nodes[at] for e in path}
    return found


def test_family_trails_equal_all_trails(spark):
    """Random multigraphs with parallel edges, self-loops and dynasties, all in one graph under different names."""
    rng = random.Random(8)
    for depth in (1, 2, 3, 4):
        persons, dynasties, rows, want, starts = [], [], [], set(), []
        for g in range(25):
            nodes = {f"{g}-{k}": k == 0 or rng.random() < 0.6 for k in range(6)}
            edges = [(rng.choice(list(nodes)), rng.choice(["FATHER_OF", "SPOUSE"]), rng.choice(list(nodes))) for _ in range(rng.randrange(1, 9))]
            persons.extend(n for n, p in nodes.items() if p)
            dynasties.extend(n for n, p in nodes.items() if not p)
            rows += edges
            starts.append(f"{g}-0")
            want |= {(f"{g}-0", *e) for e in trails(nodes, edges, f"{g}-0", depth)}
        null = "CAST(NULL AS {}) AS {}".format
        fill = lambda df, kind: df.selectExpr(*[c if c in df.columns else null(t, c) for c, t in (x.split() for x in EMPTY[kind].split(", "))])
        graph = Graph(
            fill(spark.createDataFrame([(p, f"name {p}") for p in persons], "uid string, original_name string"), "person"),
            fill(spark.createDataFrame([(d, d) for d in dynasties], "uid string, name string"), "dynasty"),
            empty_graph(spark).event,
            empty_graph(spark).place,
            fill(spark.createDataFrame([*rows, ("0-0", "FATHER_OF", "nowhere"), ("0-0", "RIVAL", "1-0")], "src string, rel_type string, dst string"), "edges"),
        )
        got = family_trails(graph, spark.createDataFrame([(s,) for s in starts], "uid string"), depth).collect()
        assert {(r.root, r.from_uid, r.rel_type, r.to_uid) for r in got} == want and len(got) == len(want)
        assert all((r.from_name == f"name {r.from_uid}") == (r.from_uid in persons) for r in got)
