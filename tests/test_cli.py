import json

import pytest

from kinloom.__main__ import main, newest_graph


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cli")
    (path / "books").mkdir()
    (path / "books/one.txt").write_text("第一章 开端\n" + "某人到了某地。" * 400, encoding="utf-8")
    (path / "saved").mkdir()
    person = {"uid": "p1", "original_name": "Ada North", "aliases": ["Ada"], "role": "king", "loyalty": [], "description": "rules the north"}
    (path / "saved/a.json").write_text(json.dumps({"persons": [person], "dynasties": [], "events": [], "places": [], "relations": []}))
    return path


def test_process_and_ingest(spark, root):
    main(["process", str(root / "books"), str(root / "chunks"), "--size", "500", "--overlap", "50"])
    n = spark.read.json(str(root / "chunks")).count()
    assert n > 3
    main(["process", str(root / "books"), str(root / "chunks"), "--size", "10000"])  # chunks that are there stay
    assert spark.read.json(str(root / "chunks")).count() == n
    for _ in range(2):  # a second run finds nothing new
        main(["ingest", str(root / "chunks"), "--root", str(root / "state")])
        assert spark.read.parquet(str(root / "state/ledger")).count() == n


def test_saved_results_are_found(spark, root, capsys):
    main(["ingest-saved", str(root / "saved"), "--root", str(root / "other")])
    assert [r.uid for r in newest_graph(spark, str(root / "other")).person.collect()] == ["p1"]
    capsys.readouterr()
    main(["search", "north", "--root", str(root / "other")])
    assert json.loads(capsys.readouterr().out)["uid"] == "p1"
    main(["stats", "--root", str(root / "other")])
    assert capsys.readouterr().out
    main(["ask", "who?", "--root", str(root / "other")])
    assert json.loads(capsys.readouterr().out)["question"] == "who?"


def test_empty_root(spark, root, capsys):
    main(["search", "north", "--root", str(root / "none")])
    assert capsys.readouterr().out == ""


def test_seed_rows_and_counts(spark, root, capsys):
    main(["seed", "--root", str(root / "seeded")])
    g = newest_graph(spark, str(root / "seeded"))
    assert (g.person.count(), g.dynasty.count(), g.event.count(), g.place.count(), g.edges.count()) == (5, 3, 3, 3, 12)
    counts = {r.kind: r.n for r in spark.read.parquet(str(root / "state/counts")).groupBy("kind").sum("n").toDF("kind", "n").collect()}
    assert counts["failed_chunks"] == 0 and counts["persons"] == 0
