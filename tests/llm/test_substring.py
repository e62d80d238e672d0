import os
import random
import re

import numpy as np
import pytest

from kinloom.llm import common
from kinloom.llm.substring import _send, answer, dedup_substrings, difference_cover, grouped

SCHEMA = "doc_id long, text string, n_words string, ids array<int>, block struct<a: int, rest: string>"


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, w in words:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for (i, w), (_, text) in zip(words, rows, strict=True):
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < key(i):
                gone.update(range(a, a + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((*key(i), len(w), len(gone), " ".join(kept) if gone else text))
    return sorted(out, key=repr)


def found(docs, **args):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs, **args).collect()), key=repr)


def rows():
    rng = random.Random(3)
    common = [rng.choices([f"c{i}" for i in range(50)], k=rng.randint(10, 40)) for _ in range(5)]
    out = []
    for n in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choices("abcdefghij", k=rng.randint(0, 20))
            if rng.random() < 0.7:
                c = rng.choice(common)
                a = rng.randint(0, len(c) - 5)
                w += c[a : a + rng.randint(5, 40)]
        out.append((n, rng.choice([" ", "\n", "  \t"]).join(w)))
    out += [(61, None), (62, ""), (63, " \x0b"), (64, "w " * 5000), (65, "w " * 12), (66, "w " * 13), (67, "é\x1cx " * 14), (None, out[5][1]), (None, None), (5, out[5][1]), (5, out[5][1]), (2, "w " * 14)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("window", [13, 8, 3])
def test_matches_brute_force(spark, window):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", [1, None], (i, None)) for i, t in data], SCHEMA).repartition(3)
    want = brute(data, window)
    assert sum(r[3] > 0 for r in want) > 10
    got = dedup_substrings(docs, window=window, block_docs=7)
    assert got.columns == ["doc_id", "text", "ids", "block", "n_words", "n_removed"]
    assert found(docs, window=window, block_docs=7) == want
    assert got.where("ids[0] = 1 AND ids[1] IS NULL AND block.a <=> doc_id AND block.rest IS NULL").count() == len(data)


def test_rejoins_and_handles_nothing(spark):
    docs = spark.createDataFrame([(1, " a \n b ")], "doc_id long, text string")
    assert [r.text for r in dedup_substrings(docs, rejoin=True).collect()] == ["a b"]
    assert [r.text for r in dedup_substrings(spark.createDataFrame([(1, None)], "doc_id long, text string"), rejoin=True).collect()] == [""]
    assert dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("v", range(1, 20))
def test_difference_covers(v):
    d = difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_windows_are_compared_by_both_hashes():
    h, more = np.array([5, 5, 5, 1], np.uint64), np.array([7, 8, 7, 7], np.uint64)
    order, new = grouped(h, more)
    assert order[0] == 3 and sorted(order[1:3]) == [0, 2] and new.tolist() == [True, True, False, True]
    _, new = grouped(h, None)
    assert new.sum() == 2
    sent = [_send(block, np.array([block]), h[[3, 0]], m, np.zeros(2, np.int64), np.zeros(2, np.int64), 1) for block, m in ((1, more[[3, 0]]), (2, more[[3, 1]]))]
    found = answer([r for s in sent for r in s.itertuples()])
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=2).tolist() for x in found["smaller"]] == [[0, 0], [1, 0]]


def test_cells_number_with_the_data_and_scratch_goes(spark):
    before = {t.name for t in spark.catalog.listTables()}
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", [1, None], (i, None)) for i, t in data], SCHEMA).repartition(3)
    assert found(docs, window=13, block_docs=7, cell_bytes=200) == brute(data, 13)
    root = common._waiting[-1].root
    assert {t.name for t in spark.catalog.listTables()} > before and os.path.exists(root.removeprefix("file:"))
    common.clear_scratch()
    assert {t.name for t in spark.catalog.listTables()} <= before and not os.path.exists(root.removeprefix("file:"))


def test_scratch_of_others_stays(spark):
    """What until_stored() deletes is its own: a lazy result made before it can still be read."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d e")], "doc_id long, text string")
    other = dedup_substrings(docs, 3)
    with common.until_stored():
        mine = common.stored(dedup_substrings(docs, 4), "mine")
    assert sorted(r.n_removed for r in other.collect()) == [0, 5] and sorted(r.n_removed for r in mine.collect()) == [0, 5]
    common.clear_scratch()
