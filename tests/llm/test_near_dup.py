import random
import re

import numpy as np
import pytest

from kinloom.llm.components import components
from kinloom.llm.near_dup import bands_of, near_duplicates, shingle_set, sketches

SCHEMA = "doc_id long, text string, n_shingles string, component int"


def brute(rows, width, percent):
    """(doc_id, set size, component, kept) by comparing all pairs."""
    def shingles(text):
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        return {w[i : i + width] for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if None not in (a, b) and x and y and label[b] < label[a] and 100 * len(x & y) >= percent * len(x | y):
                    label[a], changed = label[b], True
    return sorted((i is None, i or 0, len(s), label[i], i == label[i]) for i, s in sets)


def found(docs, **args):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **args).collect())


def copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(8, 260))
        for _ in range(rng.randint(1, 9)):
            text = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base]
            rows.append((n, rng.choice([" ", "\n", " \t"]).join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One TWO"), (n + 5, "one"), (n + 6, "É a b"), (n + 7, "é a b"), (n + 8, "long word " * 3000), (n + 9, "x\x1cy z")]
    rows += [(3, rows[3][1]), (None, rows[3][1]), (None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "shape"), [(3, 85, (9, 54)), (5, 80, (8, 80))])
def test_matches_all_pairs(spark, width, percent, shape):
    rows = copies()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows, width, percent)
    assert sum(not r[4] for r in want) > 10
    assert found(docs, width=width, percent=percent, rows=shape[0], bands=shape[1], block=4) == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join("z" + str(rng.random()) if rng.random() < 0.03 else w for w in base)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, width=3, percent=85, rows=9, bands=54, block=32) == brute(rows, 3, 85)


def test_nothing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    draws = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 6, 40, 2000):
        a, b = np.sort(draws[:n]), np.sort(draws[n // 5 : n + n // 5])
        s = sketches([a, b, a], 486)
        assert (s != np.iinfo(np.uint64).max).all() and (s[0] == s[2]).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12
    assert bands_of(s, 9).shape == (3, 54)


def test_shingle_sets():
    assert len(shingle_set("a b c d", 3)) == 2 and len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0
    assert (shingle_set("A b\nc", 3) == shingle_set("a B\x0bc", 3)).all()


def test_components(spark):
    rng = random.Random(2)
    for links in ([], [(1, 1)], [(i, i + 1) for i in range(40)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)], [(0, i) for i in range(1, 50)]):
        label = {x: x for e in links for x in e if e[0] != e[1]}
        for _ in label:
            for a, b in links:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted(label.items())
