import random

import numpy as np
import pytest

from kinloom.llm import common
from kinloom.llm.suffixes import Bytes, LoserTree, common_prefixes, decoded, dedup_suffixes, front_coded, rolled_bytes, sliding_least

SCHEMA = "doc_id long, text string, n_bytes string, kept int, body string, doc array<int>, rest struct<a: int>"


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for a in range(len(d) - window + 1):
            count[d[a : a + window]] = count.get(d[a : a + window], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - window + 1):
            if count[d[a : a + window]] > 1:
                gone[a : a + window] = b"\1" * window
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def texts(seed, n=120, window=20):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "ba", "é", "0", "xyz", "\0", "q\n", "漢"])
    shared = ["".join(word() for _ in range(rng.randint(3, 40))) for _ in range(6)]
    out = [None, "", "a" * (window - 1), "a" * 400, "ab" * 300, shared[0], shared[0], "short"]
    while len(out) < n:
        out.append("".join(rng.choice(shared) if rng.random() < 0.4 else "".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))))
    out.append("".join(word() for _ in range(30_000)) + shared[1] + "a" * 5000)
    return out


@pytest.mark.parametrize(("window", "options"), [(20, {}), (20, {"hot": 1, "fan_in": 3}), (33, {"hot": 3, "fan_in": 2, "block_docs": 5}), (8, {"cell_bytes": 2000, "hot": 20}), (200, {})])
def test_equals_brute_force(spark, window, options):
    rows = texts(window, window=window)
    docs = spark.createDataFrame([(i, t, "x", 3, f"b{i}", [i], (i,)) for i, t in enumerate(rows)], SCHEMA)
    got = dedup_suffixes(docs, window, **({"block_docs": 16} | options)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute(rows, window)
    assert all((r.text, r.body, r.doc, r.rest.a) == (rows[i], f"b{i}", [i], i) for i, r in enumerate(got))
    common.clear_scratch()


def test_empty_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert dedup_suffixes(spark.createDataFrame([], schema)).collect() == []
    assert dedup_suffixes(spark.createDataFrame([(1, None), (None, "")], schema)).where("n_removed > 0 OR n_bytes > 0").count() == 0
    same = spark.createDataFrame([(7, "x" * 30 + str(i % 2)) for i in range(2)] + [(None, "y" * 31), (None, "y" * 31)], schema)
    assert sorted(tuple(r) for r in dedup_suffixes(same, 28).select("n_removed", "n_spans").collect()) == [(30, 1), (30, 1), (31, 1), (31, 1)]
    common.clear_scratch()


def test_a_line_in_all_documents_splits_by_windows(spark):
    """An anchor with many surroundings: windows are dealt out by themselves, and none is lost."""
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefgh", k=60))
    rows = [("".join(rng.choices("xyz", k=rng.randint(0, 50))) + line + "".join(rng.choices("uvw", k=rng.randint(0, 50)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = dedup_suffixes(docs, 40, block_docs=10, hot=50, fan_in=4).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute(rows, 40)
    common.clear_scratch()


def test_merge_gives_order_and_common_prefixes():
    rng = random.Random(1)
    for runs in (1, 2, 3, 7, 16):
        parts = [sorted({bytes(rng.choices(b"ab", k=12)) for _ in range(rng.randint(0, 60))}) for _ in range(runs)]
        coded = []
        for p in parts:
            rows = np.frombuffer(b"".join(p), np.uint8).reshape(-1, 12)
            c = common_prefixes(rows)
            tails = front_coded(rows, c)
            assert [s for _, s in decoded(c, tails, 12)] == p
            coded.append(decoded(c, tails, 12))
        got = list(LoserTree(coded))
        assert [s for *_, s in got] == sorted(s for p in parts for s in p)
        assert [r for r, _, s in got] == [r for _, r in sorted((s, r) for r, p in enumerate(parts) for s in p)]
        for (_, _, a), (_, c, b) in zip(got, got[1:], strict=False):
            assert c == next((i for i in range(12) if a[i] != b[i]), 12)


def test_known_prefixes_are_not_compared_again():
    """Bytes looked at grow with what differs, not with the strings' length: two runs that share 250 of 300 bytes look at them once."""

    class Counted(bytes):
        looked = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counted.looked += len(range(*key.indices(len(self))))
            return super().__getitem__(key)

    same = b"s" * 250
    rows = [sorted(same + bytes([97 + i % 26, 97 + i // 26]) + b"t" * 48 for i in range(k, 400, 2)) for k in (0, 1)]
    runs = [((0 if i == 0 else next(j for j in range(300) if p[i - 1][j] != s[j]), Counted(s)) for i, s in enumerate(p)) for p in rows]
    assert [s for *_, s in LoserTree(list(runs))] == sorted(rows[0] + rows[1])
    assert Counted.looked < 400 * 200


def test_samples_are_settled_by_a_windows_own_bytes():
    rng = random.Random(2)
    data = "".join(rng.choices("abc ", k=3000))
    whole = Bytes(__import__("pyarrow").array([data]), 50)
    alone = lambda a: Bytes(__import__("pyarrow").array([data[a : a + 50]]), 50)
    for at, first, last in zip(whole.at, whole.first, whole.last, strict=True):
        for a in (first, last):
            assert alone(int(a)).at[0] == at - a
    assert (whole.last - whole.first + 1).sum() == 3000 - 50 + 1
    x = np.array(rng.choices(range(1000), k=500), np.uint64)
    assert sliding_least(x, 7).tolist() == [min(x[i : i + 7]) for i in range(494)]
    h = rolled_bytes(np.frombuffer(b"abcabcabd", np.uint8), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
