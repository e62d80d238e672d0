import hashlib
import random
import re

import pytest

from kinloom.llm.rope import LEAF, fill_in_middle, find, joined, leaf, leaves, put_back, rearranged, restore, rope, split


def brute(doc_id, text, seed=7, percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_percent else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(4)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "<P>", "a<S\n>", "<", "<<P\n", "x<M>y\nz", "漢字\n🙂\n", "r\r\nq\x0b \n"]
    out += ["".join(rng.choice(["ab", "é", "\n", "🙂", "<", "P>", "S", "\r"]) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    out += ["L" * (5 * LEAF + 3), ("w" * 70 + "\n") * 4000, "\n" * (3 * LEAF), "é" * (LEAF - 1) + "\n" + "z" * 2 * LEAF, "y" * LEAF + "\n"]
    return out


@pytest.mark.parametrize("options", [{}, {"seed": 1, "percent": 50, "spm_percent": 100}, {"spm_percent": 0}])
def test_equals_brute_force_and_comes_back(spark, options):
    rows = [(i, t, "x", f"c{i}", i) for i, t in enumerate(texts())] + [(None, "a\nb\nc", "x", "c", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, __text string, n int")
    found = restore(fill_in_middle(docs, **options)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.text, r["__text"]) for r in found), key=key)
    want = sorted(((i, *brute(i, t, **options), t or "", t, c) for i, t, _, c, _ in rows), key=key)
    assert got == want
    assert len({r[2] for r in want}) > 1


def test_empty_table(spark):
    assert restore(fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_ropes_split_anywhere_and_stay_balanced():
    rng = random.Random(8)
    text = "".join(rng.choice(["\n", "some words ", "é"]) for _ in range(30_000))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    r = rope(text)
    assert (r.units, r.points) == (len(units), len(text))
    for _ in range(60):
        k = rng.randint(0, len(units))
        a, b = split(r, k, True)
        assert "".join(leaves(a)) == "".join(units[:k]) and "".join(leaves(b)) == "".join(units[k:])
        assert (a.units, b.units) == (k, len(units) - k)
        p = rng.randint(0, len(text))
        x, y = split(joined(b, a), p, False)
        whole = "".join(units[k:] + units[:k])
        assert ("".join(leaves(x)), "".join(leaves(y))) == (whole[:p], whole[p:])
        for t in (a, b, x, y):
            assert t.height <= 2 * max(1, sum(1 for _ in leaves(t))).bit_length() + 2
    grown = leaf("")
    for i in range(3000):
        grown = joined(grown, leaf(f"{i}\n"))
    assert grown.height <= 17 and grown.units == 3000


def test_sentinels_across_leaves_are_found():
    for k in range(LEAF - 4, LEAF + 2):
        text = "a" * k + "<S>" + "b" * 50
        assert find(rope(text), "<S>") == k
    assert find(rope("abc"), "<S>") == -1
    output, *_ = rearranged("x<\n" * 700, (3, 400), True)
    assert put_back(output, "spm") == "x<\n" * 700
