import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinloom.llm.mixing import fractions_of, mix_sources, period, schedule, shares_of

SCHEMA = "doc_id long, source string, slot string, block int, text string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_deviation_is_less_than_one_block(shares):
    named = {f"s{i}": a for i, a in enumerate(shares)}
    done, total = Counter(), sum(shares)
    for t, (name, k, slot) in enumerate(period(named), 1):
        assert slot == t - 1 and k == done[name]
        done[name] += 1
        assert all(abs(done[n] - Fraction(t * a, total)) < 1 for n, a in named.items())
    assert done == Counter(named)


def test_shares():
    assert shares_of({"a": 1.0, "b": 1.0, "c": 2.0}, 8) == {"a": 2, "b": 2, "c": 4}
    assert sum(shares_of({c: 1.0 for c in "abcdefg"}, 1000).values()) == 1000
    assert shares_of({"a": 1e-9, "b": 1.0}, 10) == {"a": 1, "b": 9}
    with pytest.raises(ValueError):
        shares_of({"a": 1, "b": 1}, 1)


def test_mix_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), "x", 1, f"t{i}") for i in range(700)]
    rows += [(None, "a", None, None, None), (3, rows[3][1], "x", 1, "t3"), (9, "solo", "x", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    weights = {"hot": 2.0, "a": 3.0, "b": 1.0, None: 1.0, "solo": 0.5}
    found = mix_sources(docs, weights, block_docs=4, slots=30).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in found) == Counter((i, s, t) for i, s, _, _, t in rows)
    name = lambda s: "null" if s is None else "=" + s
    shares = shares_of({name(k): v for k, v in weights.items()}, 30)
    slots = {(n, k): t for n, k, t in period(shares)}
    by_source = defaultdict(list)
    for i, s, *_ in rows:
        by_source[name(s)].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i))
    want = Counter()
    for n, keyed in by_source.items():
        for k, (_, i) in enumerate(sorted(keyed, key=lambda x: x[0])):
            b = k // 4
            want[n, i, b, b // shares[n] * 30 + slots[n, b % shares[n]], k % 4] += 1
    assert Counter((name(r.source), r.doc_id, r.block, r.slot, r.position) for r in found) == want


def test_defaults_and_nothing(spark):
    docs = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(200)], "doc_id long, source string")
    assert mix_sources(docs).count() == 200
    assert mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 1.0}).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 50), min_size=1, max_size=9), st.integers(1, 400))
def test_every_block_lies_in_the_window_of_its_exact_weight(weights, n):
    parts = fractions_of({f"s{i}": w for i, w in enumerate(weights)})
    found = schedule(parts, {k: n // (i + 1) for i, k in enumerate(parts)})
    assert len({t for slots in found.values() for t in slots.tolist()}) == sum(map(len, found.values()))
    for name, slots in found.items():
        w = parts[name]
        assert all(k * w.denominator // w.numerator <= t < -(-(k + 1) * w.denominator // w.numerator) for k, t in enumerate(slots.tolist()))


@pytest.mark.parametrize("weights", [None, {"hot": 0.9, **{f"s{i}": 0.1 / 19 for i in range(19)}}, {"hot": 7.0, **{f"s{i}": 1.0 + i / 3 for i in range(19)}}])
def test_lag_against_the_weights_over_many_periods(spark, weights):
    names = ["hot"] * 9 + [f"s{i}" for i in range(19)]
    rows = [(i, names[i % len(names)]) for i in range(12000)]
    counts = Counter(s for _, s in rows)
    target = weights or {k: n**0.5 for k, n in counts.items()}
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1, slots=50).collect()
    assert len(found) == 12000 and len({r.slot for r in found}) == 12000
    total = sum(target.values())
    for r in found:  # before and after its slot, a source is less than one block from its weight
        w = target[r.source] / total
        assert abs(r.block - w * r.slot) < 1 + 1e-6 and abs(r.block + 1 - w * (r.slot + 1)) < 1 + 1e-6
