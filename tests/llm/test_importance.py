import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinloom.llm.importance import combined, features, resample, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, buckets=10_000, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in part for g in grams(x)[1]) for part in ([d[1] for d in docs], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out, order = [], []
    for i, text in docs:
        words, found = grams(text)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(found), weight, score, None])
        if len(words) >= least:
            order.append(out[-1])
    order.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, row in enumerate(order[: len(order) * percent // 100]):
        row[5] = k + 1
    return out


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "cat", "x9", "éa", "漢字" * rng.randint(1, 60), "ÄB", "Z", "und", "İ", "w" * rng.choice([63, 64, 65, 200])])
    return [rng.choice([" ", "-", "_ "]).join(word() for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"buckets": 7, "percent": 50}])
def test_equals_brute_force(spark, options):
    rows = list(enumerate([None, "", "...", "One two", "\0a\nb\tc", "q " * 20_000, *texts(1, 300)])) + [(None, "a b c " * 10)] * 3 + [(9, "tie " * 30), (9, "tie " * 30)]
    target = [None, *texts(2, 40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, rank string")
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, brute(rows, target, **options)), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b " * 50)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in resample(one, none).collect()] == [(1, 100, 297)]


def test_crc_algebra():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 1000, 70_000])) for _ in range(2))
        whole = combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert whole[0] == zlib.crc32(a + b)
    assert shifted(np.array([5], np.uint32), np.array([0]))[0] == 5
    texts_ = texts(5, 50)
    n_words, lengths = features(pa.array(texts_), 4, 1 << 32)
    for k, (found, begin) in enumerate(lengths, 1):
        for i, t in enumerate(texts_):
            words = grams(t)[0]
            assert n_words[i] == len(words)
            assert found[begin[i] : begin[i + 1]].tolist() == [zlib.crc32(" ".join(words[j : j + k]).encode()) for j in range(len(words) - k + 1)]
