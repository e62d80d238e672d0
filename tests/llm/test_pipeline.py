import itertools

import corpus_pipeline as C
from kinloom.llm.near_dup import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k * seed) % 99991}" for k in range(n))


def rows():
    texts = [text_of(s, 120) for s in range(12)]
    passage = text_of(77, 60)
    texts[3] = texts[2]  # exact copy
    texts[5] = texts[4].replace("w", "W", 1)  # near copy
    texts[6] += " " + passage
    texts[7] += " " + passage + " end"
    texts += ["", None, "too short", "again and " * 60]
    out = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, (8, texts[8], "en", "c", len(texts[8]))]


def brute(docs):
    good = [d for d in docs if d[1] and len(d[1].split()) >= 20 and d[0] != 15]
    sets = {d[0]: set(shingle_set(d[1], 5).tolist()) for d in good}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    good = [d for d in good if root[d[0]] == d[0]]
    first = {}
    for d in sorted(good, key=lambda d: d[0]):
        w = d[1].split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d[0])
    out = {}
    for d in good:
        w = d[1].split()
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d[0] for j in range(50)}
        out.setdefault(d[0], " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_stages_match_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), SCHEMA)
    found = docs.collect()
    assert {r.doc_id: r.text for r in found} == brute(rows())
    assert sorted(r.doc_id for r in found) == sorted([*brute(rows()), 8])  # a repeated row stays repeated
    assert all(r.n_chars == len(r.text) for r in found)
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == set(brute(rows()))
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(spans))) and sum(n for _, n in spans) <= 1024


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert C.STAGES[-1][1](spark, docs, "").count() == 0


def test_weights_change_the_packed_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, text_of(i, 150), "en", "ab"[i % 2], 1) for i in range(600)], SCHEMA).repartition(3)
    source, share, order = {i: "ab"[i % 2] for i in range(600)}, {}, {}
    for a in (9.0, 1.0):
        monkeypatch.setattr(C, "WEIGHTS", {"a": a, "b": 10.0 - a})
        mixed = [r.doc_id for r in C.mix(spark, docs, "").collect()]
        packed = sorted(C.packing(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
        assert {r.sequence_id for r in packed} == set(range(packed[-1].sequence_id + 1))
        rank, seen = {d: k for k, d in enumerate(mixed)}, {}
        for r in packed:
            seen[r.sequence_id] = min(seen.get(r.sequence_id, 10**9), rank[r.doc_id])
        assert list(seen.values()) == sorted(seen.values())
        order[a] = [r.doc_id for r in packed]
        share[a] = sum(source[d] == "a" for d in order[a][:150])
    assert order[9.0] != order[1.0] and share[9.0] > 100 and share[1.0] < 50


def test_equal_lengths_are_laid_in_order(spark):
    from kinloom.llm.common import stored
    from kinloom.llm.packing import place

    rows = [(i, 0, 0, 100 if i % 5 else 700, (i * 7919) % 1000) for i in range(1000)]
    pieces = stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, order long").withColumn("ids_crc32", C.F.lit(1)), "pieces")
    found = place(pieces, 1024).collect()
    assert sorted(r.doc_id for r in found) == list(range(1000))
    at = {r.doc_id: r.sequence_id for r in found}
    long = [at[i] for i, *_ in sorted((r for r in rows if r[3] == 700), key=lambda r: r[4])]
    assert long == sorted(long)


def test_nulls_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k % 60_013}x{k}" for k in range(120_000))
    rows = [(None, text_of(3, 60), "en", None, 5, "a", 1, None), (None, None, None, None, None, None, None, None), (1, long, "en", "s", len(long), "b", 2, [1]), (1, text_of(1, 60), "en", "s", 7, "c", 3, []), (2, text_of(9, 80) + "\n", None, "t", None, "d", 4, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string, slot int, `n_words` array<int>")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    found = {(r.doc_id, r.kept): r for r in docs.collect()}
    assert {(r.text, r.n_chars, r.slot) for r in found.values()} == {(r[1], r[4], r[6]) for r in (rows[0], rows[2], rows[3], rows[4])}
    assert found[1, "b"].n_words == [1] and found[1, "c"].n_words == []
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.doc_id is None for r in packed) == 1 and max(r.piece for r in packed if r.doc_id == 1) > 100


def test_mix_writes_rows_in_the_order_of_the_schedule(spark):
    from kinloom.llm.mixing import mix_sources

    docs = spark.createDataFrame([(i, text_of(i, 30), "en", "aab"[i % 3], 1) for i in range(400)], SCHEMA).repartition(3)
    want = sorted((r.slot, r.position, r.doc_id) for r in mix_sources(docs.select("doc_id", "source"), C.WEIGHTS, C.BLOCK_DOCS).collect())
    assert [r.doc_id for r in C.mix(spark, docs, "").collect()] == [d for *_, d in want]


def test_bands_miss_no_pair_of_a_standard_table(spark):
    """All pairs of sf0.01's documents with the pipeline's parameters: links by brute force are within the components found."""
    import os

    import numpy as np

    from kinloom.llm.near_dup import near_duplicates

    path = os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text, 5) for r in docs.collect()}
    found = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    ids, holders = sorted(sets), {}
    for i in ids:
        for x in sets[i].tolist():
            holders.setdefault(x, []).append(i)
    common = {}
    for held in holders.values():
        for pair in itertools.combinations(held, 2):
            common[pair] = common.get(pair, 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) > 50 and np.mean([found[a] == found[b] for a, b in links]) == 1


def test_pack_takes_the_stored_order(spark):
    """What mix wrote is what pack lays out: rows written in another order are packed in that order."""
    from kinloom.llm.common import stored

    docs = spark.createDataFrame([(i, text_of(i, 150), "en", "ab"[i % 2], 1) for i in range(300)], SCHEMA).repartition(3)
    assert C.stored_order(docs) is None
    for stage in (lambda d: C.mix(spark, d, ""), lambda d: d.orderBy(C.F.desc("doc_id"))):
        held = stored(stage(docs), "held")
        want = [r.doc_id for r in held.select("doc_id", C.stored_order(held).alias("o")).orderBy("o").collect()]
        assert want == [r.doc_id for r in stage(docs).collect()]
        rank, first = {d: k for k, d in enumerate(want)}, {}
        for r in C.packing(spark, held, "").collect():
            first[r.sequence_id] = min(first.get(r.sequence_id, 10**9), rank[r.doc_id])
        assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_near_duplicates_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, text_of(1, 60), "en", "s", 1, "x"), (2, text_of(1, 60), "en", "s", 1, "y")], SCHEMA + ", __id string").withColumn("__kept", C.F.lit(1))
    assert [tuple(r)[:1] + tuple(r)[-2:] for r in C.near_duplicate(spark, docs, "").collect()] == [(1, "x", 1)]
