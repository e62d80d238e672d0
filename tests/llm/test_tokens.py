import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinloom.llm.packing import pack, plan
from kinloom.llm.tokens import Encoder
from kinloom.llm.wavelet import WaveletShard, pack_shard, read_tokens, write_tokens

NAMES = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}
ENCODERS = {k: Encoder(public_tokenizers.path(v), k, 2) for k, v in NAMES.items()}
PLAIN = {k: Tokenizer.from_file(public_tokenizers.path(v)) for k, v in NAMES.items()}
for _t in PLAIN.values():
    _t.encode_special_tokens = True
TEXTS = ["", None, " ", "  a", "a  b", "a \n b\n", "x\n\n y", "don't stop'll", "Éá İx", "<|endoftext|> a", "a\x1cb c", "a\x85b", "1 234  ", "\t\ta b", "a" * 300 + " b", "汉字 かな 　x", "́ a ́"]
DOCS = "doc_id long, text string, doc long, start string"


def plain(kind, text):
    return [*PLAIN[kind].encode(text or "", add_special_tokens=False).ids, 2]


def encoded(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("kind", NAMES)
def test_pieces_encode_as_whole_texts(kind):
    for text, ids in zip(TEXTS, encoded(ENCODERS[kind], TEXTS), strict=True):
        assert ids == plain(kind, text), text


@pytest.mark.parametrize("kind", NAMES)
def test_small_memos_and_latin_letters(kind):
    small = Encoder(public_tokenizers.path(NAMES[kind]), kind, 2, memo=3, units=5)
    letters = [f"{chr(c)}a{chr(c)} 1{chr(c)}\n {chr(c)}'s B{chr(c + 1)}." for c in range(0x21, 0x24F)]
    for at in range(0, len(letters), 40):
        for text, ids in zip(letters[at : at + 40], encoded(small, letters[at : at + 40]), strict=True):
            assert ids == plain(kind, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'sE1.é́　 \n\t\x1f\x85ſß 漢"), max_size=30))
def test_pieces_encode_as_whole_texts_generated(text):
    for kind in NAMES:
        texts = [text, None, "a " + text, text + " b", text + "\n"]
        assert encoded(ENCODERS[kind], texts) == [plain(kind, t) for t in texts]


@pytest.mark.parametrize("size", [0, 1, 5, 70_000])
def test_wavelet_lookups(size):
    rng = np.random.default_rng(size)
    ids = np.concatenate([rng.zipf(1.3, size) % 50_000, [2]]).astype("<u4")
    data = pack_shard(ids, [None, 7], np.array([size, 1]))
    shard = WaveletShard(lambda n, at: data[at : at + n])
    assert (shard.decode() == ids).all() and shard.doc_ids == [None, 7]
    for i in rng.integers(0, len(ids), 12).tolist():
        token = int(ids[i])
        where = np.flatnonzero(ids == token)
        assert shard.access(i) == token and shard.count(token) == len(where)
        assert shard.rank(token, i) == int((where < i).sum())
        assert shard.select(token, int((where < i).sum())) == i
    assert shard.count(65_000) == 0
    with pytest.raises(IndexError):
        shard.select(65_000, 0)


def cases(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "again", 0, None), (3, "again", 0, None), (None, "nobody", None, None), (40, "many words " * 900, 1, "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_token_files_round_trip(spark):
    docs = cases(spark)
    found = read_tokens(write_tokens(docs, public_tokenizers.path(NAMES["words"]), "words", 2, shard_tokens=50))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id, plain("words", r.text)) for r in docs.collect())
    want, at = [], 0
    for _, key, ids in rows:
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want


def test_token_files_of_nothing(spark):
    found = read_tokens(write_tokens(cases(spark).limit(0), public_tokenizers.path(NAMES["words"]), "words", 2))
    assert found.count() == 0


def check_packing(docs, found, capacity):
    rows, want = found.collect(), []
    for d in docs.collect():
        ids = plain("bytes", d.text)
        first = (len(ids) - 1) % capacity + 1
        ends = [first, *range(first + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want.append((d.doc_id is None, d.doc_id or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    docs = cases(spark)
    path = public_tokenizers.path(NAMES["bytes"])
    n = check_packing(docs, pack(docs, path, capacity=64), 64)
    total = sum(len(plain("bytes", r.text)) for r in docs.collect())
    assert n <= -(-total // 64) + 1
    assert pack(docs.limit(0), path).count() == 0
    hot = docs.sparkSession.range(500).selectExpr("id doc_id", "'one two' text")
    assert check_packing(hot, pack(hot, path, capacity=64), 64) == -(-500 // (64 // 3))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.just(40))
def test_plan_places_each_piece_once(counts, capacity):
    used, seen = {}, {}
    for r in plan(counts, capacity):
        for k in range(r.n):
            assert (r.length, r.first + k) not in seen
            seen[r.length, r.first + k] = True
            used.setdefault(r.bin + k // r.per_bin, []).append((r.base + k % r.per_bin * r.length, r.length))
    assert len(seen) == sum(counts.values())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) <= 11 / 9 * first_fit(counts, capacity) + 1


def first_fit(counts, capacity):
    """Bins that first-fit decreasing takes."""
    bins = []
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        for i, free in enumerate(bins):
            if free >= k:
                bins[i] -= k
                break
        else:
            bins.append(capacity - k)
    return len(bins)
