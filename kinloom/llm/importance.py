"""Importance resampling towards a target text collection, on hashed n-grams.

A document's features are its runs of 1 to ``n`` words, and a feature's bucket is the CRC-32 of the words joined by one space, modulo ``buckets``. No n-gram is ever put
together: each distinct word of a batch has its CRC computed once, and that of a longer run follows from those of its parts,

    crc(A + B) = shift(crc(A), length of B) xor crc(B),

where shift by so many zero bytes is a linear map over GF(2). The maps for lengths below 64 are tables; longer ones are products of the maps for powers of two.

1. A pass over the documents and one over the target count features by bucket, within tasks first: a task sends at most ``buckets`` rows.
2. A bucket's gain is the floor of 1000 times the logarithm of the ratio of its smoothed shares. The gains (``buckets`` numbers, whatever the data's size) go to all tasks.
3. A second pass adds up each document's gains; a Gumbel term from the hash of its id makes the highest scores a sample without replacement, by weight.
4. The documents of at least ``least_words`` words are numbered in the order of scores: ranges of scores are sorted apart, behind the numbers of rows in the ranges before.

Defined cases: null and empty texts have no features, weight 0. Texts are worked through whole, in slices at document ends. Equal scores go to the smaller doc_id; a null id counts as an
empty string in the hash and comes last; rows with one id and score are ordered by n_features. An empty target is smoothed like any other; an empty table gives
an empty result. Other columns of the table are not used, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, slices_of, stored

POLYNOMIAL = 0xEDB88320
SMALL = 64
#: Lower-case letters, digits and all bytes of characters beyond ASCII are in words.
IN_WORD = np.array([b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _applied(columns: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A 32 by 32 matrix over GF(2), given by its columns, times vectors of bits."""
    out = np.zeros_like(vector)
    for bit in range(32):
        out ^= np.where(vector >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0)).astype(np.uint32)
    return out


def _table(columns: np.ndarray) -> np.ndarray:
    """The matrix as four tables, one for each byte of the vector."""
    return np.array([_applied(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)], np.uint32)


def _powers() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts by 0 to SMALL - 1 bytes, and by SMALL times powers of two."""
    bit = np.array([POLYNOMIAL] + [1 << (k - 1) for k in range(1, 32)], np.uint32)  # one zero bit
    byte = bit
    for _ in range(3):
        byte = _applied(byte, byte)
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    small = [unit]
    for _ in range(SMALL):
        small.append(_applied(byte, small[-1]))
    large, m = [], small[SMALL]
    for _ in range(26):
        large.append(_table(m))
        m = _applied(m, m)
    return np.array([_table(x) for x in small[:SMALL]]), large


SHIFTS, LONG_SHIFTS = _powers()
_FLAT = SHIFTS.ravel()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved past so many bytes."""
    at = (length & (SMALL - 1)) << 10
    out = _FLAT[at + (crc & np.uint32(255))]
    for k in range(1, 4):
        out ^= _FLAT[at + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(255))]
    rest = length >> 6
    for table in LONG_SHIFTS if rest.any() else ():
        some = np.flatnonzero(rest & 1)
        c = out[some]
        out[some] = table[0][c & np.uint32(255)] ^ table[1][c >> np.uint32(8) & np.uint32(255)] ^ table[2][c >> np.uint32(16) & np.uint32(255)] ^ table[3][c >> np.uint32(24)]
        rest = rest >> 1
        if not rest.any():
            break
    return out


def combined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """The CRC of two strings on end, from their own."""
    return shifted(first, second_length) ^ second


def word_bytes(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a line, lower-cased; where each text's words begin, and the end)."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = filled.buffers()[2]
    data = LOWER[np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]] if held and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    begins[first] = inside[first]  # words end with their text
    starts = np.flatnonzero(begins)
    kept = np.append(0, np.cumsum(inside))
    offsets = np.append(kept[starts], kept[-1]).astype(np.int64)
    letters = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    return words, np.searchsorted(starts, ends)


def features(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text; for each length up to n, the buckets of all texts' runs in a line and where each text's begin, and the end)."""
    words, begin = word_bytes(texts)
    coded = words.dictionary_encode()
    crcs = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    word = crcs[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint32)
    length = np.diff(np.frombuffer(words.buffers()[1], np.int64))[: len(word)]
    n_words = np.diff(begin)
    left = np.repeat(begin[1:], n_words) - np.arange(len(word))  # words from here to the text's end
    run, out = word, [(word.astype(np.int64) % buckets, begin)]
    space = np.uint32(zlib.crc32(b" "))
    for size in range(2, n + 1):
        ahead = run[: max(0, len(word) - size + 1)]
        run = combined(shifted(ahead, np.ones(len(ahead), np.int64)) ^ space, word[size - 1 :], length[size - 1 :]) if len(ahead) else ahead
        whole = left[: len(run)] >= size
        out.append((run[whole].astype(np.int64) % buckets, np.append(0, np.cumsum(np.maximum(n_words - size + 1, 0)))))
    return n_words, out


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all rows of the one column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in slices_of(batch.column(0)):
                for found, _ in features(part, n, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket: ``buckets`` rows reach the driver."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    one = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in one:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices_of(batch["text"]):
                n_words, lengths = features(part, n, len(gains))
                count, weight = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for found, begin in lengths:
                    count += np.diff(begin)
                    weight += np.diff(np.append(0, np.cumsum(gains[found]))[begin])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(part)), pa.array(n_words), pa.array(count), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = 3, buckets: int = 10_000, percent: int = 5, seed: int = 42, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank: 1, 2, 3 ... for the drawn ``percent`` of the documents of at least ``least_words`` words, else null."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    column = lambda df, c: df.select(F.col(c).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(column(docs, text_col), n, buckets), bucket_counts(column(target, target_text), n, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = scratch.stored(weigh(docs, gains, n, id_col, text_col).withColumn("score", F.col("weight") + gumbel), "scored")
    eligible = F.col("n_words") >= least_words
    draw = scored.where(eligible).count() * percent // 100
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    # short rows: numbers only
    ranged = scratch.stored(scored.where(eligible).repartitionByRange(partitions(spark), *keys).withColumn("range", F.spark_partition_id()), "ranged")
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("range").agg(F.count("*").alias("rows")).select("range", before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    ranked = ranged.join(F.broadcast(starts), "range").withColumn("place", place)  # one short row a range is broadcast
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~eligible).select(*names, F.lit(None).cast("long").alias("rank"))
    out = stored(ranked.select(*names, F.when(F.col("place") <= draw, F.col("place")).alias("rank")).unionByName(rest), "resampled")
    scratch.clear()
    return out
