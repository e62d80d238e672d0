"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Only a document longer than a sequence is cut, into full pieces; its first piece takes the remainder. Pieces above a
third of the capacity can share a bin with at most one other such piece: they are matched greedily, longest first, each
with the longest that fits. Shorter pieces, longest first, go into the smallest gap that holds them.

Both rules depend on lengths alone, so they are run on the histogram of lengths (at most ``capacity`` rows, however
many documents): runs of equal pieces go to runs of equal bins. Spark then ranks the pieces within their length, in salted groups
whose number follows each length's count, and looks each rank up in the plan.

With an order column, pieces of a length are ranked by it, in ranges of the order instead of salted groups, and sequences are numbered by
the first piece, in that order, that they hold.

Defined cases: a null or empty text is its end id alone. Null ids are kept. Repeated rows are packed each. Very long texts are encoded whole and cut. An empty table
gives an empty result. Other columns are not carried, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices_of, stored
from .tokens import encoder


class Run(NamedTuple):
    """Pieces of one length, by rank from ``first``, ``per_bin`` in each bin from ``bin``, at offset ``base``."""

    length: int
    first: int
    n: int
    bin: int
    per_bin: int
    base: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of each length go."""
    runs: list[Run] = []
    done = dict.fromkeys(counts, 0)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, n: int, first_bin: int, per_bin: int, base: int) -> None:
        runs.append(Run(length, done[length], n, first_bin, per_bin, base))
        done[length] += n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first_bin, n))

    left = {k: n for k, n in counts.items() if 3 * k > capacity and n}
    for a in sorted(left, reverse=True):
        while left[a]:
            fits = [b for b in left if b <= capacity - a and left[b] - (a == b) > 0]
            b = max(fits, default=None)
            if b is None:
                n = left[a]
                put(a, n, bins, 1, 0)
                left[a] = 0
            elif b == a:
                n = left[a] // 2
                put(a, 2 * n, bins, 2, 0)
                left[a] -= 2 * n
            else:
                n = min(left[a], left[b])
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
                left[a] -= n
                left[b] -= n
            leave(capacity - a - (b or 0), bins, n)
            bins += n
    for s in sorted((k for k, n in counts.items() if 3 * k <= capacity and n), reverse=True):
        n = counts[s]

        def fill(first_bin: int, room: int, gap: int) -> int:
            """Fills bins with the same gap; returns how many it used."""
            nonlocal n
            per = gap // s
            full = min(room, n // per)
            if full:
                put(s, full * per, first_bin, per, capacity - gap)
                leave(gap - per * s, first_bin, full)
                n -= full * per
            if full < room and 0 < n < per:
                put(s, n, first_bin + full, n, capacity - gap)
                leave(gap - n * s, first_bin + full, 1)
                full, n = full + 1, 0
            return full

        for gap in sorted(g for g in gaps if g >= s):
            if not n:
                break
            for first_bin, room in gaps.pop(gap):
                used = fill(first_bin, room, gap) if n else 0
                if used < room:
                    leave(gap, first_bin + used, room - used)
        if n:
            bins += fill(bins, -(-n // (capacity // s)), capacity)
    return runs


def tokenize_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, lasting: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the columns of keep: the cut documents.

    Without ``lasting`` the memos of the encoder are emptied at the end of each task, so that a worker that waits for other stages' tasks holds none of their memory.
    """
    keep = keep or {}
    carried = list(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(tokenizer, kind, end_id)
        try:
            yield from pieces_of(batches, held.encode)
        finally:
            if not lasting:
                held.rest()

    def pieces_of(batches: Iterator[pa.RecordBatch], encode: Callable) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices_of(batch["text"]):
                ids, sizes = encode(texts)
                pieces = -(-sizes // capacity)
                of = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                end = sizes[of] - (pieces[of] - 1 - piece) * capacity  # only the first piece may be shorter
                start = np.maximum(end - capacity, 0)
                begins = (np.cumsum(sizes) - sizes)[of]
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begins + start).tolist(), (begins + end).tolist(), strict=True)]
                rows = pa.array(of + first)
                columns = [batch["id"].take(rows), piece.astype(np.int32), start, end - start, np.array(crcs, np.int64)]
                columns = [pa.array(c) for c in columns] + [batch[f"__{c}"].take(rows) for c in carried]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *carried])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[v.alias(f"__{k}") for k, v in keep.items()])
    kept = "".join(f", {k} {picked.schema[f'__{k}'].dataType.simpleString()}" for k in keep)
    return picked.mapInArrow(cut, f"doc_id long, piece int, start long, length long, ids_crc32 long{kept}")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (doc_id, piece, start, length, ...); by their column order, if they have one, which is then dropped."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs = [tuple(map(int, r)) for r in plan(counts, capacity)]
    by_order = ["order"] if "order" in pieces.columns else []
    largest = max(1, sum(counts.values()) // (4 * partitions(spark)))
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // largest)) for k, n in counts.items()], "length long, salts long"))
    if by_order:
        salted = _ranged(pieces, ["order", "doc_id", "piece"], "salt")
    else:
        salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*by_order, "doc_id", "piece")) - 1
    ranked = salted.withColumn("within", within).join(groups, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    table = F.broadcast(spark.createDataFrame(runs, "r_length long, first long, n long, bin long, per_bin long, base long"))
    on = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    at = F.col("rank") - F.col("first")
    found = ranked.join(table, on)
    bin_ = F.col("bin") + F.floor(at / F.col("per_bin")).cast("long")
    placed = found.select(*pieces.columns, bin_.alias("sequence_id"), (F.col("base") + at % F.col("per_bin") * F.col("length")).alias("offset"))
    return _in_order(stored(placed, "placed")) if by_order else placed


def _ranged(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Stored rows with the number of their range of the keys; ranges are about equally large."""
    return stored(df.repartitionByRange(4 * partitions(df.sparkSession), *keys).withColumn(name, F.spark_partition_id()), "ranged")


def _in_order(placed: DataFrame) -> DataFrame:
    """Sequences numbered by their first piece in the order."""
    firsts = placed.groupBy("sequence_id").agg(F.min(F.struct("order", "piece", "doc_id")).alias("first")).select("sequence_id", "first.*")
    ranged = _ranged(firsts, ["order", "piece", "doc_id", "sequence_id"], "range")
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = F.broadcast(ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before")))
    within = F.row_number().over(Window.partitionBy("range").orderBy("order", "piece", "doc_id", "sequence_id")) - 1
    numbers = ranged.withColumn("within", within).join(starts, "range").select("sequence_id", (F.col("before") + F.col("within")).alias("number"))
    return placed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number")).select(*[c for c in placed.columns if c != "order"])


def pack(docs: DataFrame, tokenizer: str, kind: str = "bytes", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenize_pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col), "pieces")
    return place(pieces, capacity)
