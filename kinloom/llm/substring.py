"""Substring deduplication by difference-cover anchors.

A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id.

Windows are far too many to shuffle, so matches are found by shorter anchors first. With a period v and a difference cover D of v
(every residue is a difference of two members), any two positions i and j have a shift below v that takes both into D modulo v; an
anchor of window - v + 1 words at that shift lies inside both windows. So only anchors at cover positions are hashed and
compared (3 of 7 for 13 words), any match shares an aligned one, and from shared anchors the match is extended to the whole windows
around them, which are compared next by two independent hashes, 128 bits together; anchors by 64 bits, as a false one only costs a window.

1. Documents are packed into blocks of neighbouring rows and written to a table bucketed by block, so the later steps read them without a shuffle.
2. Each block sends each distinct anchor once, with its smallest and largest document, to the anchor's cell, a range of hashes. A
   passage in a third of all documents costs one record a block. Cells number with the data, about ``cell_bytes`` of text each, and a block sends rows only to cells it
   has records for: so rows never outnumber records, and a cell stays as large as it is, however large the table.
3. A task streams its cells one after the other, and answers each block with two bits a record: whether a smaller document elsewhere has the anchor, and whether a
   larger has.
4. Windows around shared anchors are sent and answered alike; each block then removes the covered words.

The result reads the blocks' table; store it within until_stored(), which drops that table at its end.

Defined cases: null and empty texts have no words. Null doc_ids count as larger than all others. Rows with equal
doc_ids do not remove each other's words. A very long text makes a block of its own. An empty table gives an empty result. Other columns pass through unchanged, save
those named n_words or n_removed, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hashes_of, partitions, split_words
from .near_dup import MIX, U64, rolled

NO_ID = np.iinfo(np.int64).max
CELLS_A_TASK = 16
SENT = "cell long, block long, hashes binary, more binary, low binary, high_at binary, high binary, ids binary"
SENT_SCHEMA = pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (x.split() for x in SENT.split(", "))])
ANSWER = "block long, cell long, smaller binary, larger binary, n long"


def difference_cover(v: int) -> list[int]:
    """A small set whose differences modulo v are all residues, found greedily."""
    cover, have = [0], {0}
    while len(have) < v:
        gain = lambda c: len({(c - d) % v for d in cover} | {(d - c) % v for d in cover} | have)
        cover.append(max((c for c in range(v) if c not in cover), key=lambda c: (gain(c), -c)))
        have = {(a - b) % v for a in cover for b in cover}
    return sorted(cover)


def grouped(hashes: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (hash, more), and which of them begin a new value."""
    order = np.argsort(hashes)
    near = hashes[order]
    new = np.ones(len(near), bool)
    np.not_equal(near[1:], near[:-1], out=new[1:])
    if more is not None:
        like = np.flatnonzero(~new)
        if (more[order[like]] != more[order[like - 1]]).any():
            order = np.lexsort((more, hashes))
            near, also = hashes[order], more[order]
            new[1:] = (near[1:] != near[:-1]) | (also[1:] != also[:-1])
    return order, new


class Block:
    """The words of a block's documents in one line, and what anchors and windows say about them."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int) -> None:
        words = split_words(texts)
        self.words, self.begin = words.values, words.offsets.to_numpy().astype(np.int64)
        self.window, self.period = window, (window + 1) // 2
        self.n_words = np.diff(self.begin)
        self.hashes = hashes_of(self.words)
        self.ids, self.order = np.unique(pc.fill_null(ids, NO_ID).to_numpy(), return_inverse=True)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.local = np.arange(len(self.doc)) - self.begin[self.doc]
        self.left = self.n_words[self.doc] - self.local  # words from here to the document's end
        self.rank = self.order[self.doc]

    def anchors(self) -> None:
        """Positions of anchors, their distinct hashes, and each hash's first and last document."""
        width = self.window - self.period + 1
        covered = np.zeros(self.period, bool)
        covered[difference_cover(self.period)] = True
        at = np.flatnonzero(covered[self.local % self.period] & (self.left >= width) & (self.n_words[self.doc] >= self.window))
        self.anchor_at = at
        self.anchor, _, self.anchor_of, self.anchor_low, self.anchor_high = self._distinct(rolled(self.hashes, width)[at], None, at)

    def _distinct(self, hashes: np.ndarray, more: np.ndarray | None, at: np.ndarray) -> tuple:
        order, new = grouped(hashes, more)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        starts, rank = np.flatnonzero(new), self.rank[at][order]
        low, high = (f.reduceat(rank, starts) if len(rank) else rank for f in (np.minimum, np.maximum))
        first = order[starts]
        return hashes[first], None if more is None else more[first], of, low, high

    def windows(self, smaller: np.ndarray, larger: np.ndarray) -> None:
        """Windows around anchors that another document has, by the answers of the anchors' buckets."""
        rank = self.rank[self.anchor_at]
        shared = (rank > self.anchor_low[self.anchor_of]) | smaller[self.anchor_of] | (rank < self.anchor_high[self.anchor_of]) | larger[self.anchor_of]
        hit = self.anchor_at[shared]
        mark = np.zeros(len(self.doc), bool)
        for shift in range(self.period):
            mark[hit[self.local[hit] >= shift] - shift] = True
        at = np.flatnonzero(mark & (self.left >= self.window))
        self.window_at = at
        first, second = rolled(self.hashes, self.window)[at], rolled(self.hashes, self.window, MIX[1])[at]
        self.windows_, self.windows_more, self.window_of, self.window_low, _ = self._distinct(first, second, at)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words go."""
        gone = self.window_at[(self.rank[self.window_at] > self.window_low[self.window_of]) | smaller[self.window_of]]
        steps = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def _send(block: int, ids: np.ndarray, hashes: np.ndarray, more: np.ndarray | None, low: np.ndarray, high: np.ndarray, cells: int) -> pd.DataFrame:
    """Sorted distinct hashes, dealt out by their leading bits; the documents as places in the row's own list of ids.

    ``high`` is sent only where it differs from ``low``.
    """
    cell = ((hashes >> U64(32)) * U64(cells) >> U64(32)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    rows = []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist(), strict=len(starts) > 0):
        used, places = np.unique(np.concatenate([low[a:b], high[a:b]]), return_inverse=True)
        small = np.uint16 if len(used) < 1 << 16 else np.uint32
        first, last = places[: b - a].astype(small), places[b - a :].astype(small)
        differ = np.flatnonzero(first != last).astype(np.uint32)
        rows.append((int(cell[a]), block, hashes[a:b].tobytes(), b"" if more is None else more[a:b].tobytes(), first.tobytes(), differ.tobytes(), last[differ].tobytes(), ids[used].tobytes()))
    return pd.DataFrame(rows, columns=SENT_SCHEMA.names)


def answer(rows: list) -> pd.DataFrame:
    """For each record of a cell's rows: is a smaller, is a larger document known to another row of the cell?"""
    hashes, mores, lows, highs, sizes = [], [], [], [], []
    for row in rows:
        h, ids = np.frombuffer(row.hashes, U64), np.frombuffer(row.ids, np.int64)
        small = np.uint16 if len(ids) < 1 << 16 else np.uint32
        first = np.frombuffer(row.low, small)
        last = first.copy()
        last[np.frombuffer(row.high_at, np.uint32)] = np.frombuffer(row.high, small)
        hashes.append(h)
        mores.append(np.frombuffer(row.more, U64))
        lows.append(ids[first])
        highs.append(ids[last])
        sizes.append(len(h))
    h, more, low, high = (np.concatenate(x) for x in (hashes, mores, lows, highs))
    order, new = grouped(h, more if len(more) else None)
    starts, group_of = np.flatnonzero(new), np.empty(len(h), np.int64)
    group_of[order] = np.cumsum(new) - 1
    smaller = np.minimum.reduceat(low[order], starts)[group_of] < low
    larger = np.maximum.reduceat(high[order], starts)[group_of] > high
    ends = np.cumsum(sizes)
    cut = lambda bits: [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pd.DataFrame({"block": [r.block for r in rows], "cell": [r.cell for r in rows], "smaller": cut(smaller), "larger": cut(larger), "n": sizes})


def answers_of_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers cell by cell; rows come sorted by cell."""
    held: list = []
    for batch in batches:
        for row in batch.itertuples():
            if held and row.cell != held[0].cell:
                yield answer(held)
                held = []
            held.append(row)
    if held:
        yield answer(held)


def _bits(answers: list | np.ndarray | None, field: str) -> np.ndarray:
    """The answers of all cells in order."""
    rows = sorted((a for a in ([] if answers is None else answers)), key=lambda a: a["cell"])
    parts = [np.unpackbits(np.frombuffer(a[field], np.uint8), count=a["n"]).view(bool) for a in rows]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, block_docs: int) -> DataFrame:
    """block, ids, texts, rest (the other columns)."""
    rest = [c for c in docs.columns if c not in {id_col, text_col, "n_words", "n_removed"}]
    other = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("_"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), other.alias("rest"))
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(picked.schema[c].dataType)) for n, c in (("ids", "id"), ("texts", "text"), ("rest", "rest"))]])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.nan_to_num(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)))
            edges = [0]
            while edges[-1] < batch.num_rows:
                a = edges[-1]
                before = size[a - 1] if a else 0
                b = int(np.searchsorted(size, before + block_bytes, "right"))
                edges.append(min(max(b, a + 1), a + block_docs, batch.num_rows))
            keys = pa.array([uuid.uuid4().int >> 65 for _ in edges[1:]], pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch[c]) for c in ("id", "text", "rest")]
            yield pa.RecordBatch.from_arrays([keys, *lists], names=["block", "ids", "texts", "rest"])

    return picked.mapInArrow(packed, schema)


def _answers(sent: DataFrame, what: str, cells: int, scratch: Scratch) -> DataFrame:
    """Stored answers, one row a block. A task takes some cells, CELLS_A_TASK or fewer; it holds one at a time."""
    width = max(partitions(sent.sparkSession), -(-cells // CELLS_A_TASK))
    dealt = sent.repartition(width, "cell").sortWithinPartitions("cell")
    found = scratch.stored(dealt.mapInPandas(answers_of_cells, ANSWER), what)
    return found.groupBy("block").agg(F.collect_list(F.struct("cell", "smaller", "larger", "n")).alias(what))


def dedup_substrings(
    docs: DataFrame,
    window: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    rejoin: bool = False,
    block_bytes: int = 4 << 20,
    block_docs: int = 4096,
    cell_bytes: int = 16 << 20,
) -> DataFrame:
    """The documents with their repeated words removed, and n_words and n_removed.

    A text that lost words is its kept words joined by single spaces; other texts stay as they are, or with rejoin=True
    are joined alike.
    """
    if window < 3:
        raise ValueError("a window needs three words at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    scratch.later()
    blocks = scratch.bucketed(pack_blocks(docs, id_col, text_col, block_bytes, block_docs), "blocks", "block")
    size = blocks.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.octet_length(t), F.lit(0))))).first()[0] or 0
    cells = max(partitions(spark), -(-size // cell_bytes))

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each row with its block, its anchors found."""
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch["ids"][i].values, batch["texts"][i].values, window)
                b.anchors()
                yield {name: batch[name][i] for name in batch.schema.names}, b

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in blocks_of(batches):
            sent = _send(row["block"].as_py(), b.ids, b.anchor, None, b.anchor_low, b.anchor_high, cells)
            yield pa.RecordBatch.from_pandas(sent, SENT_SCHEMA, preserve_index=False)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in blocks_of(batches):
            found = row["anchors"].as_py()
            b.windows(_bits(found, "smaller"), _bits(found, "larger"))
            sent = _send(row["block"].as_py(), b.ids, b.windows_, b.windows_more, b.window_low, b.window_low, cells)
            yield pa.RecordBatch.from_pandas(sent, SENT_SCHEMA, preserve_index=False)

    anchors = _answers(blocks.select("block", "ids", "texts").mapInArrow(send_anchors, SENT), "anchors", cells, scratch)
    joined = blocks.join(anchors, "block", "left")
    windows = _answers(joined.select("block", "ids", "texts", "anchors").mapInArrow(send_windows, SENT), "windows", cells, scratch)
    rest_type = blocks.schema["rest"].dataType.elementType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("rest", rest_type)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in blocks_of(batches):
            found = row["anchors"].as_py()
            b.windows(_bits(found, "smaller"), _bits(found, "larger"))
            keep = ~b.removed(_bits(row["windows"].as_py(), "smaller"))
            kept = np.concatenate([[0], np.cumsum(keep)])[b.begin]
            lost = b.n_words - np.diff(kept)
            texts = row["texts"].values
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), b.words.filter(pa.array(keep))), " ")
            texts = pc.if_else(pa.array((lost > 0) | rejoin), joined, texts)
            columns = [row["ids"].values, texts, pa.array(b.n_words), pa.array(lost), row["rest"].values]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_words", "n_removed", "rest"])

    full = joined.join(windows, "block", "left").select("ids", "texts", "anchors", "windows", "rest")
    out = full.mapInArrow(remove, schema)
    names = [c for c in docs.columns if c not in {"n_words", "n_removed"}]
    pick = {id_col: F.col("id"), text_col: F.col("text")}
    return out.select(*[pick[c].alias(c) if c in pick else F.col("rest")[c].alias(c) for c in names], "n_words", "n_removed")
