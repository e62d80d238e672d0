"""Suffix-array deduplication by a distributed merge sort that knows common prefixes.

A byte goes if it lies in a string of ``window`` bytes that also starts anywhere else, in its own document or in another.

1. Documents are packed into blocks. Of all suffixes only sampled ones are sorted: those at the least hash of ``anchor`` bytes (half a window) among the anchors of
   some window. A window's own bytes settle which one that is, so equal windows have it at the same offset; about 2 positions of 100 are sampled.
   Anchors that occur once in the whole table are left out by a count on Spark.
2. A block makes one sorted run of its sampled suffixes, each cut to one window, with the bytes to its left behind it; equal ones are one record. The order of all runs is (hash of the
   anchor, suffix, left side). Runs are front-coded, cut into cells (ranges of that order, which number with the data) and exchanged.
3. A task merges a cell's runs by a loser tree. Each entry carries its common prefix with the last winner; unequal prefixes settle a match without a
   look at the strings, equal ones are compared from there on, so known prefixes are never compared again. The tree gives the common prefix of neighbours too.
   More runs than ``fan_in`` are merged in rounds: groups of runs first, equal records becoming one, then the groups' runs.
4. From common prefixes of neighbours, to the right in merged order and to the left in the order of left sides, follows for each sampled suffix and each window
   around it whether an equal window exists. One bit a window goes back to the block, which removes the covered bytes.

An anchor with more than ``hot`` different surroundings (a line found in a third of all documents) does not make one large group: its windows are records of
their own, dealt out by the window's hash. Equal records of a block are one, so thousands of copies cost a record a block.

Defined cases: a null text is empty; texts shorter than a window keep all. Null and repeated doc_ids are documents like others: rows are judged, not ids. A very long
text makes a block of its own. An empty table gives an empty result. Other columns pass through, save those named like a result column, which are replaced. The kept
bytes are binary, as a removed run may begin or end inside a character.

The result reads the blocks' table; store it within until_stored(), which drops that table at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions
from .near_dup import MIX, U64, mix
from .substring import pack_blocks

#: Stands for what lies outside a document; no UTF-8 text has this byte.
OUTSIDE = 0xFF
KEY = 8
CELLS_A_TASK = 8
SLICE, ROWS = 2 << 20, 1 << 14
RUN = "cell long, run long, common binary, least binary, most binary, many binary, tails binary"
RUN_SCHEMA = pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in (x.split() for x in RUN.split(", "))])
ANSWER = "cell long, run long, bits binary"
BYTE = mix(np.arange(1, 257, dtype=U64) * MIX[0])
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")


def rolled_bytes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` bytes, put together from runs whose widths are powers of two."""
    base, size, have = int(MIX[0]), 1, 0
    part, total = BYTE[data], None
    while True:
        if width & size:
            rest = len(data) - have - size + 1
            if rest <= 0:
                return np.zeros(0, U64)
            total = part if total is None else total[:rest] * U64(pow(base, size, 1 << 64)) + part[have : have + rest]
            have += size
        if have == width:
            return mix(total)
        if len(part) <= size:
            return np.zeros(0, U64)
        part = part[:-size] * U64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Bytes:
    """The bytes of a block's documents in one line, and the sampled suffixes."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
        held = filled.buffers()[2] if len(filled) else None
        self.data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        self.begin = ends - ends[0]
        self.window, self.anchor = window, window // 2
        self.reach = window - self.anchor  # a window begins at most so far left of its sampled suffix
        self._sample()

    def _sample(self) -> None:
        """at: positions of sampled suffixes; first, last: the windows that each stands for; hashes: of their anchors."""
        long = np.flatnonzero(np.diff(self.begin) >= self.window)
        begins, stops = self.begin[long], self.begin[long + 1] - self.window + 1
        parts: list[tuple] = []
        for a in range(0, len(self.data), SLICE):
            b = min(a + SLICE, len(self.data))
            piece = self.data[a : b + self.window - 1]
            if len(piece) < self.window:
                break
            hashes = rolled_bytes(piece, self.anchor)
            # of equal hashes the leftmost counts
            least = sliding_least((hashes >> U64(32) << U64(32)) | np.arange(len(hashes), dtype=U64), self.reach + 1)
            inside = np.zeros(len(least) + 1, np.int8)
            i, j = np.searchsorted(stops, a, "right"), np.searchsorted(begins, b)
            lows, highs = np.maximum(begins[i:j] - a, 0), np.minimum(stops[i:j] - a, len(least))
            np.add.at(inside, lows, 1)
            np.add.at(inside, highs, -1)
            starts = np.flatnonzero(np.cumsum(inside[:-1]))
            at = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
            last = np.append(new[1:], len(at)) - 1
            parts.append((at[new] + a, starts[new] + a, starts[last] + a, hashes[at[new]]) if len(at) else (starts, starts, starts, hashes[:0]))
        self.at, self.first, self.last, self.hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
        twice = np.flatnonzero(self.at[1:] == self.at[:-1])  # a run that goes on in the next slice
        self.last[twice] = self.last[twice + 1]
        keep = np.ones(len(self.at), bool)
        keep[twice + 1] = False
        self.at, self.first, self.last, self.hashes = (x[keep] for x in (self.at, self.first, self.last, self.hashes))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, how often each occurs, and in how many different surroundings (by their hash)."""
        doc = np.searchsorted(self.begin, self.at, "right") - 1
        to_left, to_right = np.minimum(self.at - self.begin[doc], self.reach), np.minimum(self.begin[doc + 1] - self.at, self.window)
        # a sum over the bytes around stands for them; it only counts kinds, and decides no match
        ends = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[self.data], dtype=U64)])
        near = ends[self.at + to_right] - ends[self.at - to_left]
        shape = mix(self.hashes + mix(near) + (to_left * 1000 + to_right).astype(U64))
        order = np.lexsort((shape, self.hashes))
        h, s = self.hashes[order], shape[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        other = new | np.append(True, s[1:] != s[:-1])[: len(h)]
        starts = np.flatnonzero(new)
        return h[starts], np.diff(np.append(starts, len(h))), np.add.reduceat(other.astype(np.int64), starts) if len(starts) else starts

    def choose(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keeps the suffixes whose anchors are shared; those of hot anchors give way to their windows."""
        near = np.isin(self.hashes, shared)
        cold = np.flatnonzero(near & ~np.isin(self.hashes, hot))
        at, first, last, hashes = (x[cold] for x in (self.at, self.first, self.last, self.hashes))
        split = np.flatnonzero(near & np.isin(self.hashes, hot))
        sizes = self.last[split] - self.first[split] + 1
        windows = np.repeat(self.first[split] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        self.chosen = np.concatenate([at, windows])
        # sampled anchors have small hashes, so they are mixed anew to fill the cells evenly
        self.keys = np.concatenate([mix(hashes), np.zeros(len(windows), U64)])
        self.least = np.concatenate([at - last, np.zeros(len(windows), np.int64)]).astype(np.uint8)
        self.most = np.concatenate([at - first, np.zeros(len(windows), np.int64)]).astype(np.uint8)
        self.n_cold = len(at)

    def _records(self, a: int, b: int) -> np.ndarray:
        """Chosen suffixes a to b as rows of bytes: key, suffix, left side from right to left."""
        at = self.chosen[a:b]
        doc = np.searchsorted(self.begin, at, "right") - 1
        rows = np.full((len(at), KEY + self.window + self.reach), OUTSIDE, np.uint8)
        ahead = at[:, None] + np.arange(self.window)
        np.copyto(rows[:, KEY : KEY + self.window], self.data[np.minimum(ahead, len(self.data) - 1)], where=ahead < self.begin[doc + 1][:, None])
        cold = max(0, min(self.n_cold - a, len(at)))
        back = at[:cold, None] - 1 - np.arange(self.reach)
        np.copyto(rows[:cold, KEY + self.window :], self.data[np.maximum(back, 0)], where=back >= self.begin[doc[:cold]][:, None])
        keys = self.keys[a:b].copy()
        for i in range(self.window if cold < len(at) else 0):
            keys[cold:] = mix(keys[cold:] * MIX[1] + rows[cold:, KEY + i])
        rows[:, :KEY] = keys.astype(">u8").view(np.uint8).reshape(-1, KEY)
        return rows

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct records in order, the first occurrence of each, whether it has another one, and each chosen suffix's record."""
        width = KEY + self.window + self.reach
        rows, whose, count, at = [np.zeros(0, f"S{width}")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a in range(0, len(self.chosen), ROWS):
            found, first, of, n = np.unique(self._records(a, a + ROWS).view(f"S{width}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            at.append(of + sum(map(len, rows)))
            rows.append(found)
            whose.append(first + a)
            count.append(n)
        found, first, of = np.unique(np.concatenate(rows), return_index=True, return_inverse=True)
        self.record = of[np.concatenate(at)] if at else np.zeros(0, np.int64)
        many = np.bincount(of, np.concatenate(count), len(found)) > 1
        return np.frombuffer(found.tobytes(), np.uint8).reshape(-1, width), np.concatenate(whose)[first], many

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Which bytes go, from one row of bits a record: does the window that begins so far left of the suffix occur elsewhere?"""
        steps = np.zeros(len(self.data) + 1, np.int64)
        for a in range(0, len(self.chosen), ROWS):
            who, back = np.nonzero(bits[self.record[a : a + ROWS]])
            mine = (back >= self.least[a : a + ROWS][who]) & (back <= self.most[a : a + ROWS][who])
            starts = self.chosen[a : a + ROWS][who[mine]] - back[mine]
            np.add.at(steps, starts, 1)
            np.add.at(steps, starts + self.window, -1)
        return np.cumsum(steps[:-1]) > 0


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """For each row of a sorted table of bytes, how many bytes it begins with like the row before."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), ROWS):
        differ = rows[a : a + ROWS] != rows[a - 1 : a - 1 + len(rows[a : a + ROWS])]
        out[a : a + ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray, common: np.ndarray) -> bytes:
    """What each row does not share with the row before, one after the other."""
    return b"".join(rows[a : a + ROWS][np.arange(rows.shape[1]) >= common[a : a + ROWS, None]].tobytes() for a in range(0, len(rows), ROWS))


def decoded(common: np.ndarray, tails: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    at, row = 0, b""
    for c in common.tolist():
        row = row[:c] + tails[at : at + width - c]
        at += width - c
        yield c, row


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string); yields (run, common prefix with the last one yielded, string)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]) -> None:
        self.runs, self.size = runs, 1 << max(0, (len(runs) - 1).bit_length())
        self.common = [0] * self.size
        self.held: list[bytes | None] = [None] * self.size
        self.losers = [0] * self.size
        for r in range(len(runs)):
            self._next(r)

    def _next(self, r: int) -> None:
        self.common[r], self.held[r] = next(self.runs[r], (0, None))

    def _wins(self, a: int, b: int) -> bool:
        """Whether a comes before b; the loser's common prefix is then the one with the winner."""
        x, y = self.held[a], self.held[b]
        if x is None or y is None:
            return y is None
        c = self.common[a]
        if c != self.common[b]:
            return c > self.common[b]
        n = len(x)
        while c < n and x[c : c + 32] == y[c : c + 32]:
            c += 32
        if c >= n:
            first, c = a < b, n
        else:
            unlike = int.from_bytes(x[c : c + 32]) ^ int.from_bytes(y[c : c + 32])
            c += (len(x[c : c + 32]) * 8 - unlike.bit_length()) // 8
            first = x[c] < y[c]
        self.common[b if first else a] = c
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        winners = list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = (winners[2 * node - self.size] if 2 * node >= self.size else self.losers[2 * node]), (winners[2 * node + 1 - self.size] if 2 * node >= self.size else self.losers[2 * node + 1])
            self.losers[node] = a if self._wins(a, b) else b
        # the pass above left winners in the nodes; each node now keeps the other one
        best = self.losers[1] if self.size > 1 else 0
        ups = self.losers[:]
        for node in range(1, self.size):
            a, b = ((2 * node - self.size, 2 * node + 1 - self.size) if 2 * node >= self.size else (ups[2 * node], ups[2 * node + 1]))
            self.losers[node] = b if ups[node] == a else a
        while self.held[best] is not None:
            yield best, self.common[best], self.held[best]
            self._next(best)
            node = (best + self.size) >> 1
            while node:
                if not self._wins(best, self.losers[node]):
                    best, self.losers[node] = self.losers[node], best
                node >>= 1


class Merged:
    """The runs of one cell merged; equal records are one."""

    def __init__(self, rows: list, width: int) -> None:
        self.rows = rows
        commons = [np.frombuffer(r.common, np.uint16) for r in rows]
        run, common, strings = [], [], []
        for r, c, s in LoserTree([decoded(c, r.tails, width) for c, r in zip(commons, rows, strict=True)]):
            run.append(r)
            common.append(c)
            if c < width:
                strings.append(s)
        self.common = np.array(common, np.int64)
        of = np.cumsum(self.common < width) - 1
        order = np.argsort(np.array(run), kind="stable")
        self.records = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, width)
        self.common = self.common[self.common < width]
        #: Of each run's records in turn, the place among the merged ones.
        self.places = np.split(of[order], np.cumsum([len(c) for c in commons])[:-1])
        n = len(self.records)
        self.least, self.most, self.many = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.bincount(of, minlength=n) > 1
        for r, places in zip(rows, self.places, strict=True):
            self.least[places], self.most[places] = np.frombuffer(r.least, np.uint8), np.frombuffer(r.most, np.uint8)
            self.many[places] |= np.frombuffer(r.many, bool)

    def repeated(self, window: int) -> np.ndarray:
        """One row of packed bits a record: whether the window that begins so many bytes left of the suffix is found in another record, or in two occurrences of this one."""
        n, reach = len(self.records), window - window // 2
        left = np.ascontiguousarray(self.records[:, KEY + window :])
        order = np.argsort(left.view(f"S{reach}").ravel(), kind="stable")
        left_common = common_prefixes(left[order])
        right_common = self.common - KEY
        bits = np.zeros((n, reach + 1), bool)
        like_left = np.empty(n, np.int64)
        for back in range(reach + 1):
            mine = np.flatnonzero((self.least <= back) & (back <= self.most))
            if len(mine) < 2:
                continue
            like_left[order] = np.cumsum(left_common < back)
            like = np.cumsum(right_common < window - back)[mine] * (n + 1) + like_left[mine]
            _, of, count = np.unique(like, return_inverse=True, return_counts=True)
            bits[mine, back] = count[of] > 1
        return np.packbits(bits | self.many[:, None], axis=1)


def cells_of(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[list]:
    """Rows with equal keys; they come sorted by them."""
    held: list = []
    for batch in batches:
        for row in batch.itertuples():
            if held and any(getattr(row, k) != getattr(held[0], k) for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def resolve(runs: DataFrame, n_runs: int, window: int, cells: int, fan_in: int, scratch: Scratch) -> DataFrame:
    """ANSWER rows: for each run's records in a cell, the packed bits of Merged.repeated()."""
    width = KEY + window + window - window // 2
    size = (window - window // 2 + 8) // 8
    parts = max(partitions(runs.sparkSession), -(-cells // CELLS_A_TASK))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in cells_of(batches, "cell"):
            merged = Merged(rows, width)
            bits = merged.repeated(window)
            yield pd.DataFrame({"cell": rows[0].cell, "run": [r.run for r in rows], "bits": [bits[p].tobytes() for p in merged.places]})

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in cells_of(batches, "cell", "group"):
            m = Merged(rows, width)
            head = {"common": m.common.astype(np.uint16).tobytes(), "least": m.least.tobytes(), "most": m.most.tobytes(), "many": m.many.tobytes(), "tails": front_coded(m.records, m.common), "places": None}
            none = dict.fromkeys(("common", "least", "most", "many", "tails"))
            out = pd.DataFrame([head, *[none | {"places": p.astype(np.uint32).tobytes()} for p in m.places]])
            yield out.assign(cell=rows[0].cell, group=rows[0].group, run=pd.array([None, *[r.run for r in rows]], "Int64"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [np.frombuffer(r.bits, np.uint8).reshape(-1, size)[np.frombuffer(r.places, np.uint32)].tobytes() for r in batch.itertuples()]
            yield batch[["cell", "run"]].assign(bits=bits)

    if n_runs <= fan_in:
        return scratch.stored(runs.repartition(parts, "cell").sortWithinPartitions("cell").mapInPandas(answer, ANSWER), "answers")
    groups = -(-n_runs // fan_in)
    dealt = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups).cast("long")))
    found = scratch.stored(dealt.repartition(parts, "cell", "group").sortWithinPartitions("cell", "group").mapInPandas(combine, f"{RUN}, group long, places binary"), "merged")
    above = resolve(found.where("run IS NULL").drop("run", "places").withColumnRenamed("group", "run").select(*RUN_SCHEMA.names), groups, window, cells, fan_in, scratch)
    lower = found.where("run IS NOT NULL").select("cell", "group", "run", "places")
    return lower.join(above.withColumnRenamed("run", "group"), ["cell", "group"]).select("cell", "run", "places", "bits").mapInPandas(back, ANSWER)


def dedup_suffixes(
    docs: DataFrame,
    window: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
    block_docs: int = 4096,
    cell_bytes: int = 16 << 20,
    fan_in: int = 512,
    hot: int = 10_000,
) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes)."""
    if not 8 <= window <= 500:
        raise ValueError("a window has 8 to 500 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    scratch.later()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in {id_col, text_col, *RESULTS}], F.lit(0).alias("__none")).alias("other")
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"), rest)
    blocks = scratch.bucketed(pack_blocks(named, "doc", "body", block_bytes, block_docs), "suffix_blocks", "block")
    width = KEY + window + window - window // 2

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, n, kinds = Bytes(batch["texts"][i].values, window).anchors()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch["block"][i].as_py())), pa.array(hashes.view(np.int64)), pa.array(n), pa.array(kinds)], names=["block", "hash", "n", "kinds"])

    anchors = scratch.stored(blocks.select("block", "texts").mapInArrow(send_anchors, "block long, hash long, n long, kinds long"), "anchors")
    shared = scratch.stored(anchors.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).where("n > 1").select("hash", (F.col("kinds") > hot).alias("hot"), "kinds"), "shared")
    size = shared.agg(F.sum(F.when(F.col("hot"), F.col("kinds") * (window // 4)).otherwise(F.col("kinds")))).first()[0] or 0
    cells = max(partitions(spark), -(-size * width // cell_bytes))
    n_runs = blocks.count()
    mine = anchors.select("block", "hash").join(shared.select("hash", "hot"), "hash").groupBy("block").agg(F.collect_list("hash").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hot"))
    joined = blocks.join(scratch.stored(mine, "mine"), "block", "left")

    def chosen(batch: pa.RecordBatch, i: int) -> Bytes:
        b = Bytes(batch["texts"][i].values, window)
        lists = [np.zeros(0, U64) if batch[c][i].values is None else batch[c][i].values.to_numpy().view(U64) for c in ("shared", "hot")]
        b.choose(*lists)
        return b

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, block = chosen(batch, i), batch["block"][i].as_py()
                rows, first, many = b.run()
                key = rows[:, :KEY].copy().view(">u8").ravel().astype(U64)
                cell = ((key >> U64(32)) * U64(cells) >> U64(32)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
                common = common_prefixes(rows)
                common[starts] = 0
                out = []
                for x, y in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist(), strict=len(starts) > 0):
                    c = common[x:y]
                    out.append((int(cell[x]), block, c.astype(np.uint16).tobytes(), b.least[first[x:y]].tobytes(), b.most[first[x:y]].tobytes(), many[x:y].tobytes(), front_coded(rows[x:y], c)))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=RUN_SCHEMA.names), RUN_SCHEMA, preserve_index=False)

    runs = joined.where("shared IS NOT NULL").select("block", "texts", "shared", "hot").mapInArrow(send_runs, RUN)
    answers = resolve(runs, n_runs, window, cells, fan_in, scratch)
    found = answers.groupBy(F.col("run").alias("block")).agg(F.sort_array(F.collect_list(F.struct("cell", "bits"))).alias("answers"))
    rest_type = blocks.schema["rest"].dataType.elementType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.BinaryType() if c == "kept" else T.LongType()) for c in RESULTS], T.StructField("rest", rest_type)])
    reach = window - window // 2

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = chosen(batch, i)
                b.run()
                parts = batch["answers"][i].as_py() or []
                bits = np.frombuffer(b"".join(p["bits"] for p in parts), np.uint8).reshape(-1, (reach + 8) // 8)
                gone = b.removed(np.unpackbits(bits, axis=1, count=reach + 1).view(bool))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = b.begin[:-1][np.diff(b.begin) > 0]
                begins[inner] = gone[inner]
                sums = lambda x: np.diff(np.append(0, np.cumsum(x))[b.begin])
                kept, lost = b.data[~gone], sums(gone)
                offsets = np.append(0, np.cumsum(np.diff(b.begin) - lost)).astype(np.int32)
                kept_bytes = pa.Array.from_buffers(pa.binary(), len(lost), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
                columns = [batch["ids"][i].values, batch["texts"][i].values, pa.array(np.diff(b.begin)), pa.array(lost), pa.array(sums(begins)), kept_bytes, batch["rest"][i].values]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", *RESULTS, "rest"])

    out = joined.join(found, "block", "left").select("ids", "texts", "shared", "hot", "answers", "rest").mapInArrow(remove, schema)
    pick = {id_col: F.col("id"), text_col: F.col("text")}
    return out.select(*[pick[c].alias(c) if c in pick else F.col("rest.other")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)
