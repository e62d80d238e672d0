"""Token files as wavelet matrices: one compressed file a shard that answers access, count, rank and select.

A shard holds the ids of whole documents in ascending doc_id order, as bit planes from the highest bit down. After each
plane the sequence is partitioned stably by that bit, zeros first, so ranks in a plane lead to the next. Planes are cut
into blocks, compressed on their own, with the ones before each block in a directory: a lookup inflates one block a plane.

Writing: documents are dealt out by ranges of doc_id and sorted within a range; each task writes shards of its own. Global starts
are prefix sums over ranges and over the shards of a range, so nothing but one row a range meets in one task.

Defined cases: a null or empty text has only the end id. Null doc_ids sort first; rows with equal doc_ids are ordered by
their texts. Very long texts are encoded whole and fill shards of their own. An empty table gives no shard and an empty result. Other columns are not carried, so none
can clash.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, slices_of, stored
from .tokens import encoder

MAGIC = b"KLWM0001"
BLOCK_BITS = 1 << 16
SHARDS = pa.schema([("part", pa.string()), ("seq", pa.int64()), ("first_id", pa.int64()), ("shard", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def pack_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard. ids: all documents' ids in order."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    seq = ids.astype(np.uint16 if ids.size == 0 or ids.max() < 1 << 16 else np.uint32)
    bits = max(1, int(seq.max(initial=0)).bit_length())
    zeros, ones, sizes, blocks = [], [], [], []
    for level in range(bits - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << level)) != 0
        plane = np.packbits(bit, bitorder="little")
        per_block = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK_BITS // 8), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
        ones.append([0, *np.cumsum(per_block).tolist()])
        for at in range(0, len(plane), BLOCK_BITS // 8):
            blocks.append(pack(plane[at : at + BLOCK_BITS // 8].tobytes()))
            sizes.append(len(blocks[-1]))
        zeros.append(len(bit) - ones[-1][-1])
        seq = np.concatenate([seq[~bit], seq[bit]])
    head = pack(json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "ones": ones, "sizes": sizes, "doc_ids": doc_ids, "lengths": lengths.tolist()}).encode())
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blocks])


class WaveletShard:
    """A shard file. read(size, offset) gives its bytes."""

    def __init__(self, read) -> None:
        import zstandard

        self._inflate = zstandard.ZstdDecompressor().decompress
        start = read(16, 0)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(start[8:], "little")
        head = json.loads(self._inflate(read(size, 16)))
        self.n, self.bits, self.zeros, self.ones = head["n"], head["bits"], head["zeros"], head["ones"]
        self.doc_ids, self.lengths = head["doc_ids"], np.array(head["lengths"], np.int64)
        self._offsets = 16 + size + np.concatenate([[0], np.cumsum(np.array(head["sizes"], np.int64))])
        self._per_plane = -(-self.n // BLOCK_BITS)
        self._read = read
        self._block = lru_cache(64)(self._load)

    def _load(self, level: int, block: int) -> np.ndarray:
        k = level * self._per_plane + block
        data = self._inflate(self._read(int(self._offsets[k + 1] - self._offsets[k]), int(self._offsets[k])))
        count = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(data, np.uint8), count=count, bitorder="little").view(bool)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, within = divmod(i, BLOCK_BITS)
        return self.ones[level][block] + (int(np.count_nonzero(self._block(level, block)[:within])) if within else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        before = np.array(self.ones[level]) if bit else np.minimum(np.arange(self._per_plane + 1) * BLOCK_BITS, self.n) - np.array(self.ones[level])
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(level, block) == bool(bit))[k - before[block]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = bool(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            rank = self._rank1(level, i)
            i = self.zeros[level] + rank if bit else i - rank
            value = 2 * value + bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences begin in the last order, and where those before i end."""
        begin, end = 0, i
        for level in range(self.bits):
            r0, r1 = self._rank1(level, begin), self._rank1(level, end)
            begin, end = (self.zeros[level] + r0, self.zeros[level] + r1) if token >> (self.bits - 1 - level) & 1 else (begin - r0, end - r1)
        return begin, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before position i."""
        if token >> self.bits:
            return 0
        begin, end = self._range(token, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        if k < 0 or k >= self.count(token):
            raise IndexError("no such occurrence")
        at = self._range(token, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the partitions undone from the lowest plane up."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._load(level, b) for b in range(self._per_plane)]) if self.n else np.zeros(0, bool)
            above = np.empty_like(value)
            above[~bit] = value[: self.zeros[level]]
            above[bit] = value[self.zeros[level] :] | value.dtype.type(1 << (self.bits - 1 - level))
            value = above
        return value


def write_tokens(docs: DataFrame, tokenizer: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 19) -> DataFrame:
    """Writes the shards; returns one row each: part, seq, first_id, shard, n_docs, n_tokens, start (of its first id)."""
    root = new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = encoder(tokenizer, kind, end_id).encode
        system, base = fs.FileSystem.from_uri(root)
        part, seq, keys, held, sizes = uuid.uuid4().hex, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, held, sizes
            system.create_dir(base, recursive=True)
            ids, lengths = np.concatenate(held), np.concatenate(sizes)
            name = f"{part}-{seq:06d}.wm"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(pack_shard(ids, keys, lengths))
            row = {"part": part, "seq": seq, "first_id": keys[0], "shard": f"{root}/{name}", "n_docs": len(keys), "n_tokens": len(ids)}
            seq, keys, held, sizes = seq + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], SHARDS)

        for batch in batches:
            doc_ids = batch["id"].to_pylist()
            for first, texts in slices_of(batch["text"]):
                ids, lengths = encode(texts)
                ends = np.cumsum(lengths)
                k = 0
                while k < len(texts):  # documents from k on; the one that fills a shard is its last
                    begin = int(ends[k - 1]) if k else 0
                    room = shard_tokens - sum(map(len, held))
                    stop = min(int(np.searchsorted(ends, begin + room)) + 1, len(texts))
                    keys += doc_ids[first + k : first + stop]
                    held.append(ids[begin : ends[stop - 1]])
                    sizes.append(lengths[k:stop])
                    k = stop
                    if sum(map(len, held)) >= shard_tokens:
                        yield flush()
        if keys:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = picked.repartitionByRange("id").sortWithinPartitions("id", "text")
    shards = stored(dealt.mapInArrow(write, "part string, seq long, first_id long, shard string, n_docs long, n_tokens long"), "token-shards")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"), F.min_by("first_id", "seq").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.asc_nulls_first("first")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("__in", within).join(parts.select("part", before.alias("__before")), "part").select(*shards.columns, (F.col("__before") + F.col("__in")).alias("start"))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Reads the shards back: doc_id, start, n_tokens, ids_crc32 of every document."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                system, path = fs.FileSystem.from_uri(row.shard)
                with system.open_input_file(path) as file:
                    shard = WaveletShard(file.read_at)
                    ids = shard.decode().astype("<u4")
                starts = np.concatenate([[0], np.cumsum(shard.lengths)])
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": row.start + starts[:-1], "n_tokens": shard.lengths, "ids_crc32": crcs})

    dealt = shards.select("shard", "start").repartition(partitions(shards.sparkSession), "shard")
    return dealt.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
