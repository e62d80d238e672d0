"""Media columns: payloads in tar shards, content-addressed; rows carry digest, shard, offset and length.

A payload is stored losslessly as an 8-bit RGB PNG, 64 pixels (192 bytes) a row. Each task writes shards of its own, so a
retried or speculative task never touches another's file; a payload that repeats within a shard is stored once, and its
rows share one offset. Members are named by digest in each shard by itself: copies in different shards are stored once a shard, and have one digest. Metadata columns
come from range reads of the header alone; the payload from a range read of the member. Reading is dealt out by shard and range of offsets, so the number of tasks
follows the payloads' size and not the index's.

Defined cases: a null or empty text is a payload of 192 spaces. Null ids are kept. Repeated rows share a member. A very long text is one member, held whole by its task. An
empty table gives an empty index. Other columns are not carried, so none can clash. Shards that a failed task left behind are named by no index row.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, stored

ROW_BYTES = 192
#: Fixed values of the PNG format: signature, and the bytes up to the end of the first chunk.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_HEADER_BYTES = 33
TAR_BLOCK = 512


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and those bytes padded with spaces to a positive multiple of a row."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    unfiltered = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    unfiltered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(unfiltered.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first PNG_HEADER_BYTES bytes."""
    if head[:8] != PNG_SIGNATURE or zlib.crc32(head[12:29]) != int.from_bytes(head[29:33], "big"):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * 3 + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and an 8-bin histogram of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};hist=" + ",".join(map(str, bins))


class _Shard:
    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.uri = f"{root}/{uuid.uuid4().hex}.tar"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.members = system.open_output_stream(path), 0, {}

    def put(self, digest: str, data: bytes) -> int:
        """Offset of the member's data."""
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.members[digest] = self.at + len(head)
            block = head + data + bytes(-len(data) % TAR_BLOCK)
            self.out.write(block)
            self.at += len(block)
        return self.members[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * TAR_BLOCK))
        self.out.close()


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Stores the texts; the index has a row for each input row: id, n_bytes, digest (SHA-256 of the stored form),
    shard, offset, length."""
    root = new_path(docs.sparkSession, "media")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                n, payload = payload_of(text)
                data = to_png(payload)
                digest = hashlib.sha256(data).hexdigest()
                if shard is None or shard.at > shard_bytes:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(root)
                rows.append((key, n, digest, shard.uri, shard.put(digest, data), len(data)))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "digest", "shard", "offset", "length"])
            out["id"] = out["id"].astype("Int64")
            yield out
        if shard is not None:
            shard.close()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = picked.mapInPandas(write, "id long, n_bytes long, digest string, shard string, offset long, length long")
    return stored(index, "media-index")


def _ranges(shards: pd.Series, offsets: pd.Series, lengths: pd.Series) -> Iterator[bytes]:
    """The bytes of each range; a shard stays open while the rows stay on it."""
    from pyarrow import fs

    held, file = None, None
    for uri, offset, length in zip(shards, offsets, lengths, strict=True):
        if uri != held:
            if file is not None:
                file.close()
            system, path = fs.FileSystem.from_uri(uri)
            held, file = uri, system.open_input_file(path)
        yield file.read_at(length, offset)
    if file is not None:
        file.close()


def _dealt(index: DataFrame, range_bytes: int) -> DataFrame:
    """Index rows by shard and range of offsets, in order of place."""
    at = F.floor(F.col("offset") / range_bytes)
    return index.repartition(4 * partitions(index.sparkSession), "shard", at).sortWithinPartitions("shard", "offset")


def _heads(batch: pd.DataFrame) -> pd.DataFrame:
    """width, height and bit_depth of members, from range reads of their headers."""
    ranges = _ranges(batch["shard"], batch["offset"], batch["length"].clip(upper=PNG_HEADER_BYTES))
    return pd.DataFrame([png_header(h) for h in ranges], columns=["width", "height", "bit_depth"], index=batch.index)


def read_headers(index: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Adds width, height and bit_depth, from the header's range of each member only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(id=batch["id"].astype("Int64"), **_heads(batch))

    columns = ", ".join(f"{n} {t}" for n, t in index.dtypes)
    return _dealt(index, range_bytes).mapInPandas(read, f"{columns}, width int, height int, bit_depth int")


def read_media(index: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Reads each row's member, its header first, and computes payload and media digests and the feature.

    Fails if a member does not match its digest.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple, tuple] = {}
            rows, wanted = [], batch.drop_duplicates(["shard", "offset"])
            heads = _heads(wanted)
            for row, head, data in zip(wanted.itertuples(), heads.itertuples(index=False), _ranges(wanted["shard"], wanted["offset"], wanted["length"]), strict=True):
                media = hashlib.sha256(data).hexdigest()
                if media != row.digest:
                    raise ValueError(f"{row.shard} at {row.offset}: digest does not match")
                payload = from_png(data)
                seen[row.shard, row.offset] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), media, feature_of(payload), head.width, head.height)
            for row in batch.itertuples():
                rows.append((row.id, row.n_bytes, *seen[row.shard, row.offset], row.shard, row.offset))
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset"])
            yield out.assign(id=out["id"].astype("Int64"))

    return _dealt(index, range_bytes).mapInPandas(read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, shard string, offset long")
