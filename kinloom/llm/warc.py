"""WARC archives written and read as a table of record chunks.

Writing: of records with equal payloads of at least ``min_dedup`` bytes, the one with the smallest id is the response
and the others are revisit records without a payload. Digests are grouped on (digest, id) only, with map-side partial minima, and
joined back, where Spark splits a hot digest. Each task writes archives of its own (one gzip member a record) and
returns ranges of whole records, so reading is dealt out by range.

Reading: each range is decompressed as a stream; a record is emitted as rows (record id, chunk number, chunk) of at most
``chunk_bytes``, each with the running length and the digest of the payload up to its end. No record is ever held whole.

Defined cases: a null payload is empty. Null ids sort after all others, so such a record is a response only if no record
with an id shares its payload. Rows with the same id and payload are alike: all response, or all revisit. An empty table gives no
archive and an empty result. A null URL leaves the target header out. A very long payload is compressed in slices and read back in chunks. Other columns are not carried,
so none can clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, stored

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
RECORD_END = b"\r\n\r\n"
SLICE = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no int, content binary, total_bytes long, running_digest string, is_last boolean"


def record_kinds(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_dedup: int) -> DataFrame:
    """(id, url, payload, digest, n, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("n") >= min_dedup).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k"))
    shared = stored(shared.where("k > 1 AND first IS NOT NULL").drop("k"), "warc-shared")
    return rows.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_uri(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedup: int = 100, range_bytes: int = 4 << 20, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives and returns their ranges: archive, begin, end, records."""
    root = new_path(pages.sparkSession, "warc")

    def one(row) -> Iterator[bytes]:
        """A record's gzip member, in slices."""
        body = b"" if row.refers_to == row.refers_to and row.refers_to is not None else row.payload.encode()
        revisit = row.refers_to == row.refers_to and row.refers_to is not None
        key = None if pd.isna(row.id) else int(row.id)
        lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_uri(key, row.digest)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row.digest}", f"X-Payload-Length: {row.n}"]
        if key is not None:
            lines.append(f"X-Page-Id: {key}")
        if row.url is not None:
            lines.append("WARC-Target-URI: " + row.url.replace("\r", "%0D").replace("\n", "%0A"))
        if revisit:
            lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_uri(int(row.refers_to), row.digest)}>", f"X-Refers-To-Page-Id: {int(row.refers_to)}"]
        head = VERSION + "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]).encode() + RECORD_END
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield packer.compress(head)
        for at in range(0, len(body), SLICE):
            yield packer.compress(memoryview(body)[at : at + SLICE])
        yield packer.compress(RECORD_END) + packer.flush()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        out = uri = None
        at = begin = records = 0
        for batch in batches:
            ranges = []
            for row in batch.itertuples():
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, uri, at, begin, records = system.open_output_stream(f"{base}/{name}", compression=None), f"{root}/{name}", 0, 0, 0
                for data in one(row):
                    out.write(data)
                    at += len(data)
                records += 1
                if at - begin >= range_bytes or at >= archive_bytes:
                    ranges.append((uri, begin, at, records))
                    begin, records = at, 0
                if at >= archive_bytes:
                    out.close()
                    out = None
            if ranges:
                yield pd.DataFrame(ranges, columns=["archive", "begin", "end", "records"])
        if out is not None:
            out.close()
            if records:
                yield pd.DataFrame([(uri, begin, at, records)], columns=["archive", "begin", "end", "records"])

    kinds = record_kinds(pages, id_col, url_col, payload_col, min_dedup)
    return stored(kinds.mapInPandas(write, "archive string, begin long, end long, records long"), "warc-ranges")


def stream_records(read, begin: int, end: int, chunk_bytes: int, block: int = 1 << 16) -> Iterator[tuple]:
    """(headers, chunk number, chunk, running length, running digest, last) of the records in a range.

    read(size, offset) gives bytes; at most a block, a header and a chunk are held.
    """
    at, pending = begin, b""
    while at < end or pending:
        unpack, buffer, headers = zlib.decompressobj(31), bytearray(), None
        digest, left, total, number = hashlib.sha256(), 0, 0, 0
        while not unpack.eof:
            if not pending:
                pending = read(min(block, end - at), at)
                if not pending:
                    raise ValueError("archive range ends within a record")
                at += len(pending)
            buffer += unpack.decompress(pending, block)
            pending = unpack.unconsumed_tail or unpack.unused_data
            if headers is None:
                stop = buffer.find(RECORD_END)
                if stop < 0:
                    continue
                lines = bytes(buffer[:stop]).decode().split("\r\n")
                headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                left = int(headers["content-length"])
                del buffer[: stop + 4]
            while left > chunk_bytes and len(buffer) >= chunk_bytes:
                part = bytes(buffer[:chunk_bytes])
                del buffer[:chunk_bytes]
                digest.update(part)
                total, left = total + len(part), left - len(part)
                yield headers, number, part, total, digest.hexdigest(), False
                number += 1
        part = bytes(buffer[:left])
        if headers is None or len(part) < left:
            raise ValueError("record is shorter than its header says")
        digest.update(part)
        yield headers, number, part, total + len(part), digest.hexdigest(), True


def read_warc(ranges: DataFrame, chunk_bytes: int = 32 << 10, content: bool = True) -> DataFrame:
    """The chunk table of the archives. Without content, only each record's last chunk has a row, with the counters of the whole payload and null content."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples():
                system, path = fs.FileSystem.from_uri(row.archive)
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for head, number, part, total, digest, last in stream_records(file.read_at, row.begin, row.end, chunk_bytes):
                        if not (content or last):
                            continue
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((head["warc-record-id"].strip("<>"), page and int(page), head["warc-type"], refers and int(refers), int(head["x-payload-length"]), head["warc-payload-digest"].partition(":")[2], number, part if content else None, total, digest, last))
                        held += len(part) if content else 1 << 10
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))

    width = partitions(ranges.sparkSession)
    return ranges.repartition(width, "archive", "begin").mapInPandas(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk. A response's length and digest are those of the bytes read; its header must agree."""
    last = chunks.where("is_last")
    revisit = F.col("record_type") == "revisit"
    agrees = (F.col("total_bytes") == F.col("declared_bytes")) & (F.col("running_digest") == F.col("declared_digest"))
    digest = F.when(revisit, F.col("declared_digest")).when(agrees, F.col("running_digest")).otherwise(F.raise_error("payload does not match its header"))
    size = F.when(revisit, F.col("declared_bytes")).otherwise(F.col("total_bytes"))
    return last.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
