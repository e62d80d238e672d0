import hashlib
import math
import zlib

from kinloom.llm.media import read_headers, read_media, write_media
from kinloom.llm.warc import read_warc, records, write_warc

TEXTS = ["", None, "short", "é" * 500, "x" * 192, "many words " * 40_000, "short"]
HTML = [None, "", "tiny", "tiny", "p" * 100, "p" * 100, "ü" * 60, "long " * 60_000, "long " * 60_000]


def padded(text):
    data = (text or "").encode()
    out = bytearray(data)
    while not out or len(out) % 192:
        out.append(32)
    return len(data), bytes(out)


def feature(payload):
    """By plain Python."""
    mean = sum(payload) / len(payload)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
    return f"mean={mean:.4f};std={deviation:.4f};hist=" + ",".join(str(sum(32 * k <= x < 32 * k + 32 for x in payload)) for k in range(8))


def test_media_round_trip(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "nobody", None, None), (2, "short", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, digest string").repartition(2)
    index = write_media(docs)
    found = read_media(index, range_bytes=1000).collect()
    heads = read_headers(index)
    assert heads.columns == ["id", "n_bytes", "digest", "shard", "offset", "length", "width", "height", "bit_depth"]
    assert sorted((r.width, r.height, r.digest) for r in heads.collect()) == sorted((r.width, r.height, r.media_sha256) for r in found)
    assert len(found) == len(rows)
    want = {i: padded(t) for i, t, *_ in rows}
    for r in found:
        assert r.feature == feature(want[r.id][1])
        n, payload = want[r.id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.width * r.height * 3 == len(payload)
    assert len({r.media_sha256 for r in found if r.n_bytes == 5}) == 1


def test_media_empty_table(spark):
    assert read_media(write_media(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}" if i % 2 else None, h) for i, h in enumerate(HTML)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r for r in records(read_warc(write_warc(pages, range_bytes=1000))).collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(k for k, _, x in rows if (x or "").encode() == data)
        revisit = len(data) >= 100 and first != i
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_warc_nulls_copies_and_other_columns(spark):
    long = "deep " * 700_000
    rows = [(None, None, long, "x"), (4, "u", long, "x"), (4, "u", long, "y"), (9, "u", long, None), (None, "u", "alone " * 40, "x"), (7, "a\r\nb", None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    chunks = read_warc(write_warc(pages))
    found = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in records(chunks).collect()), key=str)
    n = len(long)
    assert found == sorted([(0, n, "revisit", 4), (4, n, "response", None), (4, n, "response", None), (9, n, "revisit", 4), (0, 240, "response", None), (7, 0, "response", None)], key=str)
    parts = [r for r in chunks.collect() if r.page_id == 4]
    assert len(parts) == 2 * -(-n // (32 << 10)) and all(len(r.content) <= 32 << 10 for r in parts)
    assert records(read_warc(write_warc(pages), content=False)).count() == len(rows)


def test_warc_empty_table(spark):
    assert records(read_warc(write_warc(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0
