"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, and the white space between words, as Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session is tuned to; explicit widths follow it, so they grow with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinloom-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator needs only until its result is stored; clear() deletes them.

    An operator that stores its own result clears its scratch itself. One whose result still reads it says so by later(), and the caller
    stores that result within until_stored(), or runs clear_scratch() once it is stored.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.tables = spark, new_path(spark, what), []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.root}/{what}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, what: str, column: str) -> DataFrame:
        """A table of the catalog, so that joins on the column need no shuffle of it."""
        name = f"kinloom_{what}_{uuid.uuid4().hex}"
        df.write.bucketBy(partitions(self.spark), column).option("path", f"{self.root}/{name}").option("compression", "zstd").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def later(self) -> None:
        scopes = getattr(_scopes, "lists", [])
        (scopes[-1] if scopes else _waiting).append(self)

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_waiting: list[Scratch] = []
#: The lists of this thread's until_stored(), innermost last.
_scopes = threading.local()


def _clear(scratch: list[Scratch]) -> None:
    while scratch:
        scratch.pop().clear()


@contextmanager
def until_stored() -> Iterator[None]:
    """Store the result of an operator inside: what the operator left for it is deleted at the end, and nothing of other callers or threads."""
    outer, mine = getattr(_scopes, "lists", []), []
    _scopes.lists = [*outer, mine]
    try:
        yield
    finally:
        _scopes.lists = outer
        _clear(mine)


def clear_scratch() -> None:
    """Deletes what operators left outside until_stored(), for results that are stored by now; results that are not can no longer be read."""
    _clear(_waiting)


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text inside a task; a null text has none."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = found.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends[sizes].astype(np.int32)), flat.filter(some))


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


def slices_of(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts): slices of about that many bytes, so a batch of long texts is not worked on at once."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end
