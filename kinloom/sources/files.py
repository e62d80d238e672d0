"""Files: raw books in several encodings, chunks, extraction results, and tables that grow by runs."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.parse import EXTRACTION

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16")
CHUNK = "chunk_id string, chapter string, content string, char_count int"
#: The same fields as a table's schema, which has no colons at its top level.
RESULT = re.sub(r"\b(persons|dynasties|events|places|relations|source_text|source_chapter):", r"\1 ", EXTRACTION.removeprefix("struct<").removesuffix(">"))


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kinloom-"))


def decoded(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeError:
            continue
    raise ValueError("the text is in none of the known encodings")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the .txt, .md and .text files of a folder; the name is the file's without folder and ending. UTF-8 is decoded by Spark; only the rest goes to Python."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"(?i)\.(txt|md|text)$"))
    files = files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = files.where(valid).select("name", F.col("content").cast("string").alias("text"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "text": [decoded(bytes(x)) for x in batch["content"]]})

    return good.union(files.where(~valid).mapInPandas(decode, "name string, text string"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stored_chunks(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The chunks at path; if there are none, they are made and written there first."""
    read = lambda: spark.read.schema(CHUNK).json(path)
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write_json(make(), path)
    return read()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results that were saved, for writing without a model."""
    return spark.read.option("multiLine", True).schema(RESULT).json(path)


def read_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def pending(chunks: DataFrame, done: DataFrame, resume: bool = True, start: int = 0, limit: int | None = None) -> DataFrame:
    """Chunks still to do, by id: those in done go first, then the first ``start``, then all beyond ``limit``."""
    left = chunks.join(done.select("chunk_id"), "chunk_id", "left_anti") if resume else chunks
    left = left.orderBy("chunk_id")
    left = left.offset(start) if start else left
    return left if limit is None else left.limit(limit)


def cached_or(wanted: DataFrame, cache: DataFrame, key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached value, rows still to compute)."""
    hit = wanted.join(cache.select(*key, value).dropDuplicates(key), key)
    return hit, wanted.join(cache.select(*key), key, "left_anti")
