"""The training-corpus pipeline: quality rules, near duplicates, repeated passages, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.

- quality: documents that the quality rules reject, by themselves or by their host, go.
- near_duplicates: one document of each group stays, the one with the smallest id.
- substrings: words in a run of 50 or more that also starts in a document with a smaller id go; n_chars is the new length.
- mix: rows are written in the order in which the sources' blocks are due.
- pack: pieces of at most 1,024 tokens, each with its sequence and its place there. Pieces of a length are laid in the order in which mix stored the rows, by file and place in
  the file, and sequences are numbered by it. Rows that come from no Parquet files have no such order; for them the mixed order is worked out.

Nulls, empty texts, very long texts, repeated rows and empty tables are handled as the operators' own docstrings say. Rows with one doc_id are one document: if any
of their texts is kept among near duplicates, all of the rows are. Further columns of docs, whatever their names, come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinloom.llm.common import stored, table, until_stored
from kinloom.llm.mixing import mix_sources
from kinloom.llm.near_dup import near_duplicates
from kinloom.llm.packing import place, tokenize_pieces
from kinloom.llm.quality import judge_quality
from kinloom.llm.queries import END_ID, SEQUENCE_TOKENS, vocabulary
from kinloom.llm.substring import dedup_substrings

#: Words of a repeated passage.
PASSAGE_WORDS = 50
#: Documents a block of the mix, and target weights by source (None: square roots of the counts).
BLOCK_DOCS = 16
WEIGHTS: dict[str | None, float] | None = None


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose id has a kept verdict; a null id is matched by null."""
    key = "__" + max(docs.columns, key=len)  # longer than any name of docs
    good = verdicts.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs, and the whole row as a struct, so that no other column can clash."""
    return docs.select(*columns, F.struct(*docs.columns).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge_quality(_rows(docs, "source", "text"), keep=["__row"]).where("kept").select("__row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, near_duplicates(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = dedup_substrings(docs.select("doc_id", "text", F.struct(*rest).alias("__rest")), window=PASSAGE_WORDS)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("__rest.n_chars"))
    pick = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return found.select(*[pick.get(c, F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(_rows(docs, "doc_id", "source"), WEIGHTS, BLOCK_DOCS).orderBy("slot", "position").select("__row.*")


def stored_order(docs: DataFrame) -> Column | None:
    """A number that grows in the order in which Spark wrote the rows of docs; None if they are not read from Parquet files."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(name, row).schema  # noqa: B018
    except AnalysisException:
        return None
    number = lambda mark: F.coalesce(F.expr("try_cast(nullif(regexp_extract(_metadata.file_name, '%s', 1), '') AS BIGINT)" % mark), F.lit(0))  # noqa: E731, UP031
    return F.shiftleft(number(r"part-(\\d+)"), 44) + F.shiftleft(number(r"-c(\\d+)"), 36) + row


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = lambda keep: tokenize_pieces(docs, vocabulary("byte_bpe_50k.json"), "bytes", END_ID, SEQUENCE_TOKENS, keep=keep, lasting=False)
    order = stored_order(docs)
    if order is not None:
        return place(stored(tokens({"order": order}), "pieces"), SEQUENCE_TOKENS)
    pieces = stored(tokens({"row": F.monotonically_increasing_id(), "source": F.col("source")}), "pieces")
    mixed = mix_sources(pieces.where("piece = 0").select("doc_id", "source", "row"), WEIGHTS, BLOCK_DOCS)
    order = mixed.select("row", (F.col("slot") * BLOCK_DOCS + F.col("position")).alias("order"))
    return place(stored(pieces.drop("source").join(order, "row").drop("row"), "ordered"), SEQUENCE_TOKENS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("substrings", substrings), ("mix", mix), ("pack", packing)]

#: Tokenizing and sketching have no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with until_stored():
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
