"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, until_stored
from .html import extract_text
from .importance import resample
from .media import read_media, write_media
from .mixing import mix_sources
from .near_dup import near_duplicates
from .oracles import ORACLE_SQL as ORACLE_SQL
from .packing import pack
from .quality import judge_quality
from .rope import fill_in_middle, restore
from .substring import dedup_substrings
from .suffixes import dedup_suffixes
from .urls import judge_urls
from .warc import read_warc, records, write_warc
from .wavelet import read_tokens, write_tokens

END_ID = 2
SEQUENCE_TOKENS = 1024
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_media(table(spark, sf_dir, "documents"))
    return read_media(index).withColumnRenamed("id", "doc_id").drop("shard", "offset")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return found.select("doc_id", "source", "block", "slot", "position")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(read_warc(write_warc(table(spark, sf_dir, "pages")), content=False))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with until_stored():
        found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13, rejoin=True)
        return stored(found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")), "substrings")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, rows=9, bands=54)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "words", END_ID))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "bytes", END_ID, SEQUENCE_TOKENS)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with until_stored():
        found = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"), window=200)
        return stored(found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "suffixes")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7).drop("text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_files": op6_token_files,
    "op7_html_text": op7_html_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_importance": op13_importance,
}
