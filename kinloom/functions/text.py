"""Text functions: cleaning, sentence chunks and names as columns; chapters as a small helper for mapInPandas."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import AMBIGUOUS_TITLES, NUMERAL, PREFACE, PREFACES, SENTENCE_ENDS, VOLUMES, WHOLE

MIN_CHAPTER = 50


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", "")


def clean(text: Column) -> Column:
    """At most one empty line in a row; no white space at the ends of lines."""
    lines = F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def all_names(name: Column, aliases: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, empty))), lambda x: x.isNotNull() & (x != ""))


def specific_names(names: Column) -> Column:
    """Names that tell a person: no shared titles, no single characters."""
    return F.filter(names, lambda x: (F.length(x) > 1) & ~x.isin(AMBIGUOUS_TITLES))


def relation_type(raw: Column) -> Column:
    """An upper-case identifier; RELATED_TO if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}_]", "_"), F.lit("")), F.lit("RELATED_TO"))


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


_BARRED = rf"\|\s*第{NUMERAL}\s*\|"
_HEADING = re.compile("|".join([rf"(?P<bar>{_BARRED})", rf"^(?P<plain>第{NUMERAL}[^\n]*)", *(rf"^(?P<volume{i}>{v}[^\n]*)" for i, v in enumerate(VOLUMES))]), re.M)
_CHAPTER_LINE = re.compile(rf"\|?\s*第{NUMERAL}")
_BOOK_LINE = re.compile("|".join(v.partition("[")[0] for v in VOLUMES))
_BLANKS = re.compile("\n{3,}")


def _tidy(text: str) -> str:
    return "\n".join(x.strip() for x in _BLANKS.sub("\n\n", text).split("\n")).strip()


def without_contents(text: str, long: int = 100, back: int = 29) -> str:
    """Drops a table of contents: the text starts at the nearest heading before its first long line."""
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    body = next((i for i, x in enumerate(bare) if len(x) > long and x[0] != "|" and not re.match(f"第{NUMERAL}", x)), 0)
    if not body:
        return text
    heads = (i for i in range(body - 1, max(0, body - back - 1), -1) if bare[i] in PREFACES or _CHAPTER_LINE.match(bare[i]) or _BOOK_LINE.match(bare[i]))
    return "\n".join(lines[next(heads, body) :])


def chapters(text: str) -> list[tuple[str, str]]:
    """(title, content) of each chapter; a text without headings is one chapter, as it is."""
    text = without_contents(text)
    heads = list(_HEADING.finditer(text))
    if not heads:
        return [(WHOLE, text)]
    found = [(PREFACE, _tidy(text[: heads[0].start()]))]
    for head, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=True):
        title, body = head[0].strip(), text[head.end() : after].strip()
        if head["bar"]:
            title = re.sub(r"[|\s]", "", title)
            first, _, rest = body.partition("\n")  # body has no white space at its start
            if first.strip() and len(first.strip()) < 30 and not re.search("[。！？；]", first):
                title, body = f"{title} {first.strip()}", rest
        found.append((title, _tidy(body)))
    return [(t, c) for t, c in found if len(c) > MIN_CHAPTER]


_SENTENCE = re.compile(f"(?<=[{SENTENCE_ENDS}])")


def chunks(text: str, size: int = 1500, overlap: int = 200) -> list[str]:
    """Overlapping chunks at sentence ends; a sentence is never cut, so a chunk may be longer than size."""
    done, now = [], ""
    for sentence in filter(None, map(str.strip, _SENTENCE.split(text))):
        if len(now) + len(sentence) <= size:
            now += sentence
        else:
            if now:
                done.append(now)
            now = (now[-overlap:] if overlap else "") + sentence
    return [*done, now] if now else done


def _book_rows(books: DataFrame, name_col: str, text_col: str, schema: str, rows_of: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """One pass over books: the rows of each text behind its name."""
    names = [x.split()[0] for x in schema.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for name, text in zip(batch["name"], batch["text"], strict=True):
                held += [(name, *row) for row in rows_of(text or "")]
                size += len(text or "")
                if size > 8 << 20:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)

    return books.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text")).mapInPandas(split, schema)


def split_chapters(books: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(name, chapter_no, chapter, content) for each book."""
    rows = lambda text: ((k, t, c) for k, (t, c) in enumerate(chapters(text)))
    return _book_rows(books, name_col, text_col, "name string, chapter_no int, chapter string, content string", rows)


def chunk_table(books: DataFrame, size: int = 1500, overlap: int = 200, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(name, chapter_no, chunk_no, chapter, content, char_count) of books, chapters and chunks cut in one pass."""
    rows = lambda text: ((k, j, t, x, len(x)) for k, (t, c) in enumerate(chapters(text)) for j, x in enumerate(chunks(c, size, overlap)))
    return _book_rows(books, name_col, text_col, "name string, chapter_no int, chunk_no int, chapter string, content string, char_count int", rows)


def numbered(chunk_rows: DataFrame) -> DataFrame:
    """Adds chunk_id by (name, chapter_no, chunk_no): chapters' counts are summed within ranges of the order, and only one row a range meets in one task."""
    from pyspark.sql import Window

    from ..sources.files import checkpoint_dir

    spark = chunk_rows.sparkSession
    checkpoint_dir(spark)
    sizes = chunk_rows.groupBy("name", "chapter_no").agg(F.count("*").alias("__n"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = sizes.repartitionByRange(ranges, "name", "chapter_no").withColumn("__range", F.spark_partition_id()).checkpoint()
    sum_before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("__range").agg(F.sum("__n").alias("__total")).select("__range", sum_before("__total", Window.orderBy("__range")).alias("__base"))
    before = F.col("__base") + sum_before("__n", Window.partitionBy("__range").orderBy("name", "chapter_no"))
    starts = ranged.join(F.broadcast(totals), "__range").select("name", "chapter_no", before.alias("__before"))
    number = F.col("__before") + F.col("chunk_no")
    return chunk_rows.join(starts, ["name", "chapter_no"]).withColumn("chunk_id", F.format_string("chunk_%05d", number)).drop("__before")
