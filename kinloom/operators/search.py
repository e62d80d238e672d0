"""Full-text search by BM25 and snippets around keywords."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import checkpoint_dir
from .automaton import SMALL, Passages, automaton, cut, digest, in_blocks
from .order import spread
from .repair import by_grams

#: Books are read so often at most for keywords that are too many for one automaton.
BLOCKS = 16
TOKEN = r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, and single Han characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[a-z0-9]+|[一-鿿]", query.lower())))


def search(docs: DataFrame, text: Column, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """keys and score of the best rows. One scan counts the query's terms in each row without exploding it; corpus figures (a row) come first."""
    terms = query_tokens(query)
    if not terms:
        return docs.select(*keys, F.lit(0.0).alias("score")).where("false")
    counted = docs.select(*keys, tokens(text).alias("__t"))
    uses = lambda term: F.size(F.filter("__t", lambda x: x == term)).cast("double")
    tf = [uses(t).alias(f"__f{i}") for i, t in enumerate(terms)]
    counted = counted.select(*keys, F.size("__t").cast("double").alias("__n"), *tf)
    seen = counted.agg(F.count("*").alias("rows"), F.sum("__n").alias("words"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"d{i}") for i in range(len(terms))]).first()
    rows, mean = seen["rows"], (seen["words"] or 0.0) / max(seen["rows"], 1) or 1.0
    parts = []
    for i in range(len(terms)):
        df, f = seen[f"d{i}"], F.col(f"__f{i}")
        idf = F.log(F.lit(1 + (rows - df + 0.5) / (df + 0.5)))
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / mean)))
    score = sum(parts[1:], parts[0])
    hit = counted.where(" OR ".join(f"__f{i} > 0" for i in range(len(terms))))
    return hit.select(*keys, F.round(score, 6).alias("score")).orderBy(F.desc("score"), *keys).limit(limit)


def search_persons(person: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """By name where one equals the query (U-2), else by full text."""
    exact = person.where((F.col("original_name") == query) | F.array_contains("aliases", query)).select("uid", F.lit(None).cast("double").alias("score"))
    if not exact.isEmpty():
        return exact
    return search(person, F.concat_ws(" ", "original_name", "description"), query, limit)


def snippet_keywords(event_name: str | None, description: str | None) -> list[str]:
    """The bare and the full name, and the first three runs of two to four Han characters of the description."""
    bare = re.sub("之战|之变|事件", "", event_name or "")
    runs = re.findall("[一-鿿]{2,4}", (description or "")[:100])[:3]
    return [*([bare] if event_name and len(bare) >= 2 else []), *([event_name] if event_name else []), *runs]


def _places(text: str, keyword: str, around: int) -> Iterator[tuple[str, int]]:
    """(surroundings, place) of a keyword; after a find the search goes on behind its surroundings."""
    at = text.find(keyword) if keyword else -1
    while at >= 0:
        end = at + len(keyword) + around
        yield text[max(at - around, 0) : end].strip(), at
        at = text.find(keyword, end)


_SNIPPET = pa.schema([("book", pa.string()), ("keyword", pa.string()), ("text", pa.string()), ("keyword_no", pa.int32()), ("at", pa.int32())])


def snippets(books: DataFrame, keywords: list[str], limit: int = 3, around: int = 200, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(book, keyword, text, keyword_no, at): keyword places with their surroundings, in order of book, keyword and place.

    Snippets that begin alike (80 characters) count once. A task holds and sends the first ``limit`` of its books alone: a snippet behind so many others of one task, all of which begin differently,
    has as many before it in the whole.
    """
    wanted = list(dict.fromkeys(keywords))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, tuple] = {}
        last = None  # no snippet behind this place counts any more
        for batch in batches:
            for book, text in zip(batch.column("book"), batch.column("text"), strict=True):
                book = book.as_py()
                name = (book is not None, book or "")
                if last is not None and name > last[:2]:
                    continue
                text = text.as_py()
                for no, keyword in enumerate(wanted):
                    for cut, at in _places(text, keyword, around):
                        place = (*name, no, at)
                        if last is not None and place > last:
                            break
                        if cut[:80] not in first or place < first[cut[:80]][0]:
                            first[cut[:80]] = place, {"book": book, "keyword": keyword, "text": cut, "keyword_no": no, "at": at}
                        if len(first) >= 2 * limit + 1000:
                            first = dict(sorted(first.items(), key=lambda x: x[1][0])[:limit])
                            last = max((x[0] for x in first.values()), default=(False, "", -1, -1))
        yield pa.RecordBatch.from_pylist([row for _, row in sorted(first.values(), key=lambda x: x[0])[:limit]], _SNIPPET)

    rows = books.select(F.col(name_col).cast("string").alias("book"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    out = rows.mapInArrow(find, "book string, keyword string, text string, keyword_no int, at int")
    first = out.groupBy(F.substring("text", 1, 80).alias("sig")).agg(F.min(F.struct("book", "keyword_no", "at", "keyword", "text")).alias("f"))
    return first.select("f.book", "f.keyword", "f.text", "f.keyword_no", "f.at").orderBy("book", "keyword_no", "at").limit(limit)


def event_snippets(events: DataFrame, books: DataFrame, limit: int = 2, around: int = 200, bound: int = SMALL) -> DataFrame:
    """(uid, book, keyword_no, at, text): the first passages of books (name, text) for each event (uid, name, description), by its keywords.

    Passages of one event that begin alike (80 characters) count once, as the first of them in order of book, keyword and place. Books without a name or text are left out.

    An automaton of all keywords finds places without their texts; the books that hold chosen passages are read once more, each with the list of its own. An event's first ``limit`` passages are among the first ``limit`` of each of its keywords
    that begin differently, in a task's books as in all books, as those come before any later passage of that keyword. So a task that reads books in order sends ``limit`` rows
    for each keyword, and a keyword meets its events with ``limit`` rows, however many books have it. Keywords of more characters than ``bound`` are dealt into blocks, and books are read once for each. Those of more
    than BLOCKS blocks do not go to all tasks: the books that have one are found by by_grams(), and a book is read for its own keywords.
    """
    bare = F.regexp_replace(F.coalesce("name", F.lit("")), "之战|之变|事件", "")
    runs = F.slice(F.regexp_extract_all(F.substring(F.coalesce("description", F.lit("")), 1, 100), F.lit(r"[\x{4e00}-\x{9fff}]{2,4}"), 0), 1, 3)
    listed = F.concat(F.array(F.when(F.length(bare) >= 2, bare), F.col("name")), runs)
    keyed = F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != "")))
    wanted = events.select("uid", F.posexplode(keyed).alias("keyword_no", "keyword"))
    words = wanted.select("keyword").distinct()
    texts = books.select(F.col("name").cast("string").alias("book"), "text").where("book IS NOT NULL AND text IS NOT NULL")
    checkpoint_dir(texts.sparkSession)
    held = in_blocks(words, BLOCKS, bound)
    if held is None:
        hits = by_grams(texts.withColumnRenamed("book", "id"), words.select(F.col("keyword").alias("name"), F.col("keyword").alias("uid")))
        texts = texts.hint("merge").join(hits.groupBy(F.col("id").alias("book")).agg(F.collect_set("uid").alias("words")), "book")
    def find(shared: Broadcast | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = None if shared is None else Passages(automaton(shared.value), around, limit)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rows += [{"book": row["book"], "keyword": word, "at": at, "sig": sig} for word, at, sig in (Passages(automaton(row["words"]), around, limit) if every is None else every).of(row["book"], row["text"])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("book", pa.string()), ("keyword", pa.string()), ("at", pa.int32()), ("sig", pa.binary())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                cuts = [(x, cut(row["text"], x["keyword"], x["at"], around)) for x in row["chosen"]]
                # of books of one name only those that hold the passage count
                rows += [{"book": row["book"], "keyword": x["keyword"], "at": x["at"], "text": text} for x, text in cuts if digest(text) == x["sig"]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("book", pa.string()), ("keyword", pa.string()), ("at", pa.int32()), ("text", pa.string())]))

    alike = F.substring("text", 1, 80).alias("sig")
    place = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    shared = [None] if held is None else [texts.sparkSession.sparkContext.broadcast([word for (word,) in block]) for block in held]
    # each task sends rows for each keyword, so tasks are as many as cores need, not as the files have splits
    scanned = texts if held is None else texts.coalesce(2 * max(1, texts.sparkSession.sparkContext.defaultParallelism))
    parts = [scanned.mapInArrow(functools.partial(find, block), "book string, keyword string, at int, sig binary") for block in shared]
    found = functools.reduce(DataFrame.union, parts)
    first = found.groupBy("keyword", "sig").agg(F.min(F.struct("book", "at")).alias("f")).select("keyword", "sig", "f.*")
    first = first.withColumn("r", place("keyword", "book", "at")).where(F.col("r") <= limit)
    chosen = first.groupBy("book").agg(F.collect_list(F.struct("keyword", "at", "sig")).alias("chosen"))
    first = texts.select("book", "text").join(chosen, "book").mapInArrow(read, "book string, keyword string, at int, text string")
    own = wanted.join(first.hint("merge"), "keyword").groupBy("uid", alike).agg(F.min(F.struct("book", "keyword_no", "at", "text")).alias("f")).select("uid", "f.*")
    return own.withColumn("r", place("uid", "book", "keyword_no", "at")).where(F.col("r") <= limit).drop("r")


#: A stored index: postings sorted by term, so that a scan for some terms prunes by the files' statistics, and one row of corpus figures.
POSTINGS = "term string, key string, tf long, n long"
CORPUS = "rows long, words long"


def write_index(docs: DataFrame, text: Column, path: str, key: str = "uid") -> None:
    """Writes postings (term, key, tf, n: words of the row) and corpus figures below path."""
    # spread, else the few tasks of a small file hold all terms
    held = spread(docs.select(F.col(key).cast("string").alias("key"), text.alias("text")))
    counted = held.select("key", tokens(F.col("text")).alias("t")).withColumn("n", F.size("t").cast("long"))
    rows = counted.select("key", "n", F.explode("t").alias("term")).groupBy("term", "key").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    rows.select("term", "key", "tf", "n").repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/postings")
    counted.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).write.parquet(f"{path}/corpus")


def search_index(spark: SparkSession, path: str, query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the best rows, as by search(), from the postings of the query's terms alone."""
    corpus = spark.read.schema(CORPUS).parquet(f"{path}/corpus").first()
    mean = corpus.words / max(corpus.rows, 1) or 1.0
    hits = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("term").isin(query_tokens(query)))
    used = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (corpus.rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / mean))
    scored = hits.join(used, "term").groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(limit)
