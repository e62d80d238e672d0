"""URL filtering: host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL's tokens are all words of its host, path and query. Mining runs on Spark ML over every labelled URL; those that no rule fits and that have no
label are left out, so they are neither good nor bad examples. A rule is a set of tokens whose presence implies the label
``block``; rules below the confidence or support threshold, and rules that contain a shorter kept rule, are pruned.

FP-growth lists every frequent set, also those that hold a shorter rule. So tokens are first counted by themselves: one that implies ``block`` alone is a rule and is
mined no further, one that is in every URL or in too few blocked ones can be in no rule, and tokens found in the same URLs (the parameters of a
tracker) are mined as one. Rules that hold a shorter one are taken out by a join on Spark. What is left to enumerate are frequent combinations of tokens that differ in
their URLs; their number can still grow with the words that many labelled URLs share without being alike.

Matching uses an inverted index from one part of each rule (that with the fewest tokens) to the rule, so a URL is only held against rules that
share that token. Up to IN_TASKS rules are sent to the tasks; more stay on Spark and are joined.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens, and the verdict ``allow`` unless
a rule with an empty host fits. Repeated rows are judged alike, and each counts in mining. A very long URL is judged by all its words. An empty table gives
an empty result. Other columns of the input are kept; a column that clashes with a result column is replaced by it.
"""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import stored

BLOCK = "label=block"
#: Rules up to which each task gets them all.
IN_TASKS = 50_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (host, path) rule that fits, as ``host + path``, and its verdict; null where none fits."""
    name = verdict = None
    for verdict_, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        fits = on_host & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, verdict_) if verdict is None else verdict.when(fits, verdict_)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct words of host (h:), path (p:) and query (q:), in lower case, digits written as #."""
    def tagged(tag: str, part: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(F.lower(part), "[0-9]+", "#"), F.lit(r"[\p{L}#]+"), 0)
        return F.transform(found, lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(F.concat(tagged("h:", host_of(url)), tagged("p:", path_of(url)), tagged("q:", query_of(url))))


def mine_parts(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(parts array<array<string>>, confidence): minimal rules, from rows (tokens array, blocked boolean). A rule fits where each part has one of its tokens; tokens of
    one part occur in the same labelled rows."""
    spark = labelled.sparkSession
    numbered = labelled.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "blocked")
    rows = stored(numbered, "labelled")  # written, so that a row keeps its number
    total = rows.count()
    least = max(1, math.ceil(min_support * total - 1e-9))
    seen = rows.select("id", "blocked", F.explode("tokens").alias("token"))
    bits = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"h{k}") for k in range(2)]
    counted = stored(seen.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"), *bits).where(F.col("bad") >= least), "tokens")
    alone = F.col("bad") / F.col("n") >= min_confidence
    single = counted.where(alone).select(F.array(F.array("token")).alias("parts"), (F.col("bad") / F.col("n")).alias("confidence"))
    # tokens of the same rows become one item, named by the first of them
    alike = counted.where(~alone & (F.col("n") < total)).groupBy("n", "bad", "h0", "h1").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("part")).select("item", "part")
    items = seen.join(alike.select("item"), F.col("token") == F.col("item")).groupBy("id").agg(F.collect_list("item").alias("items"))
    items = rows.select("id", "blocked").join(items, "id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    items = items.select(F.when(F.col("blocked"), F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items")).persist(StorageLevel.DISK_ONLY)
    try:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(total, 1), minConfidence=min_confidence).fit(items)
        found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.sort_array("antecedent").alias("items"), "confidence")
        found = stored(found, "rules")
    finally:
        items.unpersist()
    small = found.select(F.col("items").alias("small"), F.element_at("items", 1).alias("item"))
    larger = found.select("items", F.explode("items").alias("item")).join(small, "item").where((F.size("small") < F.size("items")) & (F.size(F.array_except("small", "items")) == 0))
    minimal = found.join(larger.select("items").distinct(), "items", "left_anti")
    parts = minimal.select("items", "confidence", F.explode("items").alias("item")).join(alike, "item").groupBy("items", "confidence").agg(F.collect_list("part").alias("parts"))
    return stored(single.union(parts.select("parts", "confidence")), "mined")


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.95) -> list[tuple[list[str], float]]:
    """Token sets that imply ``block``, from rows (tokens array, blocked boolean); minimal sets only. All sets that a rule's parts stand for are listed: for looking at."""
    if labelled.isEmpty():
        return []
    return sorted((sorted(tokens), r.confidence) for r in mine_parts(labelled, min_support, min_confidence).collect() for tokens in product(*r.parts))


def matches(tokens: Column, mined: list[list[list[str]]]) -> Column:
    """True where every part of a mined rule has a token, looked up by the part with the fewest."""
    index: dict[str, list[list[set[str]]]] = {}
    for rule in mined:
        parts = list(map(set, rule))
        for token in min(rule, key=len):
            index.setdefault(token, []).append(parts)

    @F.pandas_udf("boolean")
    def hit(found: pd.Series) -> pd.Series:
        return pd.Series([any(all(part & have for part in rule) for t in have if t in index for rule in index[t]) for have in map(set, found)], dtype=bool)

    return hit(tokens)


def matching(tokens: DataFrame, mined: DataFrame) -> DataFrame:
    """The distinct lists of tokens (one column) that a rule fits, by joins alone."""
    fewest = F.element_at(F.array_sort(F.transform("parts", lambda p: F.struct(F.size(p).alias("n"), p.alias("part")))), 1)["part"]
    keyed = mined.select(F.explode(fewest).alias("__key"), "parts")
    lists = tokens.toDF("__tokens").distinct()
    met = lists.select("__tokens", F.explode("__tokens").alias("__key")).join(keyed, "__key")
    return met.where(F.forall("parts", lambda p: F.arrays_overlap(p, F.col("__tokens")))).select("__tokens").distinct()


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labelled: DataFrame | None = None,
    url_col: str = "url",
    min_support: float = 0.005,
    min_confidence: float = 0.95,
    in_tasks: int = IN_TASKS,
) -> DataFrame:
    """Adds host, path, rule and verdict. labelled: rows (url, blocked) to mine from.

    Without labelled rows of its own, the filter learns from the listed rules: a URL that a block rule decides is a bad example, one that an
    allow rule decides a good one, and the others teach nothing.
    """
    host, path, tokens = host_of(F.col(url_col)), path_of(F.col(url_col)), tokens_of(F.col(url_col))
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    found = pages.withColumns({"__tokens": tokens, "__host": host, "__path": path}).withColumns({"__rule": rule, "__verdict": verdict})
    if labelled is None:
        examples = found.where("__verdict IS NOT NULL").select(F.col("__tokens").alias("tokens"), (F.col("__verdict") == "block").alias("blocked"))
    else:
        examples = labelled.select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    hit = F.lit(False)
    if not examples.isEmpty():
        mined = mine_parts(examples, min_support, min_confidence)
        if mined.count() > in_tasks:
            fits = matching(found.where("__verdict IS NULL").select("__tokens"), mined).withColumn("__hit", F.lit(True))
            found, hit = found.join(fits, "__tokens", "left"), F.coalesce("__hit", F.lit(False))
        else:
            hit = matches(F.col("__tokens"), [r.parts for r in mined.select("parts").collect()])
    learned = F.when(hit, "block").otherwise("allow")
    results = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"), "verdict": F.coalesce("__verdict", learned)}
    return found.withColumns(results).drop("__tokens", "__host", "__path", "__rule", "__verdict", "__hit")
