"""Quality rules judged on documents and on their hosts.

Each document is counted once with built-in functions; the counts (no text) are written to the shared folder, summed by
host with map-side partial sums, and the host's failure rate is shrunk towards an empirical beta prior, fitted by the moments
of all hosts' rates. A host whose shrunk rate is above ``host_limit`` with its whole credible margin is rejected with
all its documents; so a host of a few failing documents is judged by its documents alone. Only hosts' sums are joined back; the join splits a hot host
on the documents' side.

Defined cases: a null or empty text has no words and fails. A null host is a host of its own. Null ids are kept. Repeated rows count each. Very long texts
are counted whole. An empty table gives an empty result. Input columns that clash with a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, where the optimizer would else copy it into each step of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more. hashes: each window's hash, by start.

    Windows are sorted by (hash, start); those with a like neighbour repeat; their starts, in order, each cover what the next
    start leaves of a window's length.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1

    def starts(s: Column) -> Column:
        like = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        return F.filter(F.transform(s, lambda x, k: F.when((like(k, k - 1) & (k > 0)) | (like(k, k + 1) & (k < last)), x["i"])), lambda x: x.isNotNull())

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(pairs, lambda s: _let(F.array_sort(starts(s)), covered))


def count_rules(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """Adds the counts of each document and base_failed, all with built-in functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE) != "")
    out = docs.withColumn("__w", words(F.col(text_col))).withColumn("__l", lines)
    n = F.size("__w")
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    hashes = F.transform("__w", lambda w: F.xxhash64(w))  # each word is hashed once, a window from its words' hashes
    windows = F.when(n >= WINDOW, _let(hashes, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))))
    out = out.withColumn("__h", F.coalesce(windows, F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(_without(text, SPACE)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.when(repeated, repeat_words(F.col("__h"))).otherwise(F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__w", "__l", "__h")


def host_verdicts(counted: DataFrame, host_col: str = "source", host_limit: float = 0.5, margin: float = 2.0) -> DataFrame:
    """One row a host: documents, failures, shrunk rate and verdict (host_ok).

    The beta prior has the mean and variance of the hosts' own rates; with fewer than two hosts, or no variance, it
    weighs as two documents at the mean (0.5 if there is none). A host fails if its shrunk rate less ``margin``
    posterior standard deviations is still above host_limit.
    """
    hosts = counted.groupBy(F.col(host_col).alias("__host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    hosts = stored(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    mean = min(max(0.5 if prior.m is None else prior.m, 1e-6), 1 - 1e-6)
    weight = max(mean * (1 - mean) / prior.v - 1, 2.0) if prior.v else 2.0
    a = F.col("host_failed") + mean * weight
    n = F.col("host_docs") + weight
    shrunk = a / n
    sd = F.sqrt(shrunk * (1 - shrunk) / (n + 1))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", shrunk - margin * sd <= host_limit)


def judge_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, host_limit: float = 0.5) -> DataFrame:
    """Adds the counts, base_failed, host_rate and kept. keep: the input columns to carry (default all).

    The counted rows are stored once, so no text is counted twice.
    """
    keep = docs.columns if keep is None else keep
    names = [c for c in keep if c not in {*COUNTS, "kept", "host_rate"}]
    counted = count_rules(docs.select(*dict.fromkeys([*names, host_col, text_col])), text_col)
    counted = stored(counted.select(*dict.fromkeys([*names, host_col]), *COUNTS), "counted")
    hosts = host_verdicts(counted, host_col, host_limit).select("__host", "host_rate", "host_ok")
    out = counted.join(hosts, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    return out.select(*names, *COUNTS, "host_rate", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"))
