import os
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinloom.llm.queries import URL_RULES
from kinloom.llm.urls import judge_urls, mine_rules, tokens_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
URLS = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://a.COM/x?y", "a.com", "/x", "com/"), ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/"),
    ("http://www.example.com/en/#t", "www.example.com", "/en/", "www.example.com/en/"), ("https://m.x.net/es/9", "m.x.net", "/es/9", "net/es/"),
    ("https://x.net/fr", "x.net", "/fr", None), ("ftp://notcom/", "notcom", "/", None), ("http://com", "com", "", None), ("a://b://c/d", "b:", "//c/d", None),
]
VERDICTS = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def words(url):
    """Tokens of a URL, by Python."""
    url = url or ""
    if "://" not in url:
        return set()
    host, path, query = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url).groups()
    cut = lambda tag, part: {tag + w for w in re.findall(r"[^\W\d_]+|[^\W\d_#]*#[^\W\d_]*", re.sub("[0-9]+", "#", (part or "").lower()))}
    return cut("h:", host) | cut("p:", path) | cut("q:", query)


def apriori(examples, support, confidence):
    """Minimal token sets that are often enough blocked, by counting every subset."""
    count, bad = {}, {}
    for tokens, blocked in examples:
        for k in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), k):
                count[s] = count.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + blocked
    good = [set(s) for s in count if bad[s] >= support * len(examples) and bad[s] / count[s] >= confidence]
    return sorted(sorted(s) for s in good if not any(t < s for t in good))


@pytest.mark.parametrize(("support", "confidence"), [(0.05, 0.95), (0.1, 0.7), (0.15, 0.3)])
def test_mined_rules_are_those_of_apriori(spark, support, confidence):
    examples = [({f"t{x}" for x in range(6) if (k * 7919 + x * x * 31) % (x + 2) == 0} | {f"u{k % 4}"}, (k % 4 == 1) or (k % 6 == 0 and k % 5 > 0)) for k in range(200)]
    rows = spark.createDataFrame([(sorted(t), b) for t, b in examples], "tokens array<string>, blocked boolean")
    mined = mine_rules(rows, support, confidence)
    assert sorted(r for r, _ in mined) == apriori(examples, support, confidence) and mined


def test_mined_rules_decide_about_standard_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    found = judge_urls(pages, URL_RULES).collect()
    assert [set(r.t) for r in pages.select(tokens_of(F.col("url")).alias("t")).collect()] == [words(r.url) for r in found]
    examples = [(words(r.url), VERDICTS[r.rule] == "block") for r in found if r.rule]
    rules = [set(r) for r in apriori(examples, 0.005, 0.95)]
    unruled = [r for r in found if not r.rule]
    want = {r.page_id: "block" if any(rule <= words(r.url) for rule in rules) else "allow" for r in unruled}
    assert {r.page_id: r.verdict for r in unruled} == want
    assert 0 < sum(v == "block" for v in want.values()) < len(found)


def test_urls_match_rules(spark):
    pages = spark.createDataFrame([(i, u[0], 7) for i, u in enumerate(URLS)], "page_id long, url string, host long")
    for r in judge_urls(pages, URL_RULES, min_support=0.9).collect():
        _, host, path, rule = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == VERDICTS.get(rule, "allow")


@pytest.mark.parametrize("label", [True, False])
def test_mined_rules_block_combinations(spark, label):
    bad = [(f"http://shop{i}.io/casino/{i}", True) for i in range(30)]
    good = [(f"http://shop{i}.io/books/{i}", False) for i in range(30)] + [(f"http://site{i}.org/casino/", False) for i in range(30)]
    labelled = spark.createDataFrame(bad + good, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://other.io/casino/77"), (2, "http://other.org/casino/"), (3, "http://other.io/books/1")], "page_id long, url string")
    found = {r.page_id: r.verdict for r in judge_urls(pages, [], labelled if label else labelled.limit(0), min_support=0.1).collect()}
    assert found == {1: "block" if label else "allow", 2: "allow", 3: "allow"}


def test_urls_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_repeated_rows_and_long_urls(spark):
    long = "http://a.io/" + "x/" * 50_000 + "casino?q=1"
    bad = [(f"http://s{chr(97 + i)}.io/casino", True) for i in range(20)] + [(f"http://s{chr(97 + i)}.io/books", False) for i in range(20)]
    labelled = spark.createDataFrame(bad, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, None), (None, "http://b.io/CASINO-9", "y")], "page_id long, url string, verdict string")
    found = judge_urls(pages, [], labelled, min_support=0.1)
    assert found.columns == ["page_id", "url", "verdict", "host", "path", "rule"]
    assert sorted((r.page_id or 0, r.verdict) for r in found.collect()) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_shared_words_are_not_enumerated(spark):
    """Thirty words that labelled URLs share, alone or beside a word that makes the difference."""
    shared = "&".join(f"{chr(97 + k % 26)}{'xy'[k // 26]}=v" for k in range(30))
    bad = [(f"http://h.io/bad?{shared}", True) for _ in range(20)] + [(f"http://g.io/{w}?{shared.replace('=v', 'z=v')}", w == "evil") for w in ("evil", "good") for _ in range(20)]
    labelled = spark.createDataFrame(bad, "url string, blocked boolean")
    began = time.time()
    rules = {tuple(r) for r, _ in mine_rules(labelled.select(tokens_of(F.col("url")).alias("tokens"), "blocked"), 0.1, 0.95)}
    assert time.time() - began < 20
    assert {("p:bad",), ("p:evil",), ("q:ax",), ("q:zx",)} <= rules and all(len(r) == 1 for r in rules)


def test_tokens_of_the_same_rows_are_one_part(spark):
    """Tokens that only together with another imply block; each of the alike ones does, and matching by joins agrees."""
    rows = [(["a1", "a2", "b"], True)] * 9 + [(["a1", "a2"], False)] * 9 + [(["b"], False)] * 9 + [(["c", "every"], False)] * 3
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    assert [r for r, _ in mine_rules(labelled, 0.1, 0.9)] == apriori([(set(t), b) for t, b in rows], 0.1, 0.9) == [["a1", "b"], ["a2", "b"]]
    urls = [("http://x.io/aa/bb/cc", True)] * 9 + [("http://x.io/aa/bb", False)] * 9 + [("http://x.io/cc", False)] * 9
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://y.org/bb/cc", "http://y.org/aa/cc", "http://y.org/aa/bb", "http://y.org/cc", None, "http://y.org/bb/cc"])], "page_id long, url string")
    for in_tasks in (0, 100):
        found = judge_urls(pages, [], spark.createDataFrame(urls, "url string, blocked boolean"), min_support=0.1, in_tasks=in_tasks).orderBy("page_id").collect()
        assert [r.verdict for r in found] == ["block", "block", "allow", "allow", "allow", "block"]
        assert found[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict"]
