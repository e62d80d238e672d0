import re
from collections import Counter

from kinloom.llm.quality import judge_quality

GOOD = " ".join(f"word{i}" for i in range(40))
TEXTS = [None, "", " \n\t", "few words", GOOD, GOOD + "\n" + GOOD, "a b c d e f g h " * 10, "line # one\nline # one\n\n" + GOOD, "\x0b" + GOOD + "\x0c#*$%&|<>", "é " * 30, "one two three four five six seven eight nine " * 20_000, " ".join(f"x{i % 70_001}" for i in range(90_000))]


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(win)
    covered = {i + j for i, x in enumerate(win) if seen[x] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_counts_match_brute_force(spark):
    rows = [(i, t, None if i % 2 else "h", 5) for i, t in enumerate(TEXTS)] * 2
    found = judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, kept long")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id])


def test_bad_hosts_go_whole_and_small_ones_do_not(spark):
    rows = [(i, "spam", "bad") for i in range(60)] + [(100, GOOD, "bad"), (101, "spam", "small"), (102, GOOD, "small")] + [(200 + i, GOOD, f"good{i % 5}") for i in range(50)]
    kept = {r.doc_id for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {102, *range(200, 250)}


def test_empty_table(spark):
    assert judge_quality(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
