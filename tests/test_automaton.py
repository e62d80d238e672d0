"""Names and passages in texts: the automaton and the way by q-grams against plain search."""

import random

import pytest

from kinloom.operators.automaton import Passages, automaton, places
from kinloom.operators.repair import mentions
from kinloom.operators.search import event_snippets, snippet_keywords


def _plain(events, books, limit, around):
    out = []
    for uid, name, description in events:
        found = {}
        for book, text in books:
            for no, word in enumerate(dict.fromkeys(snippet_keywords(name, description))):
                at = (text or "").find(word)
                while at >= 0:
                    end = at + len(word) + around
                    cut = text[max(at - around, 0) : end].strip()
                    found[cut[:80]] = min(found.get(cut[:80], (book, no, at, cut)), (book, no, at, cut))
                    at = text.find(word, end)
        out += [(uid, *x) for x in sorted(found.values())[:limit]]
    return sorted(out)


def test_places():
    look = automaton(["ab", "b", "abab", "", "猫b"])
    assert sorted(places(look, "abab猫b")) == [("ab", 0), ("ab", 2), ("abab", 0), ("b", 1), ("b", 3), ("b", 5), ("猫b", 4)]
    assert not list(places(look, None)) and not list(places(automaton([]), "abc"))
    assert [at for _, at, _ in Passages(automaton(["x"]), 2, 9).of("b", "x1x2x3x4")] == [0, 4]  # "x2" lies in the surroundings of the first, "x4" in those of the third
    first = Passages(automaton(["x"]), 2, 1)
    assert [[at for _, at, _ in first.of(book, text)] for book, text in (("b", "x1x2x3x4"), ("c", "0x"), ("a", "..x9"), ("aa", "x"))] == [[0], [], [2], []]


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_mentions_like_contains(spark, bound):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("ab猫𝄞") for _ in range(n))
    texts = [(i, word(draw.randrange(0, 30))) for i in range(60)] + [(60, None), (61, ""), (3, "again aab"), (62, "ab" * 20_000)]
    names = [(word(draw.randrange(1, 5)), f"u{draw.randrange(15)}") for _ in range(40)] + [(None, "u1"), ("aab", None), ("", "u2"), ("again", "u3"), ("again", "u4")]
    expected = {(i, u) for i, t in texts for n, u in names if t and n and u and len(n) >= 2 and n in t}
    found = mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string, uid string"), bound=bound).collect()
    assert len(found) == len(expected) and {(r.id, r.uid) for r in found} == expected
    none = spark.createDataFrame([], "name string, uid string")
    assert mentions(spark.createDataFrame(texts, "id long, text string"), none, bound=bound).isEmpty()


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_event_snippets_like_a_scan(spark, bound):
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice(["汴州", "汴州之战", "军", "大军", "夜", "a", "b"]) for _ in range(n))
    books = [(f"b{i}", text(draw.randrange(0, 80))) for i in range(8)] + [("none", None), ("empty", ""), ("long", text(3000)), ("zlong", "")]
    books[-1] = ("zlong", books[-2][1])  # an exact copy: its passages are those of the first
    events = [("e1", "汴州之战", "大军夜袭汴州"), ("e2", "大军", None), ("e3", None, None), ("e4", "之战", ""), ("e5", "汴州之战", "大军夜袭汴州"), ("e6", "nowhere", "夜 汴州")]
    for limit in (1, 4):
        found = event_snippets(spark.createDataFrame(events, "uid string, name string, description string"), spark.createDataFrame(books, "name string, text string"), limit, 15, bound)
        assert sorted((r.uid, r.book, r.keyword_no, r["at"], r.text) for r in found.collect()) == _plain(events, books, limit, 15)


def test_a_word_of_all_books(spark):
    """A word in every book sends a bounded number of rows to its events."""
    books = spark.range(300).selectExpr("lpad(id, 4, '0') AS name", "concat(repeat(concat('x', id, ' word '), 50)) AS text")
    events = spark.range(200).selectExpr("concat('e', id) AS uid", "'word' AS name", "'' AS description")
    found = event_snippets(events, books, 2, 3)
    assert found.count() == 400 and {r.book for r in found.select("book").distinct().collect()} == {"0000"}
