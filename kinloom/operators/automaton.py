"""Many words at once in each text, by an Aho-Corasick automaton that every task builds from a bounded table of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many characters go to all tasks at most: an automaton takes some 50 bytes for each.
SMALL = 2_000_000


def small(words: DataFrame, bound: int = SMALL) -> list[tuple] | None:
    """The rows of a table of strings without nulls if their characters number ``bound`` at most (a row counts one more), else None. Their number is summed first."""
    total = words.agg(F.coalesce(F.sum(sum((F.length(c) for c in words.columns), F.lit(1)).cast("long")), F.lit(0))).first()[0]
    return [tuple(row) for row in words.collect()] if total <= bound else None


def in_blocks(words: DataFrame, most: int, bound: int = SMALL) -> list[list[tuple]] | None:
    """As small(), but up to ``most`` lists of about that size, dealt by hash; None if there would be more."""
    total = words.agg(F.coalesce(F.sum(sum((F.length(c) for c in words.columns), F.lit(1)).cast("long")), F.lit(0))).first()[0]
    n = -(-total // bound) if bound else most + 1
    if n > most:
        return None
    if n < 2:
        return [[tuple(row) for row in words.collect()]]
    dealt = words.withColumn("__k", F.pmod(F.xxhash64(*words.columns), F.lit(n))).checkpoint()
    return [[tuple(row) for row in dealt.where(F.col("__k") == k).drop("__k").collect()] for k in range(n)]


def automaton(words: Iterable[str]) -> ahocorasick.Automaton:
    """Finds all of the words, those within others and overlapping ones too; the empty word is left out."""
    out = ahocorasick.Automaton()
    for word in words:
        if word:
            out.add_word(word, word)
    out.make_automaton()
    return out


def places(look: ahocorasick.Automaton, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, place of its first character) of each occurrence, by the place of the last character."""
    if text and len(look):
        for end, word in look.iter(text):
            yield word, end - len(word) + 1


def cut(text: str, word: str, at: int, around: int) -> str:
    """A word with its surroundings."""
    return text[max(at - around, 0) : at + len(word) + around].strip()


def digest(passage: str, alike: int = 80) -> bytes:
    """Of a passage's first characters."""
    return hashlib.md5(passage[:alike].encode()).digest()


class Passages:
    """The passages (word, place, digest of their beginning) of words in one task's books that may be among the first ``most`` of their word by book and place.

    After a find, the search for the same word goes on behind its surroundings. Passages that begin alike (``alike`` characters) count once. One is left out only
    if the task has given ``most`` earlier ones of its word that begin differently; of these the places and digests are held.
    """

    def __init__(self, look: ahocorasick.Automaton, around: int, most: int, alike: int = 80):
        self.look, self.around, self.most, self.alike = look, around, most, alike
        self.first: dict[str, list[tuple[str, int, bytes]]] = {}

    def of(self, book: str, text: str | None) -> Iterator[tuple[str, int, bytes]]:
        behind: dict[str, int] = {}
        for word, at in places(self.look, text):
            if at < behind.get(word, 0):
                continue
            end = behind[word] = at + len(word) + self.around
            held = self.first.setdefault(word, [])
            if len(held) == self.most and (book, at) > held[-1][:2]:
                behind[word] = len(text)  # nothing later in this book can count
                continue
            begun = digest(cut(text, word, at, self.around), self.alike)
            same = next((x for x in held if x[2] == begun), None)
            if same is not None and same[:2] <= (book, at):
                continue
            if same is not None:
                held.remove(same)
            held.append((book, at, begun))
            held.sort()
            del held[self.most :]
            yield word, at, begun
