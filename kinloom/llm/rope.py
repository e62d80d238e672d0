"""Fill-in-the-middle on ropes.

A text is held as a rope: a tree of height that grows with the logarithm of its length, whose leaves are short pieces of text that know how many units (lines) end
in them and how many code points they have; inner nodes know the sums. Two cuts at unit ranks split the rope into prefix, middle and suffix, and the output is
the concatenation of these subtrees with sentinels between them: no piece of text is scanned or copied but the leaves at the cuts. The inverse makes a rope of the output, finds the
sentinels, splits at their code-point ranks, and puts the subtrees back in order.

Defined cases: a null text is empty. A text that is empty or holds a sentinel stays plain, so sentinels in an output are always the operator's own. A null id counts
as an empty string in the hash. Equal rows have equal results. A very long text, or one of a single line, is a rope like others. Other columns pass through, save those
named like a result column, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices_of

#: Code points a leaf holds at most.
LEAF = 1024
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has text; an inner node has two parts. ``ended`` says that a unit ends with the last code point although no line break does."""

    units: int
    points: int
    height: int = 0
    text: str = ""
    ended: bool = False
    parts: tuple[Rope, Rope] | None = None


EMPTY = Rope(0, 0)


def leaf(text: str, ended: bool = False) -> Rope:
    ended = ended and bool(text) and not text.endswith("\n")
    return Rope(text.count("\n") + ended, len(text), 0, text, ended)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.height, b.height), parts=(a, b))


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned where they differ by two."""
    if a.height > b.height + 1:
        x, y = a.parts
        return _node(x, _node(y, b)) if x.height >= y.height else _node(_node(x, y.parts[0]), _node(y.parts[1], b))
    if b.height > a.height + 1:
        x, y = b.parts
        return _node(_node(a, x), y) if y.height >= x.height else _node(_node(a, x.parts[0]), _node(x.parts[1], y))
    return _node(a, b)


def joined(a: Rope, b: Rope) -> Rope:
    """The concatenation, in steps that grow with the difference of heights."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _balanced(a.parts[0], joined(a.parts[1], b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.parts[0]), b.parts[1])
    return _node(a, b)


def rope(text: str) -> Rope:
    """A rope of a text; its last unit ends with it."""
    level = [leaf(text[i : i + LEAF], i + LEAF >= len(text)) for i in range(0, len(text), LEAF)] or [EMPTY]
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split(r: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    """(the first ``rank`` units or code points, the rest)."""
    whole = r.units if by_units else r.points
    if rank <= 0:
        return EMPTY, r
    if r.parts is None:
        if by_units:
            at = r.points if rank > whole - r.ended else -1
            for _ in range(rank if at < 0 else 0):
                at = r.text.index("\n", at + 1)
            at += rank <= whole - r.ended
        else:
            at = min(rank, r.points)
        return leaf(r.text[:at], r.ended and at == r.points), leaf(r.text[at:], r.ended)
    a, b = r.parts
    held = a.units if by_units else a.points
    if rank <= held:
        x, y = split(a, rank, by_units)
        return x, joined(y, b)
    x, y = split(b, rank - held, by_units)
    return joined(a, x), y


def leaves(r: Rope) -> Iterator[str]:
    waiting = [r]
    while waiting:
        top = waiting.pop()
        if top.parts is None:
            yield top.text
        else:
            waiting += reversed(top.parts)


def find(r: Rope, what: str) -> int:
    """The code-point rank of the first occurrence, or -1; occurrences may lie across leaves."""
    before, tail = 0, ""
    for text in leaves(r):
        at = (tail + text).find(what)
        if at >= 0:
            return before - len(tail) + at
        before += len(text)
        tail = (tail + text)[-(len(what) - 1) :] if len(what) > 1 else ""
    return -1


def rearranged(text: str, cuts: tuple[int, int], spm: bool, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[str, int, int]:
    """The output, and the code points of prefix and middle; the cuts are unit ranks in order."""
    front, suffix = split(rope(text), cuts[1], True)
    prefix, middle = split(front, cuts[0], True)
    p, s, m = (leaf(x) for x in sentinels)
    out = EMPTY
    for part in (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle):
        out = joined(out, part)
    return "".join(leaves(out)), prefix.points, middle.points


def put_back(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    rest, parts = rope(output), {}
    for here, following in ((s, p), (p, m), (m, None)) if form == "spm" else ((p, s), (s, m), (m, None)):
        _, rest = split(rest, len(here), False)
        parts[here], rest = split(rest, rest.points if following is None else find(rest, following), False)
    return "".join(leaves(joined(joined(parts[p], parts[m]), parts[s])))


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    Cuts and form follow from the hash of seed and id, so a task that is run again gives the same rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    picked = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    names = picked.columns
    # the row goes along as one struct, so that no name can clash with the operator's own columns
    hashes = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    full = picked.select(F.struct("*").alias("row"), hashes.alias("hashes"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([*picked.schema.fields, *[T.StructField(k, t) for k, t in RESULTS.items()]])

    def turn(text: str, h: list[int]) -> tuple:
        n = text.count("\n") + (text != "" and not text.endswith("\n"))
        if not text or any(x in text for x in sentinels) or h[2] % 100 >= percent:
            return n, "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        spm = h[3] % 100 < spm_percent
        output, prefix, middle = rearranged(text, (low, high), spm, sentinels)
        return n, "spm" if spm else "psm", prefix, middle, output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices_of(batch["text"]):
                rows = list(map(turn, texts.to_pylist(), batch["hashes"].slice(first, len(texts)).to_pylist()))
                own = [pa.array(x, pa.string() if isinstance(t, T.StringType) else pa.int64()) for x, t in zip(zip(*rows, strict=True), RESULTS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(batch["row"].slice(first, len(texts)).flatten() + own, names=[*names, *RESULTS])

    return full.mapInArrow(run, schema)


def restore(found: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds restored, the text that was rearranged, from output and form alone."""
    picked = found.select(*[F.col(f"`{c}`") for c in found.columns if c != "restored"])
    names = picked.columns
    output, form = names.index(output_col), names.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices_of(batch.column(output)):
                part = batch.slice(first, len(texts))
                back = [t if t is None else put_back(t, f, sentinels) for t, f in zip(texts.to_pylist(), part.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], names=[*names, "restored"])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields, T.StructField("restored", T.StringType())]))
