"""Token ids by the tokenizers library, with memos of the pieces and units between which a tokenizer can never merge.

Both vocabularies split a text before they merge. A text is first cut into pieces at white space (a byte-level vocabulary starts
a new unit at every space that is followed by a non-space; a word-level one drops white space), and a text's ids are its pieces'
ids, one after the other. Arrow cuts a batch and numbers its distinct pieces; each that the memo lacks is encoded once, and the batch's ids are
gathered from the memo's table. A piece of Latin letters is cut into the vocabulary's units by its published pattern, and each unit goes to the
library's BPE model once; other pieces are encoded whole. The memos are emptied when they are full, so memory is bounded by them and a batch.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that starts no piece in a byte-level vocabulary, and the spaces that do.
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_PIECE_SPACE = re.compile(r" (?=\S)")
_LATIN = re.compile("[\n\x21-\x7e\xa1-ɏ]*")
#: Fixed values of the two vocabularies: their patterns of units.
UNITS = {
    "bytes": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "words": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def latin_units(kind: str) -> re.Pattern:
    """The pattern of units for Latin pieces joined by spaces; a word-level one also finds the spaces."""
    shown = sorted({x for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) for x in chr(c) + chr(c).lower()})
    held = {x: re.escape("".join(c for c in shown if unicodedata.category(c)[0] == x)) for x in "LN"}
    text = re.sub(r"\[?(\^\\s)?((?:\\p\{[LN]\})+)\]?", lambda m: "[" + (m[1] or "") + "".join(held[x] for x in re.findall("[LN]", m[2])) + "]", UNITS[kind])
    return re.compile(text + ("| " if kind == "words" else ""))


def byte_symbols() -> dict[int, int]:
    """The printable character that stands for each byte: itself, or for the others the next free ones from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class _Table(dict):
    """Row numbers by key; a row's ids are flat[begin[row] : begin[row + 1]]."""

    def __init__(self) -> None:
        super().__init__()
        self.flat, self.begin = array("I"), array("q", [0])

    def empty(self) -> None:
        self.clear()
        self.flat, self.begin = array("I"), array("q", [0])

    def put(self, keys: list[str], ids: list[list[int]]) -> None:
        """New rows."""
        self.put_flat(keys, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def put_flat(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.begin) - 1
        self.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.begin.frombytes((np.cumsum(sizes) + len(self.flat)).tobytes())
        self.flat.frombytes(flat.tobytes())

    def rows(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        begin = np.frombuffer(self.begin, np.int64)
        return begin[rows + 1] - begin[rows]

    def gathered(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the rows, one row after the other."""
        n = self.sizes(rows)
        at = np.repeat((np.frombuffer(self.begin, np.int64)[rows] - (np.cumsum(n) - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return np.frombuffer(self.flat, np.uint32)[at]


class Encoder:
    """encode() gives the ids of texts, each with ``end_id`` after it.

    kind: ``bytes`` (byte-level, white space kept) or ``words`` (white space dropped).
    """

    def __init__(self, path: str, kind: str, end_id: int, memo: int = 300_000, units: int = 700_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.kind, self.end, self.limit, self.unit_limit = kind, end_id, memo, units
        self.pieces, self.units = _Table(), _Table()
        self.pattern = latin_units(kind)

    def _alone(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _shown(self, unit: str) -> str:
        return unit if unit.isascii() and unit.isalnum() else unit.encode().decode("latin-1").translate(self.symbols)

    def _learn_plain(self, keys: list[str]) -> None:
        """Encodes distinct pieces of Latin letters, by their units."""
        space = " " if self.kind == "words" else ""
        line = "".join([space + k for k in keys])
        if space:
            line = line.lower()  # these characters are composed already, and have no lower case that depends on their place
        units = pa.array(self.pattern.findall(line), pa.string()).dictionary_encode()
        distinct = _strings(units.dictionary)
        if len(self.units) > self.unit_limit:
            self.units.empty()
        new = [u for u in distinct if u not in self.units]
        tokenize = self.model.tokenize
        self.units.put(new, [[t.id for t in tokenize(self._shown(u))] if u != space else [] for u in new])
        rows, of = self.units.rows(distinct), units.indices.to_numpy()
        first = np.flatnonzero(pc.starts_with(units.dictionary, " ").to_numpy(zero_copy_only=False)[of])
        if len(first) != len(keys):
            raise AssertionError("a piece was split at other places than its spaces")
        self.pieces.put_flat(keys, self.units.gathered(rows[of]), np.add.reduceat(self.units.sizes(rows[of]), first))

    def _learn(self, keys: list[str]) -> None:
        """Encodes distinct pieces. Byte-level ones but a text's first come with the space before them."""
        if self.kind == "words":
            plain = [k for k in keys if _LATIN.fullmatch(k)]
        else:
            plain = [k for k in keys if k[:1] == " " and k[1:2] > " " and _LATIN.fullmatch(k, 1)]
        if plain:
            self._learn_plain(plain)
        if len(plain) < len(keys):
            other = [k for k in keys if k not in self.pieces]
            self.pieces.put(other, [self._alone(k) for k in other])

    def _split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the number of each piece of all texts in order, and how many pieces each text has."""
        if self.kind == "words":
            found = pc.ascii_split_whitespace(texts)
            pieces = found.flatten().dictionary_encode()
            return _strings(pieces.dictionary), pieces.indices.to_numpy(), pc.list_value_length(found).to_numpy().astype(np.int64)
        odd = [k for k, t in enumerate(_strings(texts)) if _ODD_SPACE.search(t)]
        found = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(found).to_numpy().astype(np.int64)
        pieces = found.flatten().dictionary_encode()
        of = pieces.indices.to_numpy().copy()
        keys = [" " + p for p in _strings(pieces.dictionary)]
        first = np.cumsum(sizes) - sizes
        cut = [_PIECE_SPACE.split(texts[k].as_py()) for k in odd]
        numbers: dict[str, int] = {}
        number = lambda key: len(keys) + numbers.setdefault(key, len(numbers))
        heads = [number(found[k][0].as_py()) for k in range(len(texts))]
        of[first] = heads
        if odd:
            parts, at = [], 0
            for k, words in zip(odd, cut, strict=True):
                parts += [of[at : first[k]], np.array([number(words[0]), *[number(" " + w) for w in words[1:]]], of.dtype)]
                at = first[k] + sizes[k]
                sizes[k] = len(words)
            of = np.concatenate([*parts, of[at:]])
        return [*keys, *numbers], of, sizes

    def rest(self) -> None:
        """Empties the memos."""
        self.pieces.empty()
        self.units.empty()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, each with the end id; and how many ids each text has. A null text is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, of, pieces = self._split(pc.fill_null(texts.cast(pa.string()), ""))
        if len(self.pieces) > self.limit or len(self.pieces.flat) > 16 * self.limit:
            self.pieces.empty()
        self._learn([k for k in keys if k not in self.pieces])
        rows = self.pieces.rows(keys)[of]
        ends = np.cumsum(pieces)
        total = np.concatenate([[0], np.cumsum(self.pieces.sizes(rows))])
        stops = total[ends]
        ids = np.insert(self.pieces.gathered(rows), stops, self.end)
        return ids, np.diff(stops, prepend=0) + 1


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, end_id: int) -> Encoder:
    """One encoder a worker process, so that its memo outlives a task."""
    key = (path, kind, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
