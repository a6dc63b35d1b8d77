"""Word arithmetic on Arrow string columns, vectorised over bytes.

Tasks receive Arrow batches; these helpers cut them into slices of about a
quarter of a megabyte and find words, word hashes and n-gram hashes with NumPy, so that no
Python code runs per word.  UTF-8 guarantees that a separator byte below 0x80
never occurs inside another character, which makes bytes enough to find words.

Hashes are 64 bits.  That of a word or line sums a mixed value of each byte and its
place, so no text is built that collides whatever the constants are, as there is for a
polynomial modulo 2**64 (two complementary Thue-Morse words of 1,024 letters).  Runs of
words are a polynomial over such hashes; they are far shorter than what that takes.  All
depend on content alone, never on the process, so tasks on different machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = 0x9E3779B97F4A7C15
_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 64), base, U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums that let ``span_hash`` hash any run of ``values``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _table(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal content, equal hash."""
    inverse = _table(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


_PLACES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_places: dict[int, np.ndarray] = {}


def stretch_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair, none of them empty; ``which`` of two independent hashes."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    first = np.cumsum(size) - size
    every = np.arange(first[-1] + size[-1])
    place = every - np.repeat(first, size)
    have = _places.get(which)
    if have is None or len(have) <= place.max():
        have = _places[which] = mix(np.arange(1, max(1 << 12, int(place.max()) + 2), dtype=U64) * U64(_PLACES[which]))
    with np.errstate(over="ignore"):
        x = values[place + np.repeat(start, size)] + have[place]
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        return mix(np.add.reduceat(x, first) + size.astype(U64))


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


@dataclass(frozen=True)
class Rule:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    word: np.ndarray
    value: np.ndarray


#: Words are runs without ASCII white space.
PLAIN = Rule(~_byte_set((0x20, 0x20), (0x09, 0x0D)), _BYTE_VALUE)
_lower = np.arange(256)
_lower[0x41:0x5B] += 0x20
#: Words are runs of letters and digits; ASCII case is folded.
FOLDED = Rule(_byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)), _BYTE_VALUE[_lower])


class Slice:
    """The bytes of some consecutive texts; ``bounds[i]:bounds[i+1]`` is text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Cut a batch at rows so that each piece holds about ``limit`` bytes of text.

    A longer text is a piece of its own, whole.  Null texts read as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        j = min(j, len(texts))
        yield batch.slice(i, j - i), Slice(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


class Words:
    """Words of a slice in order: their text's row, byte span and hash."""

    def __init__(self, piece: Slice, rule: Rule = PLAIN):
        data, bounds = piece.data, piece.bounds
        inside = rule.word[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        before[edges], after[edges - 1] = False, False
        self.rows = len(piece)
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)  # first[i]:first[i+1] are the words of text i
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self.inside, self.rule, self.piece = inside, rule, piece
        self._prefix: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = running(self.rule.value[self.piece.data])
        return self._prefix

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.stretches(self.start, self.end)
        return self._hash

    def stretches(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of bytes[start:end] under the rule; ``which`` of two independent ones."""
        return stretch_hash(self.rule.value[self.piece.data], start, end, which)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of n words of one text."""
        at = np.flatnonzero(self.row[: max(0, len(self.row) - n + 1)] == self.row[n - 1 :])
        return at, span_hash(running(self.hash), at, at + n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of n words; a text of fewer words, but some, is one run."""
        at, value = self.grams(n)
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if not len(short):
            return self.row[at], value
        whole = span_hash(running(self.hash), self.first[short], self.first[short + 1])
        row, value = np.concatenate([self.row[at], short]), np.concatenate([value, whole])
        order = np.argsort(row, kind="stable")
        return row[order], value[order]


def distinct_in_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, times), sorted by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed long."""
    return np.ascontiguousarray(x, U64).view(np.int64)


def sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` consecutive values."""
    have, out = 1, x
    while 2 * have <= width:
        out = f(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (f(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out
