"""Encoding and decoding with the pieces of a SentencePiece model of the merge type.

The model joins, again and again, the two neighbours whose union is the piece of
the highest score, the leftmost of equals.  ``encode`` finds the same pieces without
joining, from one table: for every prefix of a text, the last token of its encoding.

* A row of tokens is the encoding of its text if and only if no two neighbours, taken
  alone, join across their border (``Pieces.compatible``).  Joins inside a token
  never depend on what lies beyond its neighbours, so the first join across a border would
  also happen between these two alone.
* So the last token of a prefix is the one piece that ends there (all such pieces are
  found by an Aho-Corasick automaton) and is compatible with the last token of what
  stands before it.  It is unique, as the encoding is.
* The ids are read backwards: the last token of the whole, then that of the rest.

Work is linear in the text, whatever its runs look like.  Two characters that no piece
holds next to each other never join.  Before ASCII characters texts are cut at such places first, so that
each distinct part of a slice of texts is encoded once, and a worker remembers short ones.  A character without a piece is one byte token for
each byte of its UTF-8 form.  The model must leave texts as they are but for a space
in front and U+2581 for spaces; another normaliser is refused.

Edge cases: a null or empty text is the end id alone and decodes to the empty text.  Very long
texts are encoded whole; a part without a cut is one string in a task's memory.  Repeated rows and
null ids keep their rows; ties between pieces of equal score go to the left, as in the model.
Other columns are not read.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .session import prepare

SPACE = "▁"
#: What the unknown id decodes to, as in the model.
UNKNOWN = " ⁇ "
#: Bytes of text that are encoded together, and distinct parts a worker remembers.
SLICE_BYTES, REMEMBERED, LONGEST = 1 << 22, 1 << 19, 64


def joined(symbols: list[str], scores: dict[str, float]) -> Iterator[tuple[int, list[str]]]:
    """(place of the join, symbols after it) of each join, in the model's order."""
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            return
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        yield at, symbols


Border = tuple[str, float, float]


@dataclass
class Pieces:
    """The pieces of a model (fixed size) and what is remembered of them."""

    pieces: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    end_id: int
    control: frozenset[int]
    unknown: int
    #: For each piece that is its own encoding: what stood at its left and its right border while it grew,
    #: with the scores of the joins that made it and that ended it.
    borders: dict[str, tuple[list[Border], list[Border]]] = field(default_factory=dict)
    #: Pieces that grew by joins of ever lower scores; of others, pairs are joined to see whether they stay.
    ordered: set[str] = field(default_factory=set)
    _pairs: dict[int, bool] = field(default_factory=dict)
    _parts: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    _tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": {}, "_parts": {}, "_tables": None}

    def tables(self) -> tuple:
        """The automaton, the pairs of characters that stand side by side in a piece, the pairs of bytes between which texts are cut, and bytes of ids."""
        if self._tables is None:
            automaton = ahocorasick.Automaton()
            for piece in self.borders:
                automaton.add_word(piece, self.ids[piece] << 16 | len(piece))
            automaton.make_automaton()
            beside = {a + b for p in self.borders for a, b in zip(p, p[1:])}
            # A cut stands in front of an ASCII character, behind another that no piece has before it, or before a space behind any byte.
            cut = np.zeros((256, 256), bool)
            shown = [SPACE if b == 32 else chr(b) for b in range(128)]
            for b, y in enumerate(shown):
                cut[:128, b] = [x + y not in beside for x in shown]
                cut[128:, b] = not any(pair[1] == y and ord(pair[0]) > 127 and pair[0] != SPACE for pair in beside)
            as_bytes = [b"" if i in self.control else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
            as_bytes[self.unknown] = UNKNOWN.encode()
            for value, i in enumerate(self.byte_ids):
                as_bytes[i] = bytes([value])
            self._tables = automaton, beside, cut.reshape(-1), pa.array(as_bytes, pa.large_binary())
        return self._tables

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pieces ``left`` and ``right``, side by side, stay as they are.

        They join if what stands at their border at some time is a piece together, of a
        higher score than the join that ends either (of equals the left one goes first).
        """
        a, b = self.pieces[left], self.pieces[right]
        simple = a in self.ordered and b in self.ordered
        for x, born_x, ends_x in self.borders[a][1]:
            for y, born_y, ends_y in self.borders[b][0]:
                score = self.scores.get(x + y)
                if score is None:
                    continue
                if not simple:
                    return all(len(a) in accumulate(map(len, symbols)) for _, symbols in joined(list(a + b), self.scores))
                if score > ends_x and score >= ends_y and born_x >= ends_y and born_y > ends_x:
                    return False
        return True

    def encode(self, part: str) -> list[int]:
        """Ids of a part of a text; spaces are ``SPACE`` already."""
        automaton, beside = self.tables()[:2]
        pairs, compatible = self._pairs, self.compatible
        if len(pairs) > 4 * REMEMBERED:
            pairs.clear()
        last: list[int | None] = [None] * (len(part) + 1)
        # Tokens end at a cut, so what begins there has no neighbour on its left.
        alone = [True, *(a + b not in beside for a, b in zip(part, part[1:])), True]
        for end, value in automaton.iter(part):
            end += 1
            if last[end] is None:
                piece = value >> 16
                if not alone[begin := end - (value & 0xFFFF)]:
                    key = last[begin] << 32 | piece
                    stays = pairs.get(key)
                    if stays is None:
                        stays = pairs[key] = compatible(last[begin], piece)
                    if not stays:
                        continue
                last[end] = piece
        out: list[int] = []
        at = len(part)
        while at:
            piece = last[at]
            if piece is None:  # a character without a piece
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(part[at].encode()))
            else:
                out.append(piece)
                at -= len(self.pieces[piece])
        out.reverse()
        return out

    def remembered(self, part: bytes) -> bytes:
        """Ids of a part in UTF-8, as the bytes of an array."""
        known = self._parts.get(part)
        if known is None:
            known = np.array(self.encode(part.decode().replace(" ", SPACE)), np.int32).tobytes()
            if len(part) <= LONGEST:
                if len(self._parts) >= REMEMBERED:
                    self._parts.clear()
                self._parts[part] = known
        return known

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all ids) of texts in UTF-8, each with the end id."""
        marked = [b" " + t.replace(SPACE.encode(), b" ") if t else t for t in texts]
        bounds = np.append(0, np.cumsum([len(m) for m in marked]))
        data = np.frombuffer(b"".join(marked), np.uint8)
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.tables()[2][data[:-1].astype(np.uint16) << 8 | data[1:]]
        cut[bounds] = True
        offsets = np.flatnonzero(cut) if len(data) else np.zeros(1, np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = [self.remembered(p) for p in parts.dictionary.to_pylist()]
        length = np.array([len(f) // 4 for f in found], np.int64)
        flat = np.frombuffer(b"".join(found), np.int32)
        codes = parts.indices.to_numpy()
        each = length[codes]
        upto = np.append(0, np.cumsum(each))
        ids = flat[np.repeat((np.cumsum(length) - length)[codes] - upto[:-1], each) + np.arange(upto[-1])]
        # The end id follows each text.
        stops = upto[np.searchsorted(offsets, bounds)]
        return np.diff(stops) + 1, np.insert(ids, stops[1:], self.end_id)

    def decode_all(self, ids: pa.Array, bounds: np.ndarray) -> list[str]:
        """Texts of ``ids[bounds[i]:bounds[i + 1]]``; bytes that aren't UTF-8 become U+FFFD one by one."""
        piece_bytes = self.tables()[3]
        pieces = piece_bytes.take(ids)
        if not len(pieces):
            return [""] * (len(bounds) - 1)
        at = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1)
        data = memoryview(pieces.buffers()[2] or b"")
        out = []
        for first, stop in zip(bounds[:-1], bounds[1:], strict=True):
            raw = bytes(data[at[first] : at[stop]])
            shown = next((i for i in range(first, stop) if at[i + 1] > at[i]), None)
            # The space in front is the model's own; a lone space of a byte token isn't.
            if shown is not None and raw[:1] == b" " and ids[shown].as_py() not in (self.unknown, *self.byte_ids):
                raw = raw[1:]
            out.append(utf8(raw))
        return out


def utf8(raw: bytes) -> str:
    out = []
    while True:
        try:
            out.append(raw.decode())
            return "".join(out)
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]


def load(path: str) -> Pieces:
    """The pieces of the model file at ``path``, which only the driver reads."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " ﬁ①  é "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model changes texts; only one that keeps them is supported")
    n = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    if not any(model.is_byte(i) for i in range(n)):
        raise ValueError("the model has no byte tokens")
    control = frozenset(i for i in range(n) if model.is_control(i))
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    out = Pieces(pieces, {pieces[i]: model.get_score(i) for i in plain}, {pieces[i]: i for i in plain}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model.eos_id(), control, model.unk_id())
    times = Counter(out.scores.values())
    for piece in out.scores:
        symbols, made = list(piece), []
        lefts, rights = [[symbols[0], math.inf, -math.inf]], [[symbols[-1], math.inf, -math.inf]]
        for at, symbols in joined(symbols, out.scores):
            made.append(out.scores[symbols[at]])
            for side, here, border in ((lefts, 0, symbols[0]), (rights, len(symbols) - 1, symbols[-1])):
                if at == here:
                    side[-1][2] = made[-1]
                    side.append([border, made[-1], -math.inf])
        if len(symbols) == 1:  # a piece that isn't its own encoding never comes about
            out.borders[piece] = [tuple(x) for x in lefts], [tuple(x) for x in rights]
            if all(x > y for x, y in zip(made, made[1:])) and not any(times[x] > 1 for x in made):
                out.ordered.add(piece)
    return out


def _encode(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch, limit=SLICE_BYTES):
                length, ids = pieces.encode_all([piece.text(i) for i in range(len(piece))])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return rows


def _decode(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.append(0, np.cumsum([0 if x is None else x for x in lists.value_lengths().to_pylist()])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(pieces.decode_all(lists.flatten(), bounds), pa.string())], names=["doc_id", "ids", "text"])

    return rows


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text); the end id is the last."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(pieces)), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, ids, text) for each row of ``tokens`` (doc_id, ids); control ids have no text, null ids give the empty text."""
    prepare(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(_decode(tokens.sparkSession.sparkContext.broadcast(pieces)), f"doc_id {kind}, ids array<int>, text string")
