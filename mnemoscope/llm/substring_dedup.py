"""Exact removal of long repeated passages, behind a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if some
window that covers it has the same words as a window that starts anywhere else.

1. Each window is counted under its *minimiser*, the smallest hash among its
   ``width - gram + 1`` runs of ``gram`` words.  Equal windows have the same
   minimiser at different places, so the number of places of a minimiser is never
   less than the number of equal windows, while there are some fourteen times
   fewer such places than windows.  Every partition makes a count-min sketch of its
   places: ``ROWS`` rows of cells, of which only those with a count are kept, by
   blocks of cells.  Partition sketches merge by adding the counts of a cell, each
   block in a task of its own.
2. Windows whose minimiser is estimated at two places or more are grouped by
   their 128-bit hash and counted exactly.  Overestimates only add rows here,
   and no repeated window is lost.  The groups are combined on the map side, so
   a passage in a third of all documents is one row per task.  A group of one
   yields its place: a window that was suspected but is unique.
3. Each document recomputes its suspected windows, leaves out the unique ones
   and drops the words that the others cover.

A row of the sketch has eight cells for each expected minimiser, at any size of the
input.  What a document asks of the merged sketch is whether cells hold two or more,
a bit a cell.  Up to ``BROADCAST_BYTES`` these bits are broadcast.  A larger sketch
stays distributed by blocks: documents send the hashes of their minimisers, each
once, to the blocks of the first row, those that pass to the blocks of the next,
and get back what passed both.  These joins have narrow rows and no key but the block, of
which a hot one can be split, since a block's bits are one row.

Edge cases: a null or empty text has no words (n_words 0, the hash of "").
Documents shorter than a window lose nothing.  Repeated rows and ties count like
any other place.  Rows are told apart by a 128-bit hash of id and text; a null id
is allowed.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .session import prepare

MIN_BITS = 20
CELLS_PER_PLACE = 8
BLOCK_BITS = 20
BROADCAST_BYTES = 64 << 20
#: Places that a task holds before their counts are added up and sent on.
HELD = 1 << 21
ROWS = 2
_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _cells(value: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tx.mix(value ^ tx.U64(_SEEDS[row])) >> tx.U64(64 - bits)).astype(np.int64)


class _Windows:
    """Windows of a slice, with their minimisers and the minimisers' places."""

    def __init__(self, words: tx.Words, width: int, gram: int):
        span = width - gram + 1
        row = words.row
        n = max(0, len(row) - width + 1)
        self.at = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
        if not len(self.at):
            self.minimiser = self.places = np.zeros(0, tx.U64)
            return
        value = tx.span_hash(running := tx.running(words.hash), g := np.arange(len(row) - gram + 1), g + gram)
        low = tx.sliding(np.minimum, value, span)
        self.minimiser, self.running = low[self.at], running
        # A gram is a minimiser's place if it is the least of some window that holds it, ties included.
        lowest = np.zeros(len(value) + span - 1, tx.U64)
        lowest[span - 1 + self.at] = self.minimiser
        self.places = value[tx.sliding(np.maximum, lowest, span)[: len(value)] == value]


def _sketch_parts(width: int, gram: int, bits: int):
    """The partition's count-min sketch: for each block the cells with a count, and the counts."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            blocks, cells, counts = [], [], []
            value = np.concatenate(held)
            for row in range(ROWS):
                cell, times = np.unique(_cells(value, row, bits), return_counts=True)
                block = cell >> BLOCK_BITS
                cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(cell))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    blocks.append((row << 48) | int(block[a]))
                    cells.append((cell[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes())
                    counts.append(np.minimum(times[a:b], 255).astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["block", "cells", "counts"])

        for batch in batches:
            for _, piece in tx.slices(batch):
                places = _Windows(tx.Words(piece), width, gram).places
                held.append(places)
                size += len(places)
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return parts


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: counts of each cell are added, and bits of the cells with two or more are sent on, 64 to a number."""
    held, total = None, np.zeros(0, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([np.packbits(total > 1, bitorder="little").view(np.int64)], pa.list_(pa.int64()))], names=["block", "bits"])

    for batch in batches:
        for block, cells, counts in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
            if block != held:
                if held is not None:
                    yield out()
                held, total = block, np.zeros(1 << BLOCK_BITS, np.uint8)
            cell, more = np.frombuffer(cells.as_buffer(), np.uint32), np.frombuffer(counts.as_buffer(), np.uint8)
            # A count stays at 255 once it is there; only two or more is asked for.
            total[cell] = np.minimum(total[cell].astype(np.uint16) + more, 255)
    if held is not None:
        yield out()


class _Broadcast:
    """The whole sketch, one bit a cell."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def repeated(self, part: pa.RecordBatch, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        keep = np.ones(len(value), bool)
        for r in range(ROWS):
            cell = _cells(value, r, self.bits)
            keep &= (self.words[r, cell >> 6] >> (cell & 63) & 1).astype(bool)
        return keep


class _Answered:
    """Each document brings the minimisers that passed, in its column ``passed``."""

    def repeated(self, part: pa.RecordBatch, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        passed = part.column("passed")
        own = np.repeat(np.arange(len(passed)), pc.fill_null(pc.list_value_length(passed), 0).to_numpy(zero_copy_only=False))
        values = passed.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(tx.U64)
        salt = lambda v, r: tx.mix(v ^ (r.astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15)))
        return np.isin(salt(value, row), salt(values, own))


def _suspects(part: pa.RecordBatch, words: tx.Words, width: int, gram: int, sketch) -> tuple[_Windows, np.ndarray]:
    """Windows of the slice and the first words of those estimated repeated."""
    windows = _Windows(words, width, gram)
    return windows, windows.at[sketch.repeated(part, words.row[windows.at], windows.minimiser)] if len(windows.at) else windows.at


def _emit(width: int, gram: int, shared) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                words = tx.Words(piece)
                windows, at = _suspects(part, words, width, gram, sketch)
                if not len(at):
                    continue
                h1 = tx.span_hash(windows.running, at, at + width)
                # A second hash, of other hashes of the words.
                other = tx.running(words.stretches(words.start, words.end, 1))
                h2 = tx.span_hash(other, at, at + width)
                u1, u2 = (part.column(u).to_numpy(zero_copy_only=False)[words.row[at]] for u in ("u1", "u2"))
                pos = (at - words.first[words.row[at]]).astype(np.int32)
                for i in range(0, len(at), 100_000):
                    s = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(tx.signed(h1[s])), pa.array(tx.signed(h2[s])), pa.array(u1[s], pa.int64()), pa.array(u2[s], pa.int64()), pa.array(pos[s])], names=["h1", "h2", "u1", "u2", "pos"])

    return rows


def _apply(width: int, gram: int, shared) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                words = tx.Words(piece)
                _, at = _suspects(part, words, width, gram, sketch)
                unique = part.column("unique_at")
                lengths = np.diff(unique.offsets.to_numpy())
                alone = unique.flatten().to_numpy(zero_copy_only=False) if len(unique) else np.zeros(0, np.int32)
                rows_of = np.repeat(np.arange(len(unique)), np.where(unique.is_valid().to_numpy(zero_copy_only=False), lengths, 0))
                at = np.setdiff1d(at, words.first[rows_of] + alone, assume_unique=True)
                n = len(words.row) + 1
                gone = np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + width, minlength=n))[:-1] > 0
                removed = np.bincount(words.row[gone], minlength=len(piece))
                digests = []
                for i in range(len(piece)):
                    own = piece.text(i).split()
                    if removed[i]:
                        own = list(compress(own, ~gone[words.first[i] : words.first[i + 1]]))
                    digests.append((b" ".join(own)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return rows


def sketch_bits(text_bytes: int, width: int, gram: int) -> int:
    """log2 of the cells in a row of the sketch; six bytes to a word, 2 / (span + 1) places to a word."""
    places = text_bytes / 6 * 2 / (width - gram + 2)
    return max(MIN_BITS, math.ceil(math.log2(max(1.0, places * CELLS_PER_PLACE))))


def _minimisers(width: int, gram: int, bits: int):
    """The distinct minimisers of each document, with the block and the place in it of their cell in each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece in tx.slices(batch):
                words = tx.Words(piece)
                windows = _Windows(words, width, gram)
                row, value, _ = tx.distinct_in_row(words.row[windows.at], windows.minimiser)
                take, columns = pa.array(row), {"value": pa.array(tx.signed(value))}
                for r in range(ROWS):
                    cell = _cells(value, r, bits)
                    columns |= {f"block{r}": pa.array((cell >> BLOCK_BITS) + (r << 48)), f"cell{r}": pa.array((cell & ((1 << BLOCK_BITS) - 1)).astype(np.int32))}
                yield pa.RecordBatch.from_pydict({"u1": part.column("u1").take(take), "u2": part.column("u2").take(take)} | columns)

    return rows


def _answers(docs: DataFrame, merged: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """(u1, u2, passed) of the documents (u1, u2, text) of which minimisers pass all rows of the sketch; repeated rows ask and are answered once."""
    places = ", ".join(f"block{r} long, cell{r} int" for r in range(ROWS))
    asked = docs.mapInArrow(_minimisers(width, gram, bits), f"u1 long, u2 long, value long, {places}")
    for r in range(ROWS):
        # The block's bits are tested where they are joined and never copied to a row.
        held = merged.select(F.col("block").alias("b"), "bits").hint("merge")
        two = F.getbit(F.get("bits", F.shiftright(F.col(f"cell{r}"), 6)), F.col(f"cell{r}").bitwiseAND(F.lit(63))) == 1
        asked = asked.join(held, (F.col(f"block{r}") == F.col("b")) & two).select(*asked.columns)
        if r == 0:
            asked = asked.distinct()
    return asked.groupBy("u1", "u2").agg(F.collect_list("value").alias("passed"))


def remove_repeated(docs: DataFrame, *, width: int = 35, gram: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs`` (doc_id, text)."""
    if not 0 < gram <= width:
        raise ValueError("gram must be between 1 and width")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("u2"))
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = sketch_bits(text_bytes, width, gram)
    merged = (
        docs.select("text").mapInArrow(_sketch_parts(width, gram, bits), "block long, cells binary, counts binary")
        .repartition("block").sortWithinPartitions("block")
        .mapInArrow(_merge_parts, "block long, bits array<long>")
    )
    if ROWS * (1 << bits) // 8 <= BROADCAST_BYTES:
        words = np.zeros((ROWS, max(1, (1 << bits) // 64)), np.int64)
        for block, part in merged.toLocalIterator():
            start = (block & ((1 << 48) - 1)) << (BLOCK_BITS - 6)
            own = words[block >> 48, start : start + len(part)]  # shorter than a block if the sketch is
            own[:] = part[: len(own)]
        sketch = _Broadcast(bits, words)
    else:
        docs = docs.join(_answers(docs.select("u1", "u2", "text"), merged.checkpoint(), width, gram, bits), ["u1", "u2"], "left").checkpoint()
        sketch = _Answered()
    shared = spark.sparkContext.broadcast(sketch)
    asked = [c for c in docs.columns if c == "passed"]
    unique = (
        docs.select("u1", "u2", "text", *asked).mapInArrow(_emit(width, gram, shared), "h1 long, h2 long, u1 long, u2 long, pos int")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.min("pos").alias("pos"))
        .where("n = 1")  # so that all three are of one row
        .groupBy("u1", "u2").agg(F.collect_list("pos").alias("unique_at"))
    )
    return docs.join(unique, ["u1", "u2"], "left").select("doc_id", "text", "unique_at", *asked).mapInArrow(
        _apply(width, gram, shared), "doc_id long, n_words long, n_removed long, kept_text string"
    )
