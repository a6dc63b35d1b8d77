"""Benchmark decontamination by size-partitioned MinHash containment search.

The indexed sets are the distinct ``shingle``-word runs of documents; the queries
are those of benchmark items.  A short item inside a long document has a tiny
Jaccard similarity, so a signature of fixed length would miss it.  Documents are
therefore partitioned by their number of shingles into classes of powers of two,
and a document of class c is sketched by one-permutation MinHash with
``BINS_PER_SHINGLE * 2**c`` bins: the least hash in each bin.  An item is
sketched once for each class, with that class's bins.  Item and document are
candidates if a bin has the same minimum.  A shingle of the item that the
document has is missed only if another of the document's shingles falls into the
same bin below it, with probability under 1 / (2 * BINS_PER_SHINGLE) (3 % with
16 bins); an item is missed if that happens to all it shares, so with 15 common
shingles with probability 1e-23.  Items of fewer than ``TINY`` shingles are too
small for a sketch, and each of their shingles is looked up.

Only what is in both sketches is looked up: a document meets the table of its class,
which has the items' minima for that class's bins and is made when a task first
meets a document of that class.  The candidates that this gives are verified in
the same task, where the document's shingles are at hand: containment is the exact
share of the item's distinct shingles in the document.

An item of some words, but fewer than ``shingle``, is one run of its own length; a
document holds it if the run stands in it anywhere, whole words only.  As one or
two common words stand in many clean documents, ``least_words`` says how short an
item may be: 1 in the report (``contaminated_pairs``), ``shingle`` where documents are
dropped for it (``drop_contaminated``).

Items are taken in blocks of at most ``block_items`` rows and ``block_bytes``
bytes of text, each broadcast by itself; a benchmark of any size is that many
passes over the documents.  Nothing is shuffled but what is found.

Words are runs of letters and digits (ASCII case folded, other ASCII a separator,
other characters part of a word).  Edge cases: null or empty texts and those
without words match nothing; a document of fewer than ``shingle`` words can hold
short items only.  Repeated items and documents each give their own row.  Null ids
are kept.  A containment that ties with the threshold counts.  Very long documents are searched
whole.  Without documents or items there are no pairs.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .session import prepare

BINS_PER_SHINGLE = 16
TINY = 8
BLOCK_ITEMS, BLOCK_BYTES = 100_000, 16 << 20
SCHEMA = "doc_id long, item_id long, n_shingles int, n_found int, containment double"


def size_class(n: np.ndarray) -> np.ndarray:
    """ceil(log2 n), so that class c holds sets of at most 2**c shingles."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _bins(value: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bin of each hash in its class: the top bits, one bin for each 1 / (BINS_PER_SHINGLE * 2**c)."""
    bits = classes + (BINS_PER_SHINGLE.bit_length() - 1)
    return (value >> (64 - bits).astype(tx.U64)).astype(np.int64)


def minima(row: np.ndarray, value: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mask of the least hash in each bin; values come sorted by row and value."""
    cell = _bins(value, classes)
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    return first


class ItemIndex:
    """Shingles of a block of items, their sketches by class, and runs of short items by length."""

    def __init__(self, ids: list, texts: list, shingle: int, least_words: int):
        rows, values, first = [], [], 0
        short: dict[int, tuple[list, list]] = {}
        for part, piece in tx.slices(pa.record_batch({"text": pa.array(texts, pa.string())})):
            words = tx.Words(piece, tx.FOLDED)
            at, value = words.grams(shingle)
            row, value, _ = tx.distinct_in_row(words.row[at], value)
            rows.append(row + first)
            values.append(value)
            for n in range(max(1, least_words), shingle):
                at, value = words.grams(n)
                own = words.count[words.row[at]] == n
                if own.any():
                    runs = short.setdefault(n, ([], []))
                    runs[0].extend((words.row[at[own]] + first).tolist())
                    runs[1].extend(value[own].tolist())
            first += len(part)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0, tx.U64)
        self.ids, self.shingle = ids, shingle
        self.start = np.searchsorted(self.row, np.arange(len(ids) + 1))
        self.sizes = np.diff(self.start)
        self.short = {n: self._postings(np.array(r, np.int64), np.array(v, tx.U64)) for n, (r, v) in short.items()}
        self.classes: dict[int, tuple] = {}

    @staticmethod
    def _postings(row: np.ndarray, value: np.ndarray) -> tuple:
        """(items by hash, distinct hashes, where each begins, how many it has)."""
        order = np.argsort(value, kind="stable")
        return row[order], *np.unique(value[order], return_index=True, return_counts=True)

    def sketched(self, c: int) -> tuple:
        """Postings of the items' minima in the bins of class ``c``."""
        if c not in self.classes:
            held = minima(self.row, self.value, np.full(len(self.row), c)) | (self.sizes[self.row] < TINY)
            self.classes[c] = self._postings(self.row[held], self.value[held])
        return self.classes[c]

    @staticmethod
    def _look_up(postings: tuple, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document row, item) for every posting of the given hashes."""
        items, values, start, count = postings
        none = np.zeros(0, np.int64)
        if not len(values) or not len(value):
            return none, none
        at = np.minimum(np.searchsorted(values, value), len(values) - 1)
        hit = values[at] == value
        row, at = row[hit], at[hit]
        times = count[at]
        place = np.repeat(start[at] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        return np.repeat(row, times), items[place]

    def candidates(self, row: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Distinct (document row, item), as one number, of which a bin has the same minimum."""
        classes = size_class(size)[row]
        # A document's minima; of items too small for a sketch every shingle is looked up.
        low = minima(row, value, classes)
        out = []
        for c in np.unique(classes):
            mine = classes == c
            doc, item = self._look_up(self.sketched(int(c)), row[mine & low], value[mine & low])
            out.append(doc * len(self.ids) + item)
            rest = mine & ~low
            if rest.any():
                doc, item = self._look_up(self.sketched(int(c)), row[rest], value[rest])
                tiny = self.sizes[item] < TINY
                out.append(doc[tiny] * len(self.ids) + item[tiny])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def search(self, words: tx.Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document row, item, shingles of the item, shingles found) of verified pairs."""
        at, value = words.grams(self.shingle)
        row, value, _ = tx.distinct_in_row(words.row[at], value)
        first = np.searchsorted(row, np.arange(words.rows + 1))
        found = []
        for pair in self.candidates(row, value, np.diff(first)).tolist():
            doc, item = divmod(pair, len(self.ids))
            own, have = self.value[self.start[item] : self.start[item + 1]], value[first[doc] : first[doc + 1]]
            n = int(np.count_nonzero(have[np.minimum(np.searchsorted(have, own), len(have) - 1)] == own))
            if n >= threshold * len(own):
                found.append((doc, item, len(own), n))
        for n, postings in self.short.items():
            at, value = words.grams(n)
            doc, item = self._look_up(postings, words.row[at], value)
            found += [(*divmod(pair, len(self.ids)), 1, 1) for pair in np.unique(doc * len(self.ids) + item).tolist()]
        return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _scan(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                doc, item, n, found = index.search(tx.Words(piece, tx.FOLDED), threshold)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(doc)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(n, pa.int32()), pa.array(found, pa.int32()), pa.array(found / n)],
                        names=["doc_id", "item_id", "n_shingles", "n_found", "containment"],
                    )

    return rows


def item_blocks(items: DataFrame, block_items: int, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items in blocks that fit a broadcast; only one block is held at a time."""
    ids, texts, size = [], [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text or "")
        if len(ids) >= block_items or size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated_pairs(
    docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, least_words: int = 1, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of items that documents hold to ``threshold``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out: DataFrame | None = None
    for ids, texts in item_blocks(items, block_items, block_bytes):
        shared = spark.sparkContext.broadcast(ItemIndex(ids, texts, shingle, least_words))
        found = docs.mapInArrow(_scan(shared, threshold), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _clean(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                keep = np.ones(len(piece), bool)
                keep[index.search(tx.Words(piece, tx.FOLDED), threshold)[0]] = False
                yield part.filter(pa.array(keep))

    return rows


def drop_contaminated(
    docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: float = 0.8, least_words: int | None = None, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` without those that hold an item of ``least_words`` (default: ``shingle``) or more, with all columns; nothing is shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    for ids, texts in item_blocks(items, block_items, block_bytes):
        shared = spark.sparkContext.broadcast(ItemIndex(ids, texts, shingle, least_words or shingle))
        docs = docs.mapInArrow(_clean(shared, threshold), docs.schema)
    return docs
