"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the
document's features and the probabilities of the categories before it.  While
training these are out of fold, so later models learn from predictions as
they will be, not from fitted ones.  The last category is the label ``toxic``.

The label table has that one column.  The earlier categories are kinds of toxic
documents, found in the labelled sample itself: ``KINDS`` clusters of the toxic
ones by their features (spherical k-means, begun at the documents farthest apart).
No word is given by hand.

Features: presence of words and of word beginnings (four and five bytes), ASCII
case folded.  The ``FEATURES`` of them with the largest chi-square against the
label are chosen.  The model is fitted on at most ``MAX_LABELLED`` labelled documents,
those with the least hash of their id; this bound is a parameter.  Every
document is scored, whole, by the same task that reads it; nothing is shuffled.

Edge cases: null or empty texts have no features and get the model's base rate.
A label table that is empty or has one class gives that rate to every document.
Labels of a repeated id count as one, the largest, and so do its texts, the least; null labels and ids are left
out of training.  Repeated documents and ties are scored alike.  Extra columns
are not read by ``score`` and pass through ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .linear import Logistic, apply_chain, chain, folds
from .session import prepare

MAX_LABELLED = 4000
FEATURES = 512
FOLDS = 5
THRESHOLD = 0.5
MIN_DOCS = 3
PENALTY = 0.1
KINDS, KIND_ROUNDS = 2, 20
_BEGINNINGS = (4, 5)
_KIND = tx.mix(np.arange(1, 8, dtype=tx.U64) * tx.U64(0xD1342543DE82EF95))


def tokens(piece: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct word and word beginning of each text."""
    words = tx.Words(piece, tx.FOLDED)
    rows, values = [words.row], [words.hash]
    for n in _BEGINNINGS:
        long = words.end - words.start > n
        rows.append(words.row[long])
        values.append(tx.span_hash(words.prefix, words.start[long], words.start[long] + n) ^ _KIND[n])
    row, value, _ = tx.distinct_in_row(np.concatenate(rows), np.concatenate(values))
    return row, value


def kinds(x: np.ndarray, k: int = KINDS) -> np.ndarray:
    """The cluster of each row, by the cosine of presence vectors; deterministic, whatever the order of equal rows."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if not len(u):
        return np.zeros(0, np.int64)
    centre = u.mean(axis=0)
    centres = [u[np.argmin(u @ centre)]]
    while len(centres) < k:
        centres.append(u[np.argmin(np.max(u @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(KIND_ROUNDS):
        own = np.argmax(u @ centres.T, axis=1)
        sums = np.array([u[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return np.argmax(u @ centres.T, axis=1)


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    features: np.ndarray  # sorted hashes
    models: list[Logistic]

    def matrix(self, piece: tx.Slice) -> np.ndarray:
        """Presence of each feature."""
        n = len(self.features)
        x = np.zeros((len(piece), n), np.float32)
        row, value = tokens(piece)
        if n:
            at = np.minimum(np.searchsorted(self.features, value), len(self.features) - 1)
            hit = self.features[at] == value
            x[row[hit], at[hit]] = 1
        return x

    def scores(self, piece: tx.Slice) -> np.ndarray:
        return apply_chain(self.models, self.matrix(piece))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, piece in tx.slices(batch):
            row, value = tokens(piece)
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(value)), part.column("toxic").take(pa.array(row))], names=["token", "toxic"])


def _feature_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece in tx.slices(batch):
                bits = pa.array(np.packbits(model.matrix(piece) > 0, axis=1).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), bits], names=["doc_id", "toxic", "bits"])

    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labelled documents, those with the least hash of their id."""
    each = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` rows of two numbers are broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, n_features: int = FEATURES) -> Model:
    prepare(docs.sparkSession)
    names = (*(f"kind_{c + 1}" for c in range(KINDS)), "toxic")
    sample = labelled_sample(docs, labels, max_labelled).checkpoint()
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = sample.select("text", "toxic").mapInArrow(_token_rows, "token long, toxic int").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    # Chi-square of presence against the label, from the four cells.
    a, b = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    cells = float(n) * (a * (n - pos - b) - b * (pos - a)) ** 2
    chi2 = cells / (F.col("n") * (n - F.col("n")) * F.lit(float(max(1, pos * (n - pos)))))
    best = counts.where((F.col("n") >= MIN_DOCS) & (F.col("n") < n)).orderBy(chi2.desc(), "token").limit(n_features).select("token").collect() if 0 < pos < n else []
    features = np.sort(np.array([r[0] for r in best], np.int64).view(tx.U64))
    rows = sample.mapInArrow(_feature_rows(Model(names, features, [])), "doc_id long, toxic int, bits array<int>").orderBy("doc_id").collect()
    width = len(features)
    y = np.array([r.toxic for r in rows], np.float64)
    x = np.unpackbits(np.array([r.bits for r in rows], np.uint8).reshape(len(rows), -1), axis=1)[:, :width].astype(np.float32) if rows else np.zeros((0, width), np.float32)
    kind = np.full(len(y), -1)
    kind[y > 0] = kinds(x[y > 0])
    targets = np.column_stack([*(kind == c for c in range(KINDS)), y]).astype(np.float64)
    fold = folds(np.array([r.doc_id for r in rows], np.int64), FOLDS)
    return Model(names, features, chain(x, targets, fold, FOLDS, penalty=PENALTY))


def _score(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                p = model.scores(piece)
                toxic = p[:, -1] >= threshold
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.round(p[:, c], 6)) for c in range(p.shape[1])), pa.array(toxic), pa.array(~toxic)], names=["doc_id", *(f"p_{x}" for x in model.names), "toxic", "kept"])

    return rows


def _keep(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                yield part.filter(pa.array(model.scores(piece)[:, -1] < threshold))

    return rows


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_ of each category, toxic, kept) for each row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"p_{x} double" for x in model.names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, threshold), f"doc_id long, {columns}, toxic boolean, kept boolean")


def reject(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the toxic ones, in one pass and with all columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
