"""Document quality from the text and from the site: hierarchical empirical Bayes.

A logistic model on layout features gives each document a probability of being
good.  Sites are judged by grouped sums of these probabilities: the prior of a
host is shrunk towards the mean of all documents, that of a path towards its
host, each with a strength (a number of pseudo-documents) estimated by moments
from the spread between hosts, and between the paths of hosts.  A host or path
with few documents stays near what lies above it.  A document's own evidence is
left out of its site's prior, then both are combined: the document's odds, with
the rate the model was trained at replaced by the rate of the path.

Probabilities are summed in whole millionths, so results don't depend on the
order of summing.  A host with a third of all documents is one row after map-side
aggregation; adaptive execution broadcasts the tables of hosts and paths only if
they are small, and splits their skewed joins otherwise.

The model is fitted on at most ``MAX_LABELLED`` labelled documents (least hash of the id).

Edge cases: null or empty texts have all features 0.  Null hosts and paths are
groups of their own.  Without labels, or with one class only, the smoothed rate
stands in for the model.  Repeated ids in labels count once (the largest label);
of the texts of a
repeated document one is used in training; each is judged.
Ties get the same score.  Very long texts are read whole.  An empty table gives an empty table.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .session import prepare
from .linear import Logistic, fit
from .quality_rules import counts_of

MAX_LABELLED = 4000
THRESHOLD = 0.5
MILLION = 1_000_000
FEATURES = ("log_words", "symbols", "upper", "exclaims", "digits", "word_length", "dup_lines", "repeats", "same_as_before")


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a page's address: the host in small letters, and with it the path's first part.

    An address that is null or has no host gives nulls.
    """
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return host, F.concat(host, F.lit("/"), F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/*([^/]*)", 1))


def features(piece: tx.Slice) -> np.ndarray:
    """One row of FEATURES for each text."""
    data = piece.data
    got = counts_of(piece)
    words = tx.Words(piece, tx.FOLDED)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[piece.bounds])
    n, chars = np.maximum(got["n_words"], 1), np.maximum(got["word_chars"], 1)
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])) if len(words.row) > 1 else np.zeros(0, np.int64)
    return np.column_stack([
        np.log1p(got["n_words"]), got["n_symbols"] / chars, total((data >= 0x41) & (data <= 0x5A)) / chars, total(data == 0x21) / n, total((data >= 0x30) & (data <= 0x39)) / chars,
        np.minimum(got["word_chars"] / n, 20), got["n_dup_lines"] / n, got["n_repeat_words"] / n, np.bincount(words.row[same], minlength=len(piece)) / n,
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    logistic: Logistic
    rate: float  # of good documents in the training sample

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.logistic((x - self.mean) / self.scale)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, piece in tx.slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array(list(features(piece)), pa.list_(pa.float64()))], names=["doc_id", "good", "x"])


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Model:
    """``labels`` has (doc_id, quality), 1 for good."""
    prepare(docs.sparkSession)
    each = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("good"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most ``max_labelled`` rows of two numbers are broadcast, and as many rows of features collected.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # A repeated id gives one row, its least features, found on the map side.
    rows = sample.mapInArrow(_feature_rows, "doc_id long, good int, x array<double>").groupBy("doc_id").agg(F.min("good").alias("good"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    y = np.array([r.good for r in rows], np.float64)
    if not len(rows):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), Logistic(np.zeros(len(FEATURES)), 0.0), 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return Model(mean, scale, fit((x - mean) / scale, y, rounds=500), float((y.sum() + 0.5) / (len(y) + 1)))


def _score(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, piece in tx.slices(batch):
                p = np.clip(np.rint(model(features(piece)) * MILLION), 1, MILLION - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), part.column("path"), pa.array(p)], names=["doc_id", "host", "path", "p"])

    return rows


def _strength(groups: DataFrame, prior: Column) -> float:
    """Pseudo-documents by moments: the spread of group means about ``prior``, beyond what sampling gives.

    ``groups`` has (n, s); with no spread left over, groups say nothing and the strength is large.
    """
    mean = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * (mean - prior) ** 2).alias("between"), F.sum(prior * (1 - prior)).alias("sampling"), F.sum(F.col("n") * prior * (1 - prior)).alias("total")
    ).first()
    if not row["n"]:
        return 1.0
    spread = (row["between"] - row["sampling"]) / row["n"]
    typical = row["total"] / row["n"]
    return float(round(min(1e6, max(1.0, typical / spread - 1)), 3)) if spread > 1e-9 else 1e6


def judge(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, p_document, p_host, p_path, p_good, kept) for each row of ``docs`` (doc_id, text, host, path)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path")]
    scored = docs.select(*columns).mapInArrow(_score(shared), "doc_id long, host string, path string, p long").checkpoint()
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).checkpoint()
    n, total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))).first()
    mean = (total / MILLION + 0.5) / (n + 1)
    k_host = _strength(hosts.select("n", (F.col("sum") / MILLION).alias("s")), F.lit(mean))
    host_of = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("sum").alias("host_sum"))
    shrunk = lambda s, m, k, prior: (s / MILLION + k * prior) / (m + k)
    tree = paths.join(host_of, F.col("host").eqNullSafe(F.col("h"))).select(F.col("h"), F.col("path").alias("q"), "host_n", "host_sum", F.col("n").alias("path_n"), F.col("sum").alias("path_sum")).checkpoint()
    inner = shrunk(F.col("host_sum"), F.col("host_n"), k_host, F.lit(mean))
    k_path = _strength(tree.select(F.col("path_n").alias("n"), (F.col("path_sum") / MILLION).alias("s"), inner.alias("prior")), F.col("prior"))
    # The document's own evidence is taken out of both sums.
    p_host = shrunk(F.col("host_sum") - F.col("p"), F.col("host_n") - 1, k_host, F.lit(mean))
    p_path = shrunk(F.col("path_sum") - F.col("p"), F.col("path_n") - 1, k_path, F.col("p_host"))
    odds = lambda x: F.log(x / (1 - x))
    joined = scored.join(tree, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    base = float(np.log(model.rate / (1 - model.rate)))
    return (
        joined.withColumn("p_host", p_host).withColumn("p_path", p_path)
        .withColumn("p_document", F.col("p") / MILLION)
        .withColumn("p_good", F.round(1 / (1 + F.exp(-(odds(F.col("p_document")) - base + odds(F.col("p_path"))))), 9))
        .select("doc_id", "host", "path", "p_document", F.round("p_host", 9).alias("p_host"), F.round("p_path", 9).alias("p_path"), "p_good", (F.col("p_good") >= threshold).alias("kept"))
    )
