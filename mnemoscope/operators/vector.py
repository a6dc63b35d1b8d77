"""Exact cosine search of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors held by each task at once.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; the columns hold equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(ids: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) [query, k] of the best of a slice, by score and then the lesser id; only the k are sorted."""
    by_id = np.argsort(ids, kind="stable")
    ids, cosine = ids[by_id], cosine[:, by_id]
    # Scores have nine decimals: as integers with the place in the order of ids behind them, no two are equal.
    key = (-np.rint(cosine * 1e9).astype(np.int64) << 12) + np.arange(len(ids))
    k = min(k, len(ids))
    best = np.argpartition(key, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(key, best, 1), axis=1), 1)
    return ids[best], np.take_along_axis(cosine, best, 1)


def _search(shared, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        norms = np.linalg.norm(asked, axis=1)
        held: tuple[np.ndarray, np.ndarray] | None = None  # (ids, scores) of the best so far, [query, k]
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column("vector"))
                size = np.linalg.norm(x, axis=1)
                cosine = asked @ x.T / np.where(size > 0, size, 1) / np.where(norms > 0, norms, 1)[:, None]
                cosine[:, size == 0] = 0
                cosine = np.round(cosine, 9)
                new = _nearest(part.column("id").to_numpy(zero_copy_only=False), cosine, k)
                if held:
                    own, cosine = np.concatenate([held[0], new[0]], 1), np.concatenate([held[1], new[1]], 1)
                    order = np.lexsort((own, -cosine))[:, :k]
                    new = np.take_along_axis(own, order, 1), np.take_along_axis(cosine, order, 1)
                held = new
        if held and len(ids):
            n = held[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(held[0].ravel()), pa.array(held[1].ravel())], names=["query_id", "id", "score"])

    return rows


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of ``vectors`` (id, vector) to each of ``queries`` (query_id, vector).

    Zero vectors score 0, ties go to the lesser id. Vectors that are null, hold a null or differ in length
    from most others neither ask nor are found. Queries are a stated set, taken in blocks;
    each task hands on k rows for each query.
    """
    from .ranking import best

    spark, out, block = vectors.sparkSession, None, []
    width = vectors.agg(F.mode(F.size("vector"))).first()[0] or 0
    whole = (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull())
    vectors = vectors.where(whole)

    def ask(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
        return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_search(shared, k), "query_id long, id long, score double")

    for row in queries.select(F.col("query_id").cast("long"), "vector").where(whole).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            out, block = (ask(block) if out is None else out.union(ask(block))), []
    if block or out is None:
        last = ask(block) if block else spark.createDataFrame([], "query_id long, id long, score double")
        out = last if out is None else out.union(last)
    return best(out, k, by=[F.desc("score"), F.col("id")], groups=["query_id"])
