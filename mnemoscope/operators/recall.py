"""Recall over several lanes, with the reason for the lanes that were used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical, ranking, vector

MODES = ("auto", "lexical", "vector", "hybrid")


def recall(docs: DataFrame, asked: DataFrame, *, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, mode: str = "auto", k: int = 10) -> DataFrame:
    """(query_id, id, score, rank, lanes, mode, reason): the k best of ``docs`` (id, text) for each of ``asked`` (query_id, text).

    ``auto`` takes both lanes if there are vectors (id, vector) and question vectors
    (query_id, vector), else words alone; a mode whose vectors are missing falls back to words and says so.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    ready = vectors is not None and asked_vectors is not None
    chosen = ("hybrid" if ready else "lexical") if mode == "auto" else mode if ready or mode == "lexical" else "lexical"
    reason = "requested" if chosen == mode else "vectors_available" if chosen == "hybrid" else "no_vectors"
    lanes: dict[str, DataFrame] = {}
    if chosen in ("lexical", "hybrid"):
        lanes["lexical"] = ranking.best(lexical.bm25(docs, asked).drop("n_terms"), 2 * k, by=[F.desc("score"), F.col("id")], groups=["query_id"])
    if chosen in ("vector", "hybrid"):
        lanes["vector"] = vector.cosine_top_k(vectors, asked_vectors, k)
    if len(lanes) == 1:
        (name, hits), = lanes.items()
        out = hits.where(F.col("rank") <= k).select("query_id", "id", "score", "rank", F.lit(name).alias("lanes"))
    else:
        fused = ranking.best(ranking.fuse(lanes, groups=["query_id"]), k, by=[F.desc("rrf"), F.col("id")], groups=["query_id"])
        used = F.concat_ws("+", *(F.when(F.col(f"rank_{n}").isNotNull(), n) for n in lanes))
        out = fused.select("query_id", "id", F.col("rrf").alias("score"), "rank", used.alias("lanes"))
    return out.select("*", F.lit(chosen).alias("mode"), F.lit(reason).alias("reason"))
