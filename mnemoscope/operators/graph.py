"""Graph traversal and comparison as joins over edge tables (src, dst, type, provenance)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# A key with more than this part of all rows is hot; there can't be more hot keys than this.
HOT_KEYS = 1000
# Links that one task contracts at once: 4 MB.
TASK_LINKS = 1 << 18


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set a folder only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def lineage(edges: DataFrame, starts: DataFrame, *, depth: int, direction: str = "downstream") -> DataFrame:
    """Edges met from ``starts`` (start, node_id), each at the least depth; breadth first, one join for each step."""
    if not 1 <= depth <= 8:
        raise ValueError("depth is 1 to 8")
    near, far = ("src", "dst") if direction == "downstream" else ("dst", "src")
    keys = ["start", "src", "dst", "type", "provenance"]
    ensure_checkpoint_dir(edges.sparkSession)
    frontier = starts.select("start", "node_id").distinct()
    seen, found = frontier, None
    for level in range(1, depth + 1):
        step = edges.join(frontier, edges[near] == frontier["node_id"]).select("start", "src", "dst", "type", "provenance", F.lit(level).alias("depth"))
        found = step if found is None else found.unionByName(step)
        if level < depth:
            # Written, so that a level is computed once and an executor's loss costs one level.
            frontier = step.select("start", F.col(far).alias("node_id")).distinct().join(seen, ["start", "node_id"], "left_anti").checkpoint()
            if frontier.isEmpty():
                break
            seen = seen.union(frontier)
    return found.groupBy(*keys).agg(F.min("depth").alias("depth"))


def neighbourhood(edges: DataFrame, starts: DataFrame, *, depth: int) -> DataFrame:
    """(start, node_id, distance) of nodes within ``depth`` undirected steps of ``starts`` (start, node_id)."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    reached = starts.select("start", "node_id", F.lit(0).alias("distance"))
    frontier = reached
    for level in range(1, depth + 1):
        step = frontier.join(both, frontier["node_id"] == both["src"]).select("start", F.col("dst").alias("node_id")).distinct()
        frontier = step.join(reached, ["start", "node_id"], "left_anti").withColumn("distance", F.lit(level))
        reached = reached.unionByName(frontier)
    return reached


def nearest_edges(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """The first k edges (start, src, dst, type, provenance, depth, rank) within two undirected steps of each of ``starts`` (start, node_id), nearest first, then by the edge's columns.

    A start with k edges of its own needs no second step. Of any other, fewer than k edges of a neighbour lead back
    to it, so the first 2 k of a neighbour's edges hold all that can be among its k; a hub's others are met by nobody.
    """
    from .ranking import best

    ensure_checkpoint_dir(edges.sparkSession)
    keys = ["src", "dst", "type", "provenance"]
    order = [F.col(c) for c in keys]
    distinct = edges.select(keys).distinct()
    both = distinct.select(F.col("src").alias("near"), *keys).unionByName(distinct.where("not src <=> dst").select(F.col("dst").alias("near"), *keys))
    own = starts.select("start", "node_id").distinct().join(both, F.col("node_id") == F.col("near")).select("start", *keys).distinct()
    first = best(own, k, by=order, groups=["start"]).withColumn("depth", F.lit(1).cast("long")).drop("rank").checkpoint()
    full = first.groupBy(F.col("start").alias("s")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    open_ = first.join(full, F.col("start") == F.col("s"), "left_anti").drop("depth").checkpoint()
    around = open_.select("start", F.explode(F.array("src", "dst")).alias("node_id")).join(starts.select("start", "node_id"), ["start", "node_id"], "left_anti").distinct()
    asked = around.select(F.col("node_id").alias("near")).distinct()
    second = best(both.join(asked, "near", "left_semi"), 2 * k, by=order, groups=["near"]).drop("rank")
    met = around.join(second, F.col("node_id") == F.col("near")).select("start", *keys).distinct().join(open_, ["start", *keys], "left_anti")
    return best(first.unionByName(met.withColumn("depth", F.lit(2).cast("long"))), k, by=[F.col("depth"), *order], groups=["start"])


def frequent_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key): those with more than a ``1 / HOT_KEYS`` share of ``total`` rows, thus fewer than ``HOT_KEYS``."""
    return rows.groupBy(key).count().where(F.col("count") > total / HOT_KEYS).select(key).checkpoint()


def joined_by_hot_key(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (one row a key); no key's rows are dealt to one task.

    The values of the ``hot`` keys, fewer than ``HOT_KEYS``, are broadcast, so the rows that
    have these keys stay where they are; the other rows are shuffled by key.
    """
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(values, key)
    return cold.unionByName(rows.join(F.broadcast(values.join(F.broadcast(hot), key)), key))


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each is connected with) of the links a[i], b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        # The larger root of each link goes below the least that it meets; then all take their roots' roots.
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(onward := label[label], label):
            label = onward
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect what the task's links (a, b) connect; each node of them once."""
    parts = [(x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
    if parts:
        nodes, label = least_connected(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "label"])


def components(links: DataFrame, *, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, label): the least node that each node of ``links`` (a, b), whole numbers, is connected with.

    Links are first contracted to stars in tasks of ``task_links``.  If one task had them
    all, that is the result.  Otherwise rounds over the stars follow: every round takes the
    least label of the neighbours, then the label of that
    label; rounds are checkpointed, so an executor's loss costs one round.  A hub and
    a label that many nodes have reached already are joined as hot keys.
    """
    ensure_checkpoint_dir(links.sparkSession)
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").checkpoint()
    tasks = -(-links.count() // task_links)
    stars = links.repartition(max(tasks, 1)).mapInArrow(_contract, "node long, label long").checkpoint()
    if tasks <= 1:
        return stars
    links = stars.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = links.union(links.select("b", "a")).distinct().checkpoint()
    labels = (
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("label"))
        .checkpoint()
    )
    hubs, nodes = frequent_keys(both, "b", both.count()), labels.count()
    while True:
        heard = (
            joined_by_hot_key(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        low = (
            labels.join(heard, "node")
            .select("node", F.least("label", "heard").alias("low"), F.col("label").alias("old"))
            .checkpoint()
        )
        onward = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = (
            joined_by_hot_key(low, onward, "low", frequent_keys(low, "low", nodes))
            .select("node", F.least("low", "next").alias("label"), "old")
            .checkpoint()
        )
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def drift(nodes: DataFrame, runtime: DataFrame) -> DataFrame:
    """(node_id, status, finding) for nodes (node_id) against a runtime report (node_id, status, position).

    Of several reports on a node the last counts; findings are missing_in_runtime, runtime_only, non_ok and ok.
    """
    status = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown"))
    last = runtime.groupBy(F.col("node_id").alias("r")).agg(F.max_by(status, "position").alias("status"))
    joined = nodes.select("node_id").join(last, F.col("node_id") == F.col("r"), "full")
    finding = F.when(F.col("r").isNull(), "missing_in_runtime").when(F.col("node_id").isNull(), "runtime_only").when(F.col("status").isin("stale", "error", "missing"), "non_ok").otherwise("ok")
    return joined.select(F.coalesce("node_id", "r").alias("node_id"), "status", finding.alias("finding"))


def node_diff(seed: DataFrame, curated: DataFrame) -> DataFrame:
    """(node_id, finding) where two topologies differ: missing, stale or contract_mismatch (type or tag)."""
    s, c = seed.alias("s"), curated.alias("c")
    same = F.col("s.node_type").eqNullSafe(F.col("c.node_type")) & F.col("s.tag").eqNullSafe(F.col("c.tag"))
    finding = F.when(F.col("c.node_id").isNull(), "missing").when(F.col("s.node_id").isNull(), "stale").when(~same, "contract_mismatch")
    return s.join(c, F.col("s.node_id") == F.col("c.node_id"), "full").select(F.coalesce("s.node_id", "c.node_id").alias("node_id"), finding.alias("finding")).where("finding is not null")


def edge_diff(seed: DataFrame, curated: DataFrame) -> DataFrame:
    """(src, dst, type, finding): edges by key, their provenances compared as multisets."""
    of = lambda df, name: df.groupBy("src", "dst", "type").agg(F.array_sort(F.collect_list("provenance")).alias(name))
    joined = of(seed, "s").join(of(curated, "c"), ["src", "dst", "type"], "full")
    finding = F.when(F.col("c").isNull(), "missing").when(F.col("s").isNull(), "stale").when(F.col("s") != F.col("c"), "contract_mismatch")
    return joined.select("src", "dst", "type", finding.alias("finding")).where("finding is not null")
