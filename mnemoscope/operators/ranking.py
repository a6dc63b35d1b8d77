"""Rank fusion, quotas and budgets over ranked candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(hits: DataFrame, *, by: list[Column], groups: list[str], name: str = "rank") -> DataFrame:
    """``hits`` with a rank from 1 in each group."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*by)))


def best(hits: DataFrame, k: int, *, by: list[Column], groups: list[str]) -> DataFrame:
    """The first k of each group; Spark keeps only k per group and task before the shuffle."""
    return ranked(hits, by=by, groups=groups).where(F.col("rank") <= k)


def fuse(lanes: dict[str, DataFrame], *, groups: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lanes (groups, id, rank): rrf, and each lane's rank and share."""
    rows = reduce(DataFrame.unionByName, (df.select(*groups, "id", F.lit(lane).alias("lane"), "rank") for lane, df in lanes.items()))
    share = 1.0 / (k + F.col("rank"))
    of = lambda lane, x: F.sum(F.when(F.col("lane") == lane, x))
    return rows.groupBy(*groups, "id").agg(F.sum(share).alias("rrf"), *(of(lane, F.col("rank")).alias(f"rank_{lane}") for lane in lanes), *(F.coalesce(of(lane, share), F.lit(0.0)).alias(f"share_{lane}") for lane in lanes))


def blend(lexical: DataFrame, graph: DataFrame, *, groups: list[str]) -> DataFrame:
    """Lexical hits (groups, id, rank) score 1 / (rank + 1), graph hits (groups, id, score) their score; one order for both in each group."""
    rows = lexical.select(*groups, "id", F.lit("lexical").alias("lane"), (1.0 / (F.col("rank") + 1)).alias("hybrid_score"))
    rows = rows.unionByName(graph.select(*groups, "id", F.lit("graph").alias("lane"), F.col("score").alias("hybrid_score")))
    return ranked(rows, by=[F.desc("hybrid_score"), F.col("lane"), F.col("id")], groups=groups)


def tier_quota(hits: DataFrame, *, limit: int, must_max: int, nice_min: int, unknown_max: int, groups: list[str]) -> DataFrame:
    """Select ``limit`` of each group from tiers must, nice, unknown and ignore (columns tier, id, score, created).

    Nice hits have a minimum, must and unknown a maximum; free places go to the best of what is left.
    """
    order = [F.desc("score"), F.desc("created"), F.col("id").asc()]
    in_tier = ranked(hits, by=order, groups=[*groups, "tier"], name="tier_rank")
    size = lambda t: F.sum(F.when(F.col("tier") == t, 1).otherwise(0)).over(Window.partitionBy(*groups))
    nice = F.least(F.lit(nice_min), F.lit(limit), size("nice"))
    must = F.least(F.lit(must_max), limit - nice, size("must"))
    unknown = F.least(F.lit(unknown_max), limit - nice - must, size("unknown"))
    quota = F.when(F.col("tier") == "must", must).when(F.col("tier") == "nice", nice).when(F.col("tier") == "unknown", unknown).otherwise(0)
    marked = in_tier.withColumn("reserved", F.col("tier_rank") <= quota).withColumn("taken", must + nice + unknown)
    wild = ranked(marked, by=[F.col("reserved").asc(), *order, F.col("tier").asc()], groups=groups, name="wild_rank")
    return wild.where(F.col("reserved") | (F.col("wild_rank") <= limit - F.col("taken"))).withColumn("wildcard", ~F.col("reserved")).drop("taken", "wild_rank", "tier_rank", "reserved")


def tier_first(hits: DataFrame, *, limit: int, tiers: tuple[str, ...], groups: list[str]) -> DataFrame:
    """Fill ``limit`` places of each group tier by tier; an id counts in its first tier."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    order = [F.col("tier_place"), F.desc("score"), F.desc("created"), F.col("id").asc()]
    first = ranked(hits.withColumn("tier_place", place).where("tier_place > 0"), by=order, groups=[*groups, "id"], name="seen").where("seen = 1").drop("seen")
    return best(first, limit, by=order, groups=groups).drop("tier_place")


def soft_quota(candidates: DataFrame, *, limit: int, preference_min: int = 1, decision_min: int = 1, event_max_ratio: float = 0.4, groups: list[str]) -> DataFrame:
    """Reserve first places for preferences and decisions, mark events above their share.

    ``candidates`` has place (from 1), kind and eligible; out come new_place and capped.
    """
    eligible = F.col("eligible")
    in_kind = F.row_number().over(Window.partitionBy(*groups, "kind", "eligible").orderBy("place"))
    count = lambda k: F.sum(F.when(eligible & (F.col("kind") == k), 1).otherwise(0)).over(Window.partitionBy(*groups))
    preferences = F.least(F.lit(min(preference_min, limit)), count("preference"))
    decisions = F.least(F.lit(decision_min), limit - preferences, count("decision"))
    reserve = F.when(eligible & (F.col("kind") == "preference") & (in_kind <= preferences), 1).when(eligible & (F.col("kind") == "decision") & (in_kind <= decisions), 2).otherwise(3)
    placed = candidates.withColumn("_reserve", reserve)
    placed = placed.withColumn("new_place", F.row_number().over(Window.partitionBy(*groups).orderBy("_reserve", "place")))
    events = F.row_number().over(Window.partitionBy(*groups, "kind", "eligible").orderBy("new_place"))
    return placed.withColumn("capped", eligible & (F.col("kind") == "event") & (events > int(limit * min(1.0, max(0.0, event_max_ratio))))).withColumn("reserved", F.col("_reserve") < 3).drop("_reserve")


def pack_within_budget(candidates: DataFrame, *, budget: int, limit: int, groups: list[str], first_always: bool = False) -> DataFrame:
    """Greedy selection in order: an item that would pass the budget is skipped, a later smaller one may fit.

    ``candidates`` has place, id and tokens, already cut to a bounded number for each group, as it is
    folded as one array. Out come (groups, id, position, used).
    """
    items = F.array_sort(F.collect_list(F.struct("place", "id", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:bigint,position:int,used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= budget) | (F.lit(first_always) & (F.size(acc["taken"]) == 0))
        used = acc["used"] + x["tokens"]
        entry = F.struct(x["id"].cast("bigint").alias("id"), (F.size(acc["taken"]) + 1).alias("position"), used.alias("used"))
        return F.when((F.size(acc["taken"]) < limit) & fits, F.struct(used.alias("used"), F.concat(acc["taken"], F.array(entry)).alias("taken"))).otherwise(acc)

    packed = candidates.groupBy(*groups).agg(F.aggregate(items, start, step)["taken"].alias("taken"))
    return packed.select(*groups, F.inline("taken"))
