"""Gates that let work go on: stages that evidence opens, and questions that may ask the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Why a stage holds. Fixed values.
NO_STATE, LOW_STREAK, FEW_RUNS, FEW_WRITES = "sunrise_state_missing", "live_green_streak_below_threshold", "lifecycle_runs_below_threshold", "writeback_eligible_ratio_below_threshold"
MUTATED, NOT_B, MISSES = "lifecycle_mutation_not_shadow", "stage_b_not_ready", "repeated_miss_pressure_high"


@dataclass(frozen=True)
class Thresholds:
    streak: int = 18
    runs_b: int = 2
    runs_c: int = 2
    eligible_ratio: float = 0.6
    miss_repeats: int = 2
    miss_groups_c: int = 1


def streaks(runs: DataFrame) -> DataFrame:
    """(subject, streak, healthy): how many runs of ``runs`` (subject, ts, id, healthy) came after the last unhealthy one, and whether the last was healthy.

    Runs go by time, then id; equal ones count each. Two aggregations and no ordered pass, so a subject may have any number of runs.
    """
    at = F.struct("ts", "id")
    ends = runs.groupBy("subject").agg(F.max(F.when(~F.col("healthy"), at)).alias("bad"), F.max(F.struct("ts", "id", ~F.col("healthy"))).alias("last"))
    # Of runs with one time and id an unhealthy one is the last.
    after = runs.join(ends.select(F.col("subject").alias("s"), "bad"), F.col("subject") == F.col("s")).where("bad is null").select("subject").unionByName(
        runs.join(ends.where("bad is not null").select(F.col("subject").alias("s"), "bad"), F.col("subject") == F.col("s")).where(at > F.col("bad")).select("subject")
    )
    counts = after.groupBy(F.col("subject").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return ends.join(counts, F.col("subject") == F.col("s"), "left").select("subject", F.coalesce("n", F.lit(0).cast("long")).alias("streak"), F.col("bad").isNull().alias("never_bad"), (F.col("bad").isNull() | (F.struct("last.ts", "last.id") > F.col("bad"))).alias("healthy"))


def policy_loop(subjects: DataFrame, runs: DataFrame, writes: DataFrame, lifecycle: DataFrame, misses: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """(subject, stage_b, reasons_b, stage_c, reasons_c, eligible_ratio, streak) for each of ``subjects`` (subject).

    ``runs`` (subject, ts, id, healthy) are live checks, of which an unhealthy one starts the streak anew; ``writes``
    (subject, eligible) are stored memories and whether they can be written back; ``lifecycle`` (subject, mutation) are shadow runs, which
    must change nothing ("none"); ``misses`` (subject, query) are recalls that found nothing. A stage is ready or holds, with every
    reason in a fixed order. A subject without writes has a ratio of 0. Nothing depends on the order of rows.
    """
    t = thresholds
    ratio = writes.groupBy("subject").agg(F.round(F.avg(F.coalesce("eligible", F.lit(False)).cast("int")), 4).alias("eligible_ratio"))
    shadow = lifecycle.groupBy("subject").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.coalesce("mutation", F.lit("")) != "none").alias("mutations"))
    again = misses.groupBy("subject", "query").count().where(F.col("count") >= t.miss_repeats).groupBy("subject").agg(F.count(F.lit(1)).alias("miss_groups"))
    every = subjects.select("subject").distinct()
    for part in (streaks(runs).select("subject", "streak", "healthy"), ratio, shadow, again):
        every = every.join(part, "subject", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    said = lambda *pairs: F.filter(F.array(*(F.when(cond, F.lit(why)) for cond, why in pairs)), lambda x: x.isNotNull())
    rated = every.withColumn("eligible_ratio", number("eligible_ratio").cast("double"))
    held_b = rated.withColumn("reasons_b", said(
        (F.col("streak").isNull(), NO_STATE), (F.col("streak").isNotNull() & ((F.col("streak") < t.streak) | ~F.col("healthy")), LOW_STREAK), (number("runs") < t.runs_b, FEW_RUNS),
        (F.col("eligible_ratio") < t.eligible_ratio, FEW_WRITES), (number("mutations") > 0, MUTATED),
    ))
    held_c = held_b.withColumn("reasons_c", said((F.size("reasons_b") > 0, NOT_B), (number("runs") < t.runs_c, FEW_RUNS), (number("miss_groups") > t.miss_groups_c, MISSES)))
    status = lambda c: F.when(F.size(c) == 0, "ready").otherwise("hold")
    return held_c.select("subject", status("reasons_b").alias("stage_b"), "reasons_b", status("reasons_c").alias("stage_c"), "reasons_c", "eligible_ratio", number("streak").cast("long").alias("streak"))


def graph_auto(asked: DataFrame, triggers: dict[str, str], probe: DataFrame, *, words: Column, strong: float, weak: float) -> DataFrame:
    """(query_id, reason, fires, score): whether each of ``asked`` (query_id, text) may ask the graph.

    First the patterns of ``triggers`` (category: pattern, case ignored) are tried on the text: a question that has any fires as
    keyword:A+B.  Only the others are probed: their ``words`` (an array of the question's row) meet ``probe`` (word, weight), and the sum over the
    number of words decides: from ``strong`` on it fires (probe_strong), from ``weak`` on it is noted only (probe_weak), else off.
    """
    found = F.filter(F.array(*(F.when(F.coalesce("text", F.lit("")).rlike(f"(?i){p}"), F.lit(c)) for c, p in sorted(triggers.items()))), lambda x: x.isNotNull())
    stage = asked.select("query_id", found.alias("found"), F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))).alias("words"))
    hit = F.size("found") > 0
    first = stage.where(hit).select("query_id", F.concat(F.lit("keyword:"), F.array_join("found", "+")).alias("reason"), F.lit(True).alias("fires"), F.lit(None).cast("double").alias("score"))
    rest = stage.where(~hit)
    met = rest.select("query_id", F.explode("words").alias("word")).join(probe.select("word", "weight"), "word").groupBy(F.col("query_id").alias("q")).agg(F.sum("weight").alias("sum"))
    score = F.round(F.coalesce("sum", F.lit(0.0)) / F.greatest(F.size("words"), F.lit(1)), 6)
    scored = rest.join(met, F.col("query_id") == F.col("q"), "left").select("query_id", score.alias("score"))
    reason = F.when(F.col("score") >= strong, "probe_strong").when(F.col("score") >= weak, "probe_weak").otherwise("off")
    return first.unionByName(scored.select("query_id", reason.alias("reason"), (F.col("score") >= strong).alias("fires"), "score"))
