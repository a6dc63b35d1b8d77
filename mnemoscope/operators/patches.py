"""Assisted changes to details that can be undone: patches as rows over a table that stays as it is.

The base table is never written.  A run of patches is a batch of rows that hold a detail before and
after; the present detail of a record is that of its latest row, or the base's (merge on read).  A batch is
written whole or not at all, and a run that is repeated under its number replaces it.

``apply`` takes approved proposals only, checks that each record still has the digest its proposal was made
for, and refuses the whole batch if one has not; limits on rows abort it as well.  ``undo`` restores a run if every
record it changed still is what the run made of it, else nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import BatchTable

#: What may be applied, by whom it must be approved and in which lane. Fixed values.
ACTIONS = ("set_stale_candidate", "adjust_importance_score", "set_soft_archive_candidate")
APPROVED, LANE = "approved_for_apply", "observations.assist"
PATCH = "run long, at timestamp, kind string, packet string, proposal_id string, id long, action string, before string, after string, before_sha256 string, after_sha256 string"
RECEIPT = "run long, result string, applied_rows long, skipped_rows long, reasons map<string,long>, actions map<string,long>, blocked_by array<string>"


@dataclass(frozen=True)
class Limits:
    rows_per_run: int = 5
    rows_per_24h: int = 20
    importance_per_run: int = 3
    importance_per_24h: int = 10
    retries_per_packet: int = 1


def canonical(detail: Column) -> Column:
    """JSON with keys in order at every depth and no spaces; what is no JSON reads as an empty object."""
    return F.coalesce(F.to_json(F.try_parse_json(detail)), F.lit("{}"))


def digest(detail: Column) -> Column:
    return F.sha2(canonical(detail).cast("binary"), 256)


def patched(detail: Column, patch: Column) -> Column:
    """``detail`` with the keys of ``patch``; objects under one key are merged, everything else is replaced. Canonical JSON."""
    top = lambda x: F.from_json(canonical(x), "map<string,variant>")
    a, b = top(detail), top(patch)
    inner = lambda v: F.from_json(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)), "map<string,variant>")

    def merged(k: Column, new: Column) -> Column:
        x, y = inner(a[k]), inner(new)
        both = F.map_concat(F.map_filter(x, lambda i, _: ~F.array_contains(F.map_keys(y), i)), y)
        return F.when(x.isNotNull() & y.isNotNull(), F.parse_json(F.to_json(both))).otherwise(new)

    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return canonical(F.to_json(F.map_concat(kept, F.transform_values(b, merged))))


def log(spark: SparkSession, folder: str) -> BatchTable:
    return BatchTable(spark, f"{folder}/patches", PATCH)


def current(base: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, detail) as of the latest patch of each record of ``base`` (id, detail)."""
    latest = patches.groupBy(F.col("id").alias("i")).agg(F.max_by("after", "run").alias("after"))
    return base.join(latest, F.col("id") == F.col("i"), "left").select("id", F.coalesce("after", canonical(F.col("detail"))).alias("detail"))


def _skipped(detail: Column, action: Column, used: Column) -> Column:
    """Why a record must be left alone, or null."""
    get = lambda path: F.try_variant_get(F.try_parse_json(detail), path, "string")
    archive = action == "set_soft_archive_candidate"
    return (
        F.when(archive & (F.trim(get("$.lifecycle.archived_at")) != ""), "already_archived_idempotent_skip")
        .when(archive & (get("$.importance.label") == "must_remember"), "must_remember_protected").when(archive & used, "recent_use_conflict_protected")
    )


def _receipt(spark: SparkSession, run: int, result: str, applied: int, skipped: int, reasons: dict, actions: dict, blocked: list[str]) -> DataFrame:
    return spark.createDataFrame([(run, result, applied, skipped, reasons, actions, blocked)], RECEIPT)


def apply(
    table: BatchTable, base: DataFrame, proposals: DataFrame, *, run: int, now: datetime, recently_used: DataFrame | None = None, limits: Limits = Limits(), dry_run: bool = False
) -> DataFrame:
    """Apply ``proposals`` (proposal_id, id, action, decision, lane, patch, expected_sha256) as batch ``run``; the receipt.

    Proposals that are not approved, or not of the lane and its actions, don't take part.  A null digest expects nothing.
    Results: applied; dry_run; aborted (a limit, or the same packet was tried before); refused (a record is
    gone, has changed or is named twice).  Only ``applied`` writes, at most ``rows_per_run`` rows.  ``recently_used`` (id) are not archived.
    """
    spark = base.sparkSession
    before = table.read(before=run)
    allowed = proposals.where((F.col("decision") == APPROVED) & (F.col("lane") == LANE) & F.col("action").isin(*ACTIONS))
    state = current(base, before).select(F.col("id").alias("own_id"), F.col("detail").alias("before"))
    used = (recently_used if recently_used is not None else spark.createDataFrame([], "id long")).select(F.col("id").alias("used_id")).distinct()
    met = allowed.join(state, F.col("id") == F.col("own_id"), "left").join(used, F.col("id") == F.col("used_id"), "left").select(
        "proposal_id", "id", "action", "patch", "before", digest(F.col("before")).alias("before_sha256"), "expected_sha256", F.col("used_id").isNotNull().alias("used"),
    )
    why = _skipped(F.col("before"), F.col("action"), F.col("used"))
    conflict = F.when(F.col("before").isNull(), "target_missing").when(F.col("expected_sha256") != F.col("before_sha256"), "target_changed")
    met = met.select("*", conflict.alias("conflict"), F.when(conflict.isNull(), why).alias("why"))
    go = F.col("conflict").isNull() & F.col("why").isNull()
    # One row: everything that is decided on.
    reasons = F.coalesce("conflict", "why")
    each = met.groupBy("action", reasons.alias("reason")).agg(F.count(F.lit(1)).alias("n")).collect()  # actions times reasons
    twice = met.groupBy("id").count().where("count > 1").count()
    packet = allowed.select(F.sum(F.xxhash64("proposal_id", "id", "action", "patch").cast("decimal(38,0)")).cast("string")).first()[0] or "0"
    day = before.where((F.col("kind") == "apply") & (F.unix_timestamp("at") > F.unix_timestamp(F.lit(now)) - 86400))
    past_rows, past_importance = day.agg(F.count(F.lit(1)), F.count_if(F.col("action") == "adjust_importance_score")).first()
    tried = before.where((F.col("packet") == packet) & (F.col("kind") == "apply")).select("run").distinct().count()
    actions = {a: sum(r["n"] for r in each if r["action"] == a and r["reason"] is None) for a in ACTIONS}
    why_not = {x: sum(r["n"] for r in each if r["reason"] == x) for x in sorted({r["reason"] for r in each if r["reason"]})}
    rows, importance = sum(actions.values()), actions["adjust_importance_score"]
    blocked = [name for name, over in (
        ("max_rows_per_run_exceeded", rows > limits.rows_per_run), ("max_rows_per_24h_exceeded", rows + past_rows > limits.rows_per_24h),
        ("max_importance_adjustments_per_run_exceeded", importance > limits.importance_per_run), ("max_importance_adjustments_per_24h_exceeded", importance + past_importance > limits.importance_per_24h),
        ("max_retries_per_packet_exceeded", rows > 0 and tried >= limits.retries_per_packet),
    ) if over]
    if twice:
        why_not["duplicate_target"] = twice
    nothing = dict.fromkeys(ACTIONS, 0)
    skipped = sum(r["n"] for r in each) - rows
    if twice or "target_missing" in why_not or "target_changed" in why_not:
        return _receipt(spark, run, "refused", 0, skipped + rows, why_not, nothing, [])
    if blocked:
        return _receipt(spark, run, "aborted", 0, skipped + rows, why_not, nothing, blocked)
    if dry_run:
        return _receipt(spark, run, "dry_run", 0, skipped + rows, why_not, nothing, [])
    after = patched(F.col("before"), F.col("patch"))
    done = met.where(go).select(F.lit(run).cast("long").alias("run"), F.lit(now).cast("timestamp").alias("at"), F.lit("apply").alias("kind"), F.lit(packet).alias("packet"), "proposal_id", "id", "action", "before", after.alias("after"), "before_sha256")
    table.write(done.withColumn("after_sha256", digest(F.col("after"))), run)
    return _receipt(spark, run, "applied", rows, skipped, why_not, actions, [])


def undo(table: BatchTable, base: DataFrame, undone: int, *, run: int, now: datetime) -> DataFrame:
    """Restore what batch ``undone`` changed, as batch ``run``, if every record is as that batch left it; the receipt, as of ``apply``."""
    spark = base.sparkSession
    before = table.read(before=run)
    made = before.where(F.col("run") == undone)
    state = current(base, before).select(F.col("id").alias("own_id"), digest(F.col("detail")).alias("own_sha256"))
    met = made.join(state, F.col("id") == F.col("own_id"), "left")
    n, lost, changed = met.agg(F.count(F.lit(1)), F.count_if(F.col("own_id").isNull()), F.count_if(F.col("own_sha256") != F.col("after_sha256"))).first()
    reasons = {k: v for k, v in (("target_missing", lost), ("target_changed", changed), ("no_mutations", int(n == 0))) if v}
    if reasons:
        return _receipt(spark, run, "refused", 0, n, reasons, {}, [])
    back = made.select(
        F.lit(run).cast("long").alias("run"), F.lit(now).cast("timestamp").alias("at"), F.lit("undo").alias("kind"), "packet", "proposal_id", "id", "action", F.col("after").alias("before"), F.col("before").alias("after"),
        F.col("after_sha256").alias("before_sha256"), F.col("before_sha256").alias("after_sha256"),
    )
    table.write(back, run)
    return _receipt(spark, run, "applied", n, 0, {}, {}, [])
