"""Patches that are applied whole or not at all, and undone in the same way."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemoscope.operators import patches

NOW = datetime(2024, 6, 1, 12)
PROPOSAL = "proposal_id string, id long, action string, decision string, lane string, patch string, expected_sha256 string"


@pytest.fixture()
def table(spark, tmp_path):
    return patches.log(spark, str(tmp_path))


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, json.dumps({"importance": {"score": i * 10, "label": "nice_to_have"}, "keep": [i]})) for i in range(1, 9)]
    rows += [(20, '{"importance": {"label": "must_remember"}}'), (21, '{"lifecycle": {"archived_at": "2024-01-01"}}'), (22, None), (23, "{broken")]
    return spark.createDataFrame(rows, "id long, detail string")


def offer(spark, *rows, action="adjust_importance_score", patch=None, decision=patches.APPROVED, lane=patches.LANE):
    patch = patch or {"importance": {"label": "ignore"}}
    return spark.createDataFrame([(f"p-{r if isinstance(r, int) else r[0]}", r if isinstance(r, int) else r[0], action, decision, lane, json.dumps(patch), None if isinstance(r, int) else r[1]) for r in rows], PROPOSAL)


def details(base, table):
    return {r.id: json.loads(r.detail) for r in patches.current(base, table.read()).collect()}


def receipt(df):
    return df.first()


def test_patches_merge_objects(spark):
    cases = [('{"a": {"x": 1, "y": 2}, "b": 3}', '{"a": {"y": [5]}, "b": {"z": 1}}', '{"a":{"x":1,"y":[5]},"b":{"z":1}}'), (None, '{"a": 1}', '{"a":1}'), ('{"b": 1}', "{}", '{"b":1}'), ('{"b": {"c": 1}}', '{"b": null}', '{"b":null}')]
    df = spark.createDataFrame([c[:2] for c in cases], "d string, p string")
    assert [r[0] for r in df.select(patches.patched(F.col("d"), F.col("p"))).collect()] == [c[2] for c in cases]


def test_apply_and_undo(spark, base, table):
    before = details(base, table)
    got = receipt(patches.apply(table, base, offer(spark, 1, 2, 22, 23), run=0, now=NOW, limits=patches.Limits(importance_per_run=9)))
    assert (got.result, got.applied_rows, got.actions["adjust_importance_score"]) == ("applied", 4, 4)
    after = details(base, table)
    assert after[1] == {"importance": {"score": 10, "label": "ignore"}, "keep": [1]} and after[22] == {"importance": {"label": "ignore"}} and after[3] == before[3]
    assert receipt(patches.undo(table, base, 0, run=1, now=NOW)).result == "applied"
    assert details(base, table) == before
    assert table.read().where("run = 1").count() == 4


def test_undo_is_all_or_nothing(spark, base, table):
    patches.apply(table, base, offer(spark, 1, 2), run=0, now=NOW)
    patches.apply(table, base, offer(spark, 2, patch={"x": 1}), run=1, now=NOW)
    held = details(base, table)
    got = receipt(patches.undo(table, base, 0, run=2, now=NOW))
    assert (got.result, got.reasons) == ("refused", {"target_changed": 1}) and details(base, table) == held
    assert receipt(patches.undo(table, base, 1, run=2, now=NOW)).result == "applied" and receipt(patches.undo(table, base, 0, run=3, now=NOW)).result == "applied"
    assert receipt(patches.undo(table, base, 9, run=4, now=NOW)).reasons == {"no_mutations": 1}
    gone = base.where("id <> 1")
    patches.apply(table, base, offer(spark, 1, patch={"y": 1}), run=5, now=NOW)
    assert receipt(patches.undo(table, gone, 5, run=6, now=NOW)).reasons == {"target_missing": 1}


def test_one_conflict_refuses_the_batch(spark, base, table):
    right = base.where("id = 1").select(patches.digest(F.col("detail"))).first()[0]
    got = receipt(patches.apply(table, base, offer(spark, (1, right), (2, "other")), run=0, now=NOW))
    assert (got.result, got.reasons, got.skipped_rows) == ("refused", {"target_changed": 1}, 2) and table.read().count() == 0
    assert receipt(patches.apply(table, base, offer(spark, (1, right), (77, None)), run=0, now=NOW)).reasons == {"target_missing": 1}
    assert receipt(patches.apply(table, base, offer(spark, (1, None), (1, None)), run=0, now=NOW)).reasons == {"duplicate_target": 1}
    assert receipt(patches.apply(table, base, offer(spark, (1, right)), run=0, now=NOW)).result == "applied"


def test_limits(spark, base, table):
    limits = patches.Limits(rows_per_run=3, rows_per_24h=4, importance_per_run=2, importance_per_24h=3)
    run = lambda df, n, now=NOW, **k: receipt(patches.apply(table, base, df, run=n, now=now, limits=limits, **k))
    stale = {"action": "set_stale_candidate", "patch": {"lifecycle": {"stale_candidate": True}}}
    assert run(offer(spark, 1, 2, 3, 4, **stale), 0).blocked_by == ["max_rows_per_run_exceeded"]
    assert run(offer(spark, 1, 2, 3), 0).blocked_by == ["max_importance_adjustments_per_run_exceeded"]
    assert run(offer(spark, 1, 2), 0, dry_run=True).result == "dry_run" and table.read().count() == 0
    assert run(offer(spark, 1, 2), 0).result == "applied"
    assert run(offer(spark, 1, 2), 1).blocked_by == ["max_importance_adjustments_per_24h_exceeded", "max_retries_per_packet_exceeded"]
    assert run(offer(spark, 5, 6, 7, **stale), 1).blocked_by == ["max_rows_per_24h_exceeded"]
    assert run(offer(spark, 5, 6, 7, **stale), 1, NOW + timedelta(days=2)).result == "applied"


def test_what_takes_no_part(spark, base, table):
    for odd in ({"decision": "rejected"}, {"lane": "other"}, {"action": "drop_table"}):
        assert receipt(patches.apply(table, base, offer(spark, 1, **odd), run=0, now=NOW)).applied_rows == 0
    got = receipt(patches.apply(table, base, offer(spark, 3, 20, 21, action="set_soft_archive_candidate", patch={"lifecycle": {"archived_at": "x"}}), run=0, now=NOW, recently_used=spark.createDataFrame([(3,)], "id long")))
    assert (got.result, got.applied_rows, got.reasons) == ("applied", 0, {"must_remember_protected": 1, "recent_use_conflict_protected": 1, "already_archived_idempotent_skip": 1})


def test_a_repeated_run_replaces_itself(spark, base, table):
    for _ in range(2):
        assert receipt(patches.apply(table, base, offer(spark, 1, 2), run=0, now=NOW)).result == "applied"
    assert table.read().count() == 2
