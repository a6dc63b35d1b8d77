"""Stage gates, questions for the graph, and Unicode's compatibility form."""

import itertools
import sys
import unicodedata

from pyspark.sql import functions as F

from mnemoscope.functions import text
from mnemoscope.operators import gates


def loop(spark, runs=(), writes=(), lifecycle=(), misses=(), subjects=("s",)):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = gates.policy_loop(
        make([(x,) for x in subjects], "subject string"), make(runs, "subject string, ts int, id int, healthy boolean"), make(writes, "subject string, eligible boolean"), make(lifecycle, "subject string, mutation string"), make(misses, "subject string, query string")
    )
    return {r.subject: r for r in out.collect()}


def test_green_evidence_is_ready(spark):
    got = loop(spark, [("s", i, i, i != 3) for i in range(25)], [("s", True), ("s", True), ("s", False)], [("s", "none")] * 2, [("s", "q1"), ("s", "q1"), ("s", "q2")])["s"]
    assert (got.stage_b, got.stage_c, got.eligible_ratio, got.streak) == ("ready", "ready", 0.6667, 21)


def test_every_reason_is_given(spark):
    got = loop(spark, [], [("s", False)], [("s", "archive_candidates")], [("s", q) for q in "aabbcc"])["s"]
    assert got.reasons_b == [gates.NO_STATE, gates.FEW_RUNS, gates.FEW_WRITES, gates.MUTATED] and got.reasons_c == [gates.NOT_B, gates.FEW_RUNS, gates.MISSES]
    assert loop(spark, subjects=("x", "x"))["x"].eligible_ratio == 0.0


def test_order_within_a_time_changes_nothing(spark):
    runs = [("s", 1, 1, True), ("s", 2, 2, False), ("s", 2, 2, True), ("s", 3, 3, True), ("s", 3, 3, True)]
    for order in itertools.islice(itertools.permutations(runs), 0, 120, 40):
        got = gates.streaks(spark.createDataFrame(list(order), "subject string, ts int, id int, healthy boolean")).first()
        assert (got.streak, got.healthy) == (2, True)


def test_only_other_questions_are_probed(spark):
    asked = spark.createDataFrame([(1, "who depends on alpha"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, "alpha x y z"), (6, "DEPENDS and breaks")], "query_id long, text string")
    probe = spark.createDataFrame([("alpha", 1.0), ("beta", 0.4)], "word string, weight double")
    out = gates.graph_auto(asked, {"A": "depends", "B": "breaks"}, probe, words=F.split("text", " "), strong=0.6, weak=0.2)
    assert {r.query_id: (r.reason, r.fires) for r in out.collect()} == {1: ("keyword:A", True), 2: ("probe_strong", True), 3: ("off", False), 4: ("off", False), 5: ("probe_weak", False), 6: ("keyword:A+B", True)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join") :]
    assert "(size(" in joined and "= 0)" in joined or "NOT (size(" in joined  # the filter stands below the join


def test_compatibility_form(spark):
    signs = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows = ["".join(signs[i : i + 97]) for i in range(0, len(signs), 97)] + ["ＴＥＡＭ／Ａ", "é", "", None, "plain"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(text.nfkc(F.col("t"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in rows]
    assert spark.createDataFrame([("ＴＥＡＭ　Ａ",)], "t string").select(text.scope_token(text.nfkc(F.col("t")))).first()[0] == "team-a"


def test_private_marks(spark):
    rows = [("a <PRIVATE> b", True), ("x </private>", True), ("[noexport]", True), ("[Private] x", True), ("[NOMEM]", True), ("private: x", True), ("a private matter", False), ("[deny]", False), (None, False)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, p boolean").select(text.is_private(F.col("t"))).collect()] == [p for _, p in rows]
