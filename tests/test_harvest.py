"""Harvests: details merged, runs repeated and cut short, vectors only for new texts, files put away."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mnemoscope.functions.text import text_vector
from mnemoscope.streaming import harvest


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def stored(spark, store):
    own = harvest.Store(spark, store)
    return own, own.observations.read().orderBy("summary", "id").collect()


def test_details_are_merged(spark):
    lines = [
        {"detail": {"a": 1, "b": {"c": [1, "z"]}}, "extra": [1, 2], "a": 9, "kind": "fact"}, {"detail": "raw words"}, {"detail_json": '{"q": 1}', "x": None}, {"detail": '[1]'}, {"detail": [1, 2]}, {"summary": "s"}, {"detail": 5, "scope": "S"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "i int, line string")
    got = [json.loads(r[0]) for r in df.orderBy("i").select(harvest.merged_detail(F.col("line"))).collect()]
    assert got == [{"a": 9, "b": {"c": [1, "z"]}, "extra": [1, 2]}, {"_raw_detail": "raw words"}, {"q": 1, "x": None}, {"_raw_detail": "[1]"}, {"_detail": [1, 2]}, {}, {"_detail": 5, "scope": "S"}]


def test_harvest_takes_each_file_once(spark, tmp_path):
    inbox, store, away = tmp_path / "inbox", str(tmp_path / "store"), str(tmp_path / "away")
    put(inbox, "a.jsonl", {"summary": "we decided to ship", "scope": "Team A", "importance": "86%"}, {"summary": "same words"}, "{bad", "", {"summary": "  ", "kind": "fact"})
    put(inbox, "b.jsonl.processing", {"summary": "same words", "detail": {"importance": {"score": 0.6}}})  # left by an earlier run
    harvest.harvest(spark, str(inbox), store, archive=away)
    assert sorted(os.listdir(away)) == ["a.jsonl", "b.jsonl.processing"] and [f for f in os.listdir(inbox) if not f.startswith(".")] == []
    put(inbox, "c.jsonl", {"summary": "same words"}, {"summary": "new words"})
    receipts = [tuple(r)[1:6] for r in harvest.harvest(spark, str(inbox), store, archive=away).orderBy("batch").collect()]
    assert receipts == [(5, 4, 1, 2, {"must_remember": 1, "nice_to_have": 1, "unknown": 2}), (2, 2, 0, 1, {"unknown": 2})]
    own, rows = stored(spark, store)
    assert [(r.summary, r.kind, r.scope, r.label) for r in rows if r.label != "unknown"] == [("same words", "note", None, "nice_to_have"), ("we decided to ship", "decision", "team-a", "must_remember")]
    assert len({r.id for r in rows}) == 6 and own.vectors.read().count() == 3
    assert harvest.harvest(spark, str(inbox), store, archive=away).count() == 2 and len(stored(spark, store)[1]) == 6


@pytest.mark.parametrize("killed_at", ["vectors", "receipts"])
def test_a_killed_run_is_repeated(spark, tmp_path, monkeypatch, killed_at):
    """A batch that broke off after its rows were written is written anew by the next run: nothing twice, nothing lost."""
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    put(inbox, "a.jsonl", *({"summary": f"text {i % 7}", "n": i} for i in range(30)))
    whole = harvest.BatchTable.write

    def broken(self, rows, batch):
        if self.folder.endswith(killed_at):
            raise RuntimeError("killed")
        whole(self, rows, batch)

    monkeypatch.setattr(harvest.BatchTable, "write", broken)
    with pytest.raises(Exception, match="killed"):
        harvest.harvest(spark, str(inbox), store)
    monkeypatch.setattr(harvest.BatchTable, "write", whole)
    receipts = harvest.harvest(spark, str(inbox), store, archive=str(tmp_path / "away")).collect()
    own, rows = stored(spark, store)
    assert sorted(json.loads(r.detail)["n"] for r in rows) == list(range(30)) and own.vectors.read().count() == 7
    assert [(r.inserted, r.embedded) for r in receipts] == [(30, 7)] and os.listdir(tmp_path / "away") == ["a.jsonl"]


def test_half_written_batches_are_not_read(spark, tmp_path):
    table = harvest.BatchTable(spark, str(tmp_path / "t"), "id long")
    assert table.read().count() == 0
    table.write(spark.range(3), 0)
    table.write(spark.range(5), 1)
    table.write(spark.range(4), 0)
    os.remove(tmp_path / "t" / "batch-000000001" / "_SUCCESS")
    assert table.batches() == [0] and table.read().count() == 4


def test_text_vectors(spark):
    rows = spark.createDataFrame([("a b c",), ("c, B a!",), ("a b d",), ("x y z",), ("",), (None,)], "text string").select(text_vector(F.col("text"), 64).alias("v")).collect()
    v = [r.v for r in rows]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    assert v[0] == v[1] and cosine(v[0], v[2]) > cosine(v[0], v[3]) and v[4] == v[5] == [0.0] * 64


def test_remember(spark):
    rows = spark.createDataFrame([(" Buy milk ", "plan", 0.456, "Team"), ("  ", None, 0.9, None), (None, None, None, ""), ("we decided so", None, 7.0, " ")], "text string, category string, importance double, scope string")
    got = [(r.error, r.kind, r.importance, r.label, r.scope, r.markdown) for r in harvest.remember(rows).collect()]
    assert got == [
        (None, "plan", 0.456, "ignore", "Team", "- [PLAN] Buy milk (importance: 0.46, ignore)"), ("empty text", None, None, None, None, None), ("empty text", None, None, None, None, None),
        (None, "decision", 1.0, "must_remember", None, "- [DECISION] we decided so (importance: 1.00, must_remember)"),
    ]


def test_costly_values_are_made_once(spark):
    """A line is taken apart once for its merged detail, and a vector is made once though a filter names it too."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.createDataFrame([("{}",)], "line string")
    assert plan(lines.select(harvest.merged_detail(F.col("line")))).count("line#") <= 4
    vectors = lines.select(text_vector(F.col("line"), 16).alias("v")).where("exists(v, x -> x <> 0)")
    assert plan(vectors).count("ArrowEvalPython") == 1
