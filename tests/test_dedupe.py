"""Entries against those kept lately, in a table and on a stream that is stopped and started again."""

import json
import random
import re

import pytest

from mnemoscope.streaming import dedupe

SCHEMA = "scope string, ts timestamp, id long, text string"


@pytest.fixture()
def state_store(spark):
    for k, v in dedupe.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in dedupe.STATE_STORE:
        spark.conf.unset(k)


def entries(spark, rows):
    return spark.createDataFrame(rows, "scope string, hour double, id long, text string").selectExpr("scope", "timestamp_seconds(1704067200 + cast(hour * 3600 as long)) as ts", "id", "text")


def plain(rows, hours=24):
    """Each entry against all kept ones of its scope, the latest 64."""
    kept = {}
    for scope, hour, i, text in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        own = kept.setdefault(scope or "", [])
        form = "".join(c if c.isalnum() else " " for c in re.sub("<[^>]+>", " ", (text or "").lower())).split()
        same = lambda a, b: bool(a and b) and (a == b or (min(len(" ".join(a)), len(" ".join(b))) >= 30 and (" ".join(a) in " ".join(b) or " ".join(b) in " ".join(a))) or len(set(a) & set(b)) >= 0.92 * len(set(a) | set(b)))
        if not any(hour - h <= hours and same(form, f) for h, _, f in own[-64:]):
            own.append((hour, i, form))
    return sorted(i for own in kept.values() for _, i, _ in own)


def ids(df):
    return sorted(r.id for r in df.collect())


def some_rows(n=400):
    r = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    base = [r.sample(words, 14) for _ in range(8)]
    rows = []
    for i in range(n):
        said = list(r.choice(base))
        if r.random() < 0.4:
            said[r.randrange(14)] = "other"
        if r.random() < 0.3:
            said.append("more")
        text = r.choice([" ", ", ", "<b> "]).join(said)
        rows.append((r.choice(["a", "b", None]), float(i // 3), i, r.choice([text, text.upper(), None, "..."]) if r.random() < 0.3 else text))
    return rows


def test_the_window_runs_from_the_last_kept(spark):
    rows = [("a", 0.0, 1, "Buy milk"), ("a", 20.0, 2, "buy milk!"), ("a", 40.0, 3, "buy <i>milk"), ("b", 20.0, 4, "buy milk"), ("a", 64.0, 5, "buy milk"), ("a", 64.1, 6, "buy milk")]
    assert ids(dedupe.first_in_window(entries(spark, rows))) == [1, 3, 4, 6]


def test_near_texts_count(spark):
    long = "call the plumber about the kitchen sink on monday"
    rows = [("a", 0.0, 1, long), ("a", 1.0, 2, long + " at nine"), ("a", 2.0, 3, "call the plumber"), ("a", 3.0, 4, " ".join(f"w{i}" for i in range(24))), ("a", 4.0, 5, " ".join(f"w{i}" for i in range(23))), ("a", 5.0, 6, " ".join(f"w{i}" for i in range(2, 26)))]
    assert ids(dedupe.first_in_window(entries(spark, rows))) == [1, 3, 4, 6]


def test_table_against_all_kept(spark):
    rows = some_rows()
    got = ids(dedupe.first_in_window(entries(spark, rows).repartition(5)))
    assert got == plain(rows) and 50 < len(got) < 350


def test_only_the_latest_are_remembered(spark):
    rows = [("a", 0.0, 0, "the first one")] + [("a", 0.1, i, f"thing number{i} x{i}") for i in range(1, 65)] + [("a", 1.0, 99, "the first one")]
    assert 99 in ids(dedupe.first_in_window(entries(spark, rows)))


def test_of_one_time_the_first_is_forgotten_first(spark):
    """The 64 latest are those that came last, not those whose text sorts last."""
    rows = [("a", 0.0, 0, "zz the first one")] + [("a", 0.0, i, f"thing number{i} x{i}") for i in range(1, 65)] + [("a", 1.0, 98, "thing number1 x1"), ("a", 1.0, 99, "zz the first one")]
    assert ids(dedupe.first_in_window(entries(spark, rows))) == [*range(65), 99]


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_a_scope_is_read_in_parts(spark, monkeypatch, parts):
    """A scope is no single task, and parts change nothing: not where each kept entry hangs on the one before, nor where ranges cut a time."""
    rows = some_rows(300) + [("chain", 20.0 * i, 1000 + i, "said again and again") for i in range(60)] + [("once", 5.0, 2000 + i, f"thing number{i % 70} x{i % 70}") for i in range(150)]
    seen, real = [], dedupe._keep
    monkeypatch.setattr(dedupe, "_keep", lambda seconds: seen.append(seconds) or real(seconds))
    assert ids(dedupe.first_in_window(entries(spark, rows).repartition(5), parts=parts)) == plain(rows)
    assert 2 <= len(seen) <= parts + 1


def test_empty_and_nothing(spark):
    assert dedupe.first_in_window(entries(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([("a", None, 1, "x"), ("a", None, 2, "x")], SCHEMA)
    assert ids(dedupe.first_in_window(rows)) == [1, 2]


def test_stale_entries_go(spark):
    from pyspark.sql import functions as F

    df = entries(spark, [("a", 0.0, 1, "x"), ("a", 30.0, 2, "x")])
    assert ids(dedupe.fresh(df, F.timestamp_seconds(F.lit(1704067200 + 7 * 86400 + 1)))) == [2]


def test_stream_restarts_where_it_stopped(spark, state_store, tmp_path):
    """Three runs over growing input keep what one pass over the whole keeps; an idle scope's state goes by its timer."""
    rows = [r for r in some_rows(240) if r[3] is not None]
    spool, out, state = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "state")
    spool.mkdir()
    for part in range(3):
        lines = [json.dumps({"scope": s, "at": 1704067200 + int(h * 3600), "id": i, "text": t}) for s, h, i, t in rows[part * 80 : part * 80 + 80]]
        (spool / f"{part}.jsonl").write_text("\n".join(lines))
        source = spark.readStream.schema("scope string, at long, id long, text string").json(str(spool)).selectExpr("scope", "timestamp_seconds(at) as ts", "id", "text")
        dedupe.first_in_window_stream(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert ids(spark.read.parquet(out)) == plain(rows)
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "recent").load()
    assert left.count() < len(plain(rows))
