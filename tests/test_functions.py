"""Column functions on small cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemoscope.functions import json_text, scoring, text
from mnemoscope.plans import cards


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def value(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(f(F.col("x")).alias("y")).collect()]


def test_language(spark):
    assert value(spark, ["今天天氣很好", "使用 Spark 引擎處理資料", "plain words", "", None, "123", "記憶"], text.language) == ["zh", "mixed", "en", "en", "en", "en", "zh"]


def test_scope(spark):
    assert value(spark, ["  My Team ", "a//b--c", "::x::", "!!!", "", None, "A.B_c:d/e"], text.scope_token) == ["my-team", "a//b-c", "x", None, None, None, "a.b_c:d/e"]


def test_fingerprint(spark):
    assert value(spark, ["Hello,  World!", "hello world", "我愛 Spark！", "?!"], text.fingerprint) == ["hello world", "hello world", "我愛 spark", ""]


def test_token_set(spark):
    assert [sorted(x) for x in value(spark, ["The quick fox and the Fox via 記憶庫 ab", ""], text.token_set)] == [["fox", "quick", "記憶庫"], []]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("docs/a.md#L10", ("file_line", "docs/a.md", 10, 10, None)), ("docs/a.md#L10-L20", ("file_line", "docs/a.md", 10, 20, None)), ("a#L9-3", ("file_line", "a", 9, 9, None)), ("a.md#part-two", ("file_anchor", "a.md", None, None, "part-two")),
        ("https://x.example/y#L3", ("url", None, None, None, None)), ("receipt:abc", ("receipt", None, None, None, None)), ("some words", ("opaque", None, None, None, None)), ("  ", ("none", None, None, None, None)), (None, ("none", None, None, None, None)),
    ],
)
def test_provenance(spark, raw, expected):
    assert tuple(value(spark, [raw], text.provenance)[0]) == expected


def test_kinds(spark):
    rows = [("We decided on Parquet", ""), ("I prefer tabs", "note"), ("The failed job was fixed", "tool"), ("plan to migrate", None), ("x", "entity"), ("偏好深色", "note"), ("hello", "NOTE")]
    df = spark.createDataFrame(rows, "t string, k string").select(text.kind_of(F.col("t"), F.col("k")).alias("y"))
    assert [r.y for r in df.collect()] == ["decision", "preference", "learning", "plan", "entity", "preference", "note"]


def test_redaction_and_secrets(spark):
    assert value(spark, ["mail a.b@c.example now", "call +1 (555) 010-7788 ok", "nothing 12"], text.redact) == ["mail [REDACTED_EMAIL] now", "call [REDACTED_PHONE] ok", "nothing 12"]
    assert value(spark, ["password: hunter2x", "Bearer abcdefghijklmnopqrstuvwxyz", "the password", "sk-" + "a" * 24], text.looks_secret) == [True, True, False, True]
    assert value(spark, ["my API key and 密碼", "refresh-token", "none"], text.high_risk) == [["api_key", "zh_password"], ["access_token"], []]


def test_each_secret_pattern(spark):
    x = "aB3" * 12
    found = [
        "-----BEGIN RSA PRIVATE KEY-----", "Pwd = x1", f"sk-{x}", f"sk-proj-{x[:10]}-_{x[:6]}", "AKIA" + "A1B2" * 4, f"ghs_{x}", f"github_pat_{x}_", "xoxb-0123456789", f"AWS_SECRET_ACCESS_KEY: {x}",
        f"authorization: bearer {x[:16]}", f"bearer {x[:24]}",
    ]
    assert value(spark, found, text.looks_secret) == [True] * len(found)
    assert not any(value(spark, [f"SK-{x}", "akia" + "A1B2" * 4, f"Bearer {x[:16]}", "sk-proj-short", "a secret", None], text.looks_secret)[:5])


def test_phone_guards_and_risk_separators(spark):
    assert value(spark, ["12+3456789 01", "a+1 555 010 7788b", "1234567"], text.redact) == ["12+[REDACTED_PHONE]", "a[REDACTED_PHONE]b", "1234567"]
    assert value(spark, ["api\tkey", "seed\n phrase", "access__token", "apikey"], text.high_risk) == [["api_key"], ["seed_phrase"], ["access_token"], ["api_key"]]


def test_classified(spark):
    rows = [("We fixed the bug", "note", ""), ("決定採用", None, ""), ("x", " Entity ", ""), ("x", "tool", "memory_store"), (None, "", ""), ("I like tea", "", ""), ("the error", "", "")]
    df = spark.createDataFrame(rows, "t string, k string, tool string").select(text.classified(F.col("t"), F.col("k"), F.col("tool")).alias("y"))
    assert [tuple(r.y) for r in df.collect()] == [
        ("learning", 0.95, "rule:problem-solution"), ("decision", 0.95, "rule:decision"), ("Entity", 1.0, "explicit"), ("note", 0.25, "fallback:memory-store"),
        ("note", 0.25, "fallback:note"), ("preference", 0.95, "rule:preference"), ("note", 0.25, "fallback:note"),
    ]


def test_importance(spark):
    assert value(spark, ["0.86", "86", "86%", "86/100", "Must-Remember", "low", "0.3", "150", "", None, "x"], scoring.parse_importance) == [0.86, 0.86, 0.86, 0.86, 0.8, 0.0, 0.3, 1.0, None, None, None]
    assert value(spark, [0.8, 0.79, 0.5, 0.1, None], scoring.label_of, "double") == ["must_remember", "nice_to_have", "nice_to_have", "ignore", "unknown"]


def test_composite(spark):
    now = F.to_timestamp(F.lit("2024-06-01 15:00:00"))
    ts = lambda s: F.to_timestamp(F.lit(s))
    row = spark.range(1).select(
        scoring.composite(F.lit(1.0), F.lit("must_remember"), F.lit("event"), ts("2024-05-18 00:00:00"), F.lit(0), F.lit("active"), now).alias("a"), scoring.composite(F.lit(1.0), F.lit("unknown"), F.lit("fact"), ts(None), F.lit(10**9), F.lit("stale"), now).alias("b"),
        scoring.composite(F.lit(1.0), F.lit("x"), F.lit("x"), now, F.lit(3), F.lit("soft-archived"), now).alias("c"), scoring.composite(F.lit(-1.0), F.lit("x"), F.lit("x"), now, F.lit(None).cast("int"), F.lit("active"), now).alias("d"),
    ).first()
    assert row.a == pytest.approx(0.6) and row.b == pytest.approx(0.65) and row.c == 0 and row.d == 0


def test_preview_and_tokens(spark):
    assert value(spark, ["a\nb", "x" * 200], lambda c: text.preview(c, 50)) == ["a b", "x" * 49 + "…"]
    assert value(spark, ["", "abcd", "abcde"], text.token_estimate) == [1, 1, 2]


def test_link_confidence(spark):
    f = lambda mode, *v: spark.range(1).select(scoring.link_confidence(mode, *map(F.lit, v)).alias("y")).first().y
    assert f("receipt_co_selection", 3.0, 2.0, 1.0, 1.0, 4.0) == 0.95
    assert f("lexical_fallback", 9.0, 9.0, 9.0, 0.5, 2.0) == pytest.approx(0.46 + 0.1 + 0.055)
    assert f("lexical_backfill_low_confidence", 0.0, 0.0, 0.0, 0.0, 0.0) == 0.3


def test_nested_json_texts(spark):
    deep = "[" * 3000 + "1" + "]" * 3000
    rows = [
        ("a  b", '{"z": ["q", 2, true, null], "a": {"k": "a b"}}', "no json  here"),
        (None, None, ""),
        ("", "{}", '["x", "x"]'),
        ("s", '"' + "y" * 500 + '"', "[" + ",".join(f'"{i:0399}"' for i in range(60)) + "]"),
        ("deep", deep, None),
    ]
    f = spark.createDataFrame(rows, "s string, p string, r string")
    got = [x[0] for x in f.select(json_text.search_text(F.col("s"), F.col("p"), F.col("r"))).collect()]
    assert got[:3] == ["a b\nq\n2\nno json here", "", "x"]
    assert got[3].startswith("s\n" + "y" * 400 + "\n") and len(got[3]) == 2400
    assert got[4].startswith("deep\n")
    assert [x[0] for x in f.select(json_text.spoken(F.col("p"))).collect()][:3] == ["z q 2 True a k a b", "", ""]


def test_bounded_payloads(spark):
    many = "{" + ",".join(f'"k{i:02}": {i}' for i in range(50)) + "}"
    rows = [(None,), ("null",), ("{",), ('["' + "é" * 5000 + '"]',), (many,), ('{"t": "call +49 170 1234567 now"}',), ("[" + "7," * 60 + "7]",)]
    got = [x[0] for x in spark.createDataFrame(rows, "p string").select(json_text.bounded(F.col("p"))).collect()]
    assert got[:3] == [None, None, None]
    assert json.loads(got[3])["original_bytes"] == 4 + 2 * 4096 + 3 and len(got[3].encode()) <= 4096
    kept = json.loads(got[4])
    assert kept["_truncated_items"] is True and len(kept) == 49 and "k48" not in kept
    assert got[5] == '{"t":"call [REDACTED_PHONE] now"}'
    assert json.loads(got[6]) == [7] * 48


def test_source_review_edges(spark):
    rows = [(None,), ("",), (" \r\n\n",), ("\n".join(f"todo: {i}" for i in range(20)) + "\npassword",), ("Decision:\n決定：做\nfollow-up - x",)]
    got = [tuple(x[0]) for x in spark.createDataFrame(rows, "b string").select(cards.source_review(F.col("b"))).collect()]
    assert got == [(0, 0, 0, 0, 0)] * 3 + [(21, 12, 11, 1, 0), (3, 2, 1, 0, 0)]


def test_challenger_needs_evidence(spark):
    rows = [("stale_pressure", -0.1, 0.4, None, None, True), ("stale_pressure", -0.1, None, 90, 0, True), (None, 0.0, 0.4, 1, 1, True), ("reuse_signal", 0.1, 0.9, None, None, True)]
    f = spark.createDataFrame(rows, "code string, delta double, score double, age int, uses int, agrees boolean")
    got = [r[0] for r in f.select(cards.challenged(*(F.col(c) for c in f.columns))).collect()]
    assert [g.risk for g in got] == ["medium", "low", "high", "medium"]
    assert "staleness_evidence_weak" in got[0].reasons and got[2].reasons == ["invalid_importance_reason_code"]


def test_secrets_are_looked_for_where_a_mark_of_them_stands(monkeypatch):
    draw = random.Random(3)
    parts = ["password", "PaSSwd", "pa\u017f\u017fword", ":", "=", " ", "x1", "sk-" + "a" * 20, "sk-proj-" + "b" * 16, "AKIA" + "A1" * 8, "ghp_" + "c" * 20, "github_pat_" + "d" * 20, "xoxb-" + "e" * 10, "-----BEGIN RSA PRIVATE KEY-----",
             "BEARER " + "f" * 24, "Authorization: Bearer " + "g" * 16, "aws_secret_access_key=" + "h" * 20, "a@b.org", "\u0661" * 9, "+1 (555) 123-4567", "."]
    for _ in range(3000):
        value = draw.choice(["", " "]).join(draw.choices(parts, k=draw.randint(1, 4)))
        plain = "[REDACTED_SECRET]" if re.search(text.any_of(text.SECRET_LIKE), value) else re.sub(text.PHONE, "[REDACTED_PHONE]", re.sub(text.EMAIL, "[REDACTED_EMAIL]", value))
        assert json_text._safe(value) == plain, value
    monkeypatch.setattr(json_text, "_SECRETS", [(marks, None) for marks, _ in json_text._SECRETS])
    assert json_text._safe("xy" * 2000) == "xy" * 2000
