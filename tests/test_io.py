"""Readers, sinks and streams on files."""

import json

from pyspark.sql import functions as F

from mnemoscope.sources import readers, sinks
from mnemoscope.streaming import events


def test_observation_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": "2024-01-02T03:04:05Z", "tool": "exec", "text_en": "hi", "summary": "今天天氣", "scope": " Team A "}\n\n{bad\n[1]\n{"summary": "x", "ts": "2024-01-02T03:04:05+02:00", "kind": "fact"}\n{"ts": "nonsense"}\n')
    lines = readers.observation_lines(spark, str(tmp_path / "a.jsonl"))
    assert lines.count() == 5 and lines.where("error").count() == 2
    rows = readers.normalised(lines).select("kind", "tool_name", "summary", "summary_en", "lang", "scope", F.date_format("ts", "HH:mm").alias("at")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("note", "exec", "今天天氣", "hi", "zh", "team-a", "03:04"), ("fact", None, "x", None, "en", None, "01:04"), ("note", None, "", None, "en", None, None)], key=str)


def test_topology(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "svc", "tags": ["y", "x", "x"]}, {"id": "b"}, {"id": "b"}], "edges": [{"src": "a", "dst": "b", "type": "uses"}, {"from": "a", "to": "c", "type": "uses", "provenance": "f#L1"}, {"source": "", "target": "b"}]}))
    nodes, edges = readers.topology(spark, str(tmp_path / "t.json"))
    assert sorted((r.node_id, r.node_type, r.tags) for r in nodes.collect()) == [("a", "svc", ["x", "y"]), ("b", "unknown", []), ("b", "unknown", [])]
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "uses", ""), ("a", "c", "uses", "f#L1")]
    assert sorted(map(tuple, readers.topology_issues(nodes, edges).collect())) == [("duplicate_node", "b"), ("unknown_dst", "c")]


def test_runtime_reports(spark, tmp_path):
    for name, body in {"list": [{"id": "a", "status": "ok"}, {"id": "a", "status": "bad"}], "nodes": {"nodes": [{"id": "b", "status": "ok"}]}, "map": {"status_by_node": {"c": "stale"}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows = readers.runtime_report(spark, str(tmp_path)).collect()
    assert sorted((r.node_id, r.status, r.position) for r in rows) == [("a", "bad", 1), ("a", "ok", 0), ("b", "ok", 0), ("c", "stale", 0)]


def test_markdown_chunks(spark):
    text = "intro\n\n# One\npara a\n\npara b\n```\n# not a heading\n```\n## Two\n" + "x" * 500 + "\n# Three\n"
    rows = readers.markdown_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), max_chars=200).orderBy("ordinal").collect()
    assert [(r.ordinal, r.heading_path, len(r.text)) for r in rows] == [(0, "", 5), (1, "One", 38), (2, "One > Two", 200), (3, "One > Two", 200), (4, "One > Two", 100)]
    assert {r.doc_id for r in rows} == {1}


def test_export_round_trip(spark, tmp_path):
    rows = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("kind"), F.concat(F.lit("t"), "id").alias("text"))
    m = sinks.export_jsonl(rows, str(tmp_path / "out"))
    back = spark.read.schema("id long, kind string, text string").json(str(tmp_path / "out"))
    assert m.count() == 3 and sinks.same_rows(rows, back) and not sinks.same_rows(rows, back.where("id > 0"))


def test_artifact_ladder(spark):
    store = spark.createDataFrame([("k1", "global", "trusted", 10), ("k2", "a", "untrusted", 10), ("k3", "a", "trusted", 1)], "sha256 string, scope string, trust string, expires int")
    asked = spark.createDataFrame([("k0", "a", "trusted", 5), ("k1", "b", "trusted", 5), ("k1", "b", "untrusted", 5), ("k2", "b", "trusted", 5), ("k2", "a", "trusted", 5), ("k3", "a", "trusted", 5)], "sha256 string, scope string, trust string, at int")
    got = [(r.sha256, r.scope, r.trust, r.outcome) for r in sinks.retrieval(asked, store).collect()]
    assert sorted(got) == [("k0", "a", "trusted", "missing"), ("k1", "b", "trusted", "returned"), ("k1", "b", "untrusted", "trust_denied"), ("k2", "a", "trusted", "returned"), ("k2", "b", "trusted", "scope_denied"), ("k3", "a", "trusted", "expired")]


def test_index_status(spark):
    v = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1), ("o", 1)], "model string, id long")
    i = spark.createDataFrame([("m", 1), ("n", 1), ("p", 4)], "model string, id long")
    assert {r.model: r.status for r in sinks.index_status(v, i).collect()} == {"m": "stale", "n": "fresh", "o": "missing", "p": "orphaned"}


def lines(*rows):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def test_streamed_ingest_is_incremental_and_idempotent(spark, tmp_path):
    spool, out, state = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "state")
    spool.mkdir()
    e = lambda i, **x: {"event_id": f"e{i}", "ts_ms": 1704067200000 + i, "type": "conversation.user", "session_id": "s", "summary": f"[SCOPE: Proj X] hello {i}"} | x
    (spool / "1.jsonl").write_text(lines(e(1), e(2, summary="mail a@b.example"), e(1), "{bad", "", e(3, type="nope"), e(4, ts_ms=0), e(5, summary="password: hunter2x", type="tool.call")))
    events.ingest(spark, str(spool), out, state).awaitTermination()
    (spool / "2.jsonl").write_text(lines(e(2), e(6)))
    events.ingest(spark, str(spool), out, state).awaitTermination()
    events.ingest(spark, str(spool), out, state).awaitTermination()
    got = {r.event_id: (r.scope, r.summary, r.redacted) for r in spark.read.parquet(out).collect()}
    assert got == {"e1": ("proj-x", "hello 1", False), "e2": (None, "mail [REDACTED_EMAIL]", True), "e5": (None, "[REDACTED]", True), "e6": ("proj-x", "hello 6", False)}


def test_bad_lines_are_told_apart(spark):
    rows = spark.createDataFrame([("",), ("{x",), ('{"ts_ms": 1}',), ('{"ts_ms": 5, "type": "tool.call"}',)], "value string")
    got = events.parsed(rows).select("error", F.length("event_id").alias("n")).collect()
    assert [r.error for r in got] == ["blank", "invalid_json", "invalid_event", None] and got[3].n == 64


def plain_chunks(text, most=1600):
    import re

    marked = lambda x: any(m in x.upper() for m in readers.DENY_MARKERS)
    chunks, held, size = [], [], 0
    for piece in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if piece and not marked(piece):
            if held and size + len(piece) + 2 > most:
                chunks.append("\n\n".join(held))
                held, size = [], 0
            if len(piece) > most:
                chunks += [x for i in range(0, len(piece), most) if (x := piece[i : i + most].strip()) and not marked(x)]
            else:
                held.append(piece)
                size += len(piece) + 2
    return chunks + (["\n\n".join(held)] if held else [])


def test_workspace_walk(spark, tmp_path):
    """Markdown files at any depth but hidden ones, packed by paragraphs, marked ones left out."""
    import random

    r = random.Random(4)
    text = "\n \n".join("x" * r.choice([1, 30, 500, 1590, 1600, 1601, 4000]) + r.choice(["", " ", " [nomem]", "\ny"]) for _ in range(60))
    files = {"a.md": text, "deep/er/b.md": "one\n\ntwo\n\n\n[Secret] three", ".hidden/c.md": "no", "deep/.d.md": "no", "e.txt": "no", "f.md": "", "g.md": "x" * 3200}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bad.md").write_bytes(b"ok \xff")
    got = {}
    for row in readers.paragraph_chunks(readers.workspace(spark, str(tmp_path))).orderBy("path", "ordinal").collect():
        got.setdefault(row.path.split(f"{tmp_path}/")[1], []).append(row.text)
    assert got == {"a.md": plain_chunks(text), "deep/er/b.md": ["one\n\ntwo"], "g.md": ["x" * 1600] * 2, "bad.md": ["ok \ufffd"]}
