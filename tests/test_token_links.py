"""Links of turns by shared tokens, and their clusters, against all pairs."""

import random

import pytest

from mnemoscope.plans import filters_joins


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """Turns of few words each; some are told twice, some have no words, no turn or no conversation."""
    folder, draw = str(tmp_path_factory.mktemp("told")), random.Random(5)
    words = [f"word{i}" for i in range(60)]
    rows = [(conv, turn, "user", " ".join(draw.sample(words[:4] if draw.random() < 0.2 else words, draw.choice([1, 2, 2, 3])))) for conv in range(230) for turn in range(2)]
    rows += [r for r in rows if r[0] % 7 == 0] + [(5, 7, "user", None), (6, 7, "user", ""), (None, 1, "user", "word1 word2"), (8, None, "user", "word1 word2")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def links(rows):
    """{(event, event of another session): rows of shared tokens}"""
    at, out = [(c * 1000 + t, c, set(text.split())) for c, t, _, text in rows if None not in (c, t, text)], {}
    for a, s, x in at:
        for b, r, y in at:
            if s != r and s % 5 == r % 5 and x & y:
                out[a, b] = out.get((a, b), 0) + len(x & y)
    return {pair: n for pair, n in out.items() if n >= 2}


@pytest.mark.parametrize("frequent", [2, 8])
def test_clusters_of_turns(spark, told, monkeypatch, frequent):
    monkeypatch.setattr(filters_joins, "FREQUENT", frequent)
    folder, rows = told
    found, label = links(rows), {}
    for pair in found:
        label |= {x: x for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in found:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = filters_joins.token_components(spark, folder).collect()
    assert len(got) == len(label) and {r.node: r.label for r in got} == label


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark, told, monkeypatch):
    monkeypatch.setattr(filters_joins, "PAIRS_A_TASK", 20)
    folder, rows = told
    got = filters_joins.jon_token_links(spark, folder)
    assert got.rdd.getNumPartitions() > 4
    asked = {(a, b): n for (a, b), n in links(rows).items() if a // 1000 % 100 == 0}
    assert asked and {(r.event_id, r.other_id): r.shared for r in got.collect() if r.event_id is not None and r.other_id is not None} == asked
