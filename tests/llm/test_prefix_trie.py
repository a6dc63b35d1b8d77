"""The prefix trie against sets of prefixes, with shards of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mnemoscope.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_nodes(rows, *, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = convs
    if rebuild:
        built = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
            built[c] = convs.get(first, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += node not in children
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(built[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(n=300, seed=1):
    """Conversations with few different turns, so that they share much, some of them long; nulls, ties and repeated turns."""
    r = random.Random(seed)
    said = ["", "yes", "no", "é", "\U0001d538 x", None]
    rows = []
    for c in r.sample(range(-150, 4 * n), n):
        size = r.choice([1, 2, 3, 5, 8, 8, 40])
        for t in range(size):
            text = "always" if c % 3 == 0 else said[0] if t < 2 else r.choice(said)
            rows.append((c, r.choice([t, t, t, None, 1]) if c % 7 == 0 else t, r.choice(["user", None]) if c % 5 == 0 else "user", text))
    rows += rows[:40] + [(None, 1, "user", "lost")]
    r.shuffle(rows)
    return rows


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(x) for x in df.collect()), key=repr)


@pytest.mark.parametrize("shard", [1, 40, 1 << 16])
def test_rebuilt_conversations(spark, shard):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as path", "1 as n", "2 as shard").repartition(7)
    assert got(prefix_trie.trie(prefix_trie.rebuilt_paths(df), shard=shard)) == plain_nodes(rows)


@pytest.mark.parametrize("shard", [1, 60])
def test_conversations_as_they_are(spark, shard):
    rows = some_rows(500, 9)
    assert got(prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA)), shard=shard)) == plain_nodes(rows, rebuild=False)


def test_hot_path_and_long_conversation(spark, monkeypatch):
    """A third of all conversations are equal, so their ids come in blocks; one is long."""
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 50)
    rows = [(c, 0, "user", "same") for c in range(2000)] + [(c, 0, "user", f"t{c % 50}") for c in range(2000, 3000)] + [(9999, t, "user", f"t{t % 7}") for t in range(150)]
    assert got(prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA)), shard=100)) == plain_nodes(rows, rebuild=False)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(prefix_trie.trie(prefix_trie.rebuilt_paths(empty))) == []
    alone = [(105, 3, "user", "one turn")]  # all of it may be taken from a conversation that isn't there
    assert got(prefix_trie.trie(prefix_trie.rebuilt_paths(spark.createDataFrame(alone, SCHEMA)))) == plain_nodes(alone)


def test_find_close():
    r = np.random.default_rng(3)
    for size in (1, 5, 300, 5000):
        bits, depth, left = [], 0, size
        while left or depth:
            if left and (depth == 0 or r.random() < 0.55):
                bits.append(True)
                depth, left = depth + 1, left - 1
            else:
                bits.append(False)
                depth -= 1
        string, stack, close = prefix_trie.Parentheses(np.array(bits)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(bits)
        assert string.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
