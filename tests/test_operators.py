"""Ranking, graph, vector and selection operators on small cases."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoscope.operators import graph, lexical, ranking, vector


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rrf_ties_go_to_the_lesser_id(spark):
    lane = lambda ids: frame(spark, [(1, i, r + 1) for r, i in enumerate(ids)], "q int, id int, rank int")
    fused = ranking.fuse({"a": lane([3, 1, 2]), "b": lane([1, 3, 4])}, groups=["q"])
    got = [(r.id, round(r.rrf, 6)) for r in fused.orderBy(F.desc("rrf"), "id").collect()]
    assert got == [(1, round(1 / 61 + 1 / 62, 6)), (3, round(1 / 61 + 1 / 62, 6)), (2, round(1 / 63, 6)), (4, round(1 / 63, 6))]


def test_budget_skips_what_does_not_fit(spark):
    items = frame(spark, [(1, 1, 1, 6), (1, 2, 2, 5), (1, 3, 3, 4), (1, 4, 4, 1), (1, 5, 5, 1)], "q int, place int, id long, tokens long")
    assert [(r.id, r.position, r.used) for r in ranking.pack_within_budget(items, budget=10, limit=9, groups=["q"]).collect()] == [(1, 1, 6), (3, 2, 10)]
    assert [r.id for r in ranking.pack_within_budget(items, budget=12, limit=2, groups=["q"]).collect()] == [1, 2]
    assert [r.id for r in ranking.pack_within_budget(items, budget=3, limit=9, groups=["q"], first_always=True).collect()] == [1]


def test_soft_quota(spark):
    rows = [(1, p, 100 + p, k, e) for p, (k, e) in enumerate([("event", True), ("event", True), ("note", True), ("preference", False), ("decision", True), ("preference", True), ("event", True)], 1)]
    out = ranking.soft_quota(frame(spark, rows, "q int, place int, id long, kind string, eligible boolean"), limit=5, groups=["q"]).orderBy("new_place").collect()
    assert [(r.id, r.reserved, r.capped) for r in out] == [(106, True, False), (105, True, False), (101, False, False), (102, False, False), (103, False, False), (104, False, False), (107, False, True)]


def test_tier_quota_fills_free_places_by_score(spark):
    rows = [("must", i, 1.0 - i / 100, 0) for i in range(5)] + [("nice", 10 + i, 0.5, i) for i in range(3)] + [("unknown", 20, 0.9, 0), ("ignore", 30, 0.99, 0)]
    hits = frame(spark, [(1, *r) for r in rows], "q int, tier string, id long, score double, created int")
    out = ranking.tier_quota(hits, limit=6, must_max=2, nice_min=2, unknown_max=1, groups=["q"])
    assert sorted((r.id, r.wildcard) for r in out.collect()) == [(0, False), (1, False), (11, False), (12, False), (20, False), (30, True)]
    first = ranking.tier_first(hits, limit=6, tiers=("must", "nice"), groups=["q"])
    assert [r.id for r in first.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 12]


def test_blend(spark):
    out = ranking.blend(frame(spark, [(0, 1, 1), (0, 2, 2)], "q int, id int, rank int"), frame(spark, [(0, 9, 0.5), (0, 8, 0.1)], "q int, id int, score double"), groups=["q"])
    assert [(r.id, r.lane) for r in out.orderBy("rank").collect()] == [(9, "graph"), (1, "lexical"), (2, "lexical"), (8, "graph")]


EDGES = [("a", "b", "t", "p"), ("b", "c", "t", "p"), ("c", "a", "t", "p"), ("b", "b", "t", "p"), ("c", "d", "t", "p"), ("x", "y", "t", "p")]


def test_lineage_emits_an_edge_once(spark):
    edges = frame(spark, EDGES, "src string, dst string, type string, provenance string")
    starts = frame(spark, [("a", "a")], "start string, node_id string")
    got = {(r.src, r.dst): r.depth for r in graph.lineage(edges, starts, depth=4).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("b", "b"): 2, ("c", "a"): 3, ("c", "d"): 3}
    up = {(r.src, r.dst): r.depth for r in graph.lineage(edges, starts, depth=2, direction="upstream").collect()}
    assert up == {("c", "a"): 1, ("b", "c"): 2}
    with pytest.raises(ValueError, match="depth"):
        graph.lineage(edges, starts, depth=9)


def test_neighbourhood(spark):
    edges = frame(spark, EDGES, "src string, dst string, type string, provenance string")
    got = {r.node_id: r.distance for r in graph.neighbourhood(edges, frame(spark, [("d", "d")], "start string, node_id string"), depth=2).collect()}
    assert got == {"d": 0, "c": 1, "a": 2, "b": 2}


@pytest.mark.parametrize("hot_keys", [1000, 4])
def test_components_of_chains_and_stars(spark, monkeypatch, hot_keys):
    # With 1,000 every key of so few rows is hot, with 4 only the hub of the star is.
    monkeypatch.setattr(graph, "HOT_KEYS", hot_keys)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 90)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    loose = {x for x in parent if all(a == b for a, b in links if x in (a, b))}
    got = {r.node: r.label for r in graph.components(frame(spark, links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x not in loose}


def test_least_connected():
    rng = random.Random(5)
    for n in (1, 2, 30, 400):
        for links in ([(0, x + 1) for x in range(n)], [(x, x + 1) for x in range(n)], [(x, n) for x in range(n)], [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]):
            links = [(a * 7 - 50, b * 7 - 50) for a, b in links]
            label = {x: x for pair in links for x in pair}
            while more := [(a, b) for a, b in links if label[a] != label[b]]:
                for a, b in more:
                    label[a] = label[b] = min(label[a], label[b])
            nodes, least = graph.least_connected(*(np.array(x, np.int64) for x in zip(*links, strict=True)))
            assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == label


@pytest.mark.parametrize("task_links", [1000, 40, 3])
def test_components_in_one_task_and_in_rounds(spark, task_links):
    links = [(x, x + 1) for x in range(0, 60)] + [(x, 900) for x in range(100, 300)] + [(7, 7), (None, 4), (500, 600), (600, 500)]
    got = graph.components(frame(spark, links, "a long, b long").repartition(3)).collect() if task_links == 1000 else graph.components(frame(spark, links, "a long, b long"), task_links=task_links).collect()
    expected = dict.fromkeys(range(61), 0) | dict.fromkeys([*range(100, 300), 900], 100) | {500: 500, 600: 500}
    assert len(got) == len(expected) and {r.node: r.label for r in got} == expected


def test_components_that_fit_a_task_need_few_jobs(spark):
    links = frame(spark, [(x, x + 1) for x in range(200)], "a long, b long")
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        graph.components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) <= 8


def test_drift_and_diff(spark):
    nodes = frame(spark, [("a", "t", "1"), ("b", "t", "1"), ("c", "t", "1")], "node_id string, node_type string, tag string")
    report = frame(spark, [("a", "OK", 1), ("a", "error", 2), ("b", " ", 1), ("z", "ok", 1)], "node_id string, status string, position int")
    assert {r.node_id: (r.status, r.finding) for r in graph.drift(nodes, report).collect()} == {"a": ("error", "non_ok"), "b": ("unknown", "ok"), "c": (None, "missing_in_runtime"), "z": ("ok", "runtime_only")}
    other = frame(spark, [("a", "t", "1"), ("b", "t", "2"), ("d", "t", "1")], "node_id string, node_type string, tag string")
    assert {r.node_id: r.finding for r in graph.node_diff(nodes, other).collect()} == {"b": "contract_mismatch", "c": "missing", "d": "stale"}
    e = lambda rows: frame(spark, rows, "src string, dst string, type string, provenance string")
    diff = graph.edge_diff(e([("a", "b", "t", "1"), ("a", "b", "t", "2"), ("a", "c", "t", "1")]), e([("a", "b", "t", "2"), ("a", "b", "t", "1"), ("a", "d", "t", "1")]))
    assert {(r.src, r.dst): r.finding for r in diff.collect()} == {("a", "c"): "missing", ("a", "d"): "stale"}


def test_cosine_blocks_and_zero_vectors(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(900, [0.0] * 8), (901, rows0 := [1.0] + [0.0] * 7), (902, rows0)]
    vectors = frame(spark, rows, "id long, vector array<double>").repartition(5)
    asked = vectors.where("id % 100 = 0 or id = 901").select(F.col("id").alias("query_id"), "vector")
    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    data = dict(rows)
    expected = {q: [i for _, i in sorted((-cosine(data[q], v), i) for i, v in rows)[:5]] for q in (0, 100, 200, 900, 901)}
    for block in (4096, 2):
        monkeypatch.setattr(vector, "BLOCK", block)
        got = {}
        for x in vector.cosine_top_k(vectors, asked, 5).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.id)
        assert got == expected


@pytest.mark.parametrize("few", [100_000, 0])
def test_bm25_prefers_rare_terms(spark, monkeypatch, few):
    """Alike with terms broadcast and shuffled."""
    monkeypatch.setattr(lexical, "BROADCAST_KEYS", few)
    docs = frame(spark, [(1, "common rare"), (2, "common common"), (3, "common"), (4, "other")], "id long, text string")
    out = lexical.bm25(docs, frame(spark, [(7, "Common, RARE!")], "query_id int, text string"))
    got = {r.id: r.score for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[1] > got[2]


def test_recall_chooses_lanes(spark):
    from mnemoscope.operators.recall import recall

    docs = frame(spark, [(1, "red apple"), (2, "green pear"), (3, "red pear")], "id long, text string")
    asked = frame(spark, [(7, "red")], "query_id long, text string")
    vectors = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, vector array<double>")
    asked_vectors = frame(spark, [(7, [0.0, 2.0])], "query_id long, vector array<double>")
    see = lambda df: [(r.id, r.lanes, r.mode, r.reason) for r in df.orderBy("rank").collect()]
    assert see(recall(docs, asked, k=2)) == [(1, "lexical", "lexical", "no_vectors"), (3, "lexical", "lexical", "no_vectors")]
    assert see(recall(docs, asked, k=2, mode="vector")) == see(recall(docs, asked, k=2))
    both = see(recall(docs, asked, vectors=vectors, asked_vectors=asked_vectors, k=3))
    assert both[0] == (1, "lexical+vector", "hybrid", "vectors_available") and {r[0] for r in both} == {1, 2, 3}
    assert [r[0] for r in see(recall(docs, asked, vectors=vectors, asked_vectors=asked_vectors, k=1, mode="vector"))] == [2]
    with pytest.raises(ValueError, match="mode"):
        recall(docs, asked, mode="graph")


def test_vectors_that_cannot_be_compared(spark):
    from mnemoscope.operators.vector import cosine_top_k

    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8]), (6, [None, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = cosine_top_k(v, v.select(F.col("id").alias("query_id"), "vector"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (1, 5), (1, 4), (4, 1), (4, 4), (4, 5), (5, 5), (5, 1), (5, 4)]


def test_cjk_terms_and_lanes(spark):
    """Words find words, CJK runs are found inside longer runs, mixed questions by both, and a lane without hits gives way to the other."""
    docs = spark.createDataFrame(
        [(1, "我們決定採用資料庫方案"), (2, "資料 庫"), (3, "the database plan"), (4, "資料庫 database"), (5, None), (6, "")], "id long, text string"
    )
    asked = spark.createDataFrame([(1, "資料庫"), (2, "database plan"), (3, "資料庫方案 database"), (4, "决不存在"), (5, "abc 資料庫方案方案方案")], "query_id long, text string")
    terms = {r.query_id: r.t for r in asked.select("query_id", lexical.cjk_terms(F.col("text")).alias("t")).collect()}
    assert terms[1] == ["資料庫", "資料", "料庫"] and terms[2] == [] and len(terms[5]) == len(set(terms[5])) <= 16
    hits = {(r.query_id, r.id): r.n_terms for r in lexical.substring_hits(docs, asked).collect()}
    plain = {}
    texts = {r.id: r.text or "" for r in docs.collect()}
    for q, ts in terms.items():
        for i, t in texts.items():
            if n := sum(x in t for x in ts):
                plain[q, i] = n
    assert hits == plain
    got = {}
    for r in lexical.routed(docs, asked, 5).collect():
        got.setdefault(r.query_id, {})[r.id] = r.lane
    assert got[1] == {1: "cjk", 4: "cjk", 2: "cjk"} and got[2] == {3: "fts", 4: "fts"} and got[3][4] == "both" and got[3][1] == "cjk" and 4 not in got


def test_relaxed_search(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "blue")], "id long, text string")
    asked = spark.createDataFrame([(1, "red, GREEN"), (2, "red yellow"), (3, "violet")], "query_id long, text string")
    got = sorted((r.query_id, r.id, r.mode) for r in lexical.relaxed(docs, asked).collect())
    assert got == [(1, 1, "and"), (1, 2, "and"), (2, 1, "or"), (2, 2, "or")]


def test_scopes_of_documents(spark):
    from mnemoscope.plans.memory import doc_in_scope

    rows = [("repo", "repo/x"), ("other", "a/team/docs/b"), (None, None), ("docs", "readme")]
    df = spark.createDataFrame(rows, "repo string, path string")
    ask = lambda scope, how, *more: [r[0] for r in df.select(doc_in_scope(F.col("repo"), F.col("path"), F.lit(scope), how, *more)).collect()]
    assert ask("x:repo", "repo_prefix") == [True, False, False, False] and ask("team:docs", "path_prefix") == [False, True, False, False]
    assert ask("s", "map", F.array(F.lit("docs"))) == [False, False, False, True] and ask("s", "map", F.lit(None).cast("array<string>")) == [False] * 4
    assert ask("global", "map", F.lit(None).cast("array<string>")) == [True] * 4 and ask("s", "none") == [True] * 4


def test_ids_that_a_snippet_names(spark):
    rows = [(1, "obs#5", "- obs#1 tool :: alpha\n- obs#5 tool :: harvest test\n"), (2, "harvest status", "- obs#12 x :: harvest\r\n- obs#7 y :: Harvest status of obs#12"), (3, None, "obs#9"), (4, "x", None), (5, "x", "nothing")]
    got = {(r.query_id, r.id): r.score for r in lexical.named_ids(spark.createDataFrame(rows, "query_id long, query string, snippet string")).collect()}
    assert got == {(1, 5): 10, (1, 1): 0, (2, 12): 2, (2, 7): 2, (3, 9): 0}


@pytest.mark.parametrize("at_once", [2, 4096])
def test_the_best_hits_equal_all_hits(spark, monkeypatch, at_once):
    """Scored where the documents lie, or by shuffled pairs if the queries are many: the same rows as the best of all."""
    from mnemoscope.operators import lexical, ranking

    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", at_once)
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["É", "x"]
    docs = spark.createDataFrame([(i, r.choice([None, ""]) if i % 20 == 0 else " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(300)], "id long, text string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(r.sample(words, 1 + q % 4)).upper()) for q in range(9)] + [(9, "nowhere"), (10, None)], "query_id long, text string")
    every = lexical.bm25(docs, asked)
    plain = lambda df: sorted(map(tuple, df.select("query_id", "id", F.round("score", 5), "rank").collect()))
    got = lexical.bm25_best(docs, asked, 6)
    assert plain(got) == plain(ranking.best(every, 6, by=[F.desc("score"), F.col("id")], groups=["query_id"]))
    assert {"every", "need"}.isdisjoint(got.columns) and got.count() > 40
    by = lambda df: sorted(map(tuple, ranking.best(df, 3, by=[F.desc("score"), F.col("id")], groups=["query_id"]).select("query_id", "id", "mode", F.round("score", 5)).collect()))
    assert by(lexical.relaxed(docs, asked, k=3)) == by(lexical.relaxed(docs, asked))


def test_nearest_edges_against_all(spark):
    """All edges within two steps, each at its least depth, cut to the first k; a hub, loops and repeated edges are among them."""
    r = random.Random(3)
    rows = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.choice("xy"), f"p{r.randrange(3)}") for _ in range(40)] + [("hub", f"n{i % 12}", "x", f"p{i}") for i in range(60)] + [("n1", "n1", "x", "p"), ("n1", "n1", "x", "p")]
    starts = [f"n{i}" for i in range(12)] + ["hub", "alone"]
    for k in (1, 4, 25):
        got = graph.nearest_edges(spark.createDataFrame(rows, "src string, dst string, type string, provenance string"), spark.createDataFrame([(s, s) for s in starts], "start string, node_id string"), k)
        want = []
        for s in starts:
            near = {x for e in rows if s in e[:2] for x in e[:2]}
            depth = {e: 1 if s in e[:2] else 2 for e in rows if set(e[:2]) & (near | {s})}
            want += [(s, *e, d, i + 1) for i, (d, e) in enumerate(sorted((d, e) for e, d in depth.items())[:k])]
        assert sorted(map(tuple, got.select("start", "src", "dst", "type", "provenance", "depth", "rank").collect())) == sorted(want)


def test_equal_names_are_searched_once(spark, monkeypatch):
    from mnemoscope import plans

    seen, hits = [], lexical.substring_hits
    monkeypatch.setattr(lexical, "substring_hits", lambda docs, asked: (seen.append((docs.count(), asked.count())), hits(docs, asked))[1])
    plans.QUERIES["ret_cjk"](spark, "/root/testdata/sf0.01")
    assert seen[0][0] == seen[0][1] < 100
