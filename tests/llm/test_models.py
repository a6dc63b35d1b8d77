"""Fitted models on held-out labels, and archives read back."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from mnemoscope.llm import linear, site_quality, toxicity, warc_zip

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    return docs, labels.where(~held), labels.where(held)


def test_toxicity_on_held_out_labels(spark):
    """Rare words need more labels than the smallest tables have."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    train, test = labels.where(~held), labels.where(held)
    rows = toxicity.score(docs, toxicity.train(docs, train)).drop("kept").withColumnRenamed("toxic", "said").join(test, "doc_id").collect()
    assert sum(r.said and not r.toxic for r in rows) <= 0.005 * len(rows)
    assert sum(r.said for r in rows) >= 0.9 * sum(r.toxic for r in rows)
    assert sum(bool(r.said) == bool(r.toxic) for r in rows) >= 0.98 * len(rows)


def test_toxicity_edges(spark, hard, nothing, split):
    docs, train, _ = split
    model = toxicity.train(docs, train)
    assert toxicity.score(hard, model).count() == toxicity.reject(hard, model).count() == hard.count()
    assert toxicity.reject(hard, model).columns == hard.columns
    assert toxicity.score(nothing, model).isEmpty() and toxicity.reject(nothing, model).isEmpty()
    for labels in (train.limit(0), train.where("toxic = 0"), train.select(F.lit(None).cast("long").alias("doc_id"), "toxic"), train.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.score(docs, toxicity.train(docs, labels)).where("toxic").isEmpty()


def test_toxic_documents_go(spark, split):
    docs, train, _ = split
    model = toxicity.train(docs, train)
    planted = spark.createDataFrame([(1, "you pathetic worthless idiot, stupid scum"), (2, "a clean and quiet line")], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.reject(planted, model).collect()] == [2]


def test_toxicity_learns_any_vocabulary(spark):
    """Two kinds of toxic documents in invented words: the earlier models tell them apart, and held-out ones are found."""
    r = np.random.default_rng(4)
    bad = [["zorgun", "plakto", "mivrel"], ["quessa", "durnip", "folbat"]]
    rows = []
    for i in range(900):
        own = [f"w{k}" for k in r.integers(0, 60, 30)]
        if i % 3:
            own[5:7] = r.choice(bad[i % 3 - 1], 2, replace=False).tolist()
        rows.append((i, " ".join(own), int(i % 3 > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, docs.where("doc_id < 600").select("doc_id", "toxic"))).where("doc_id >= 600").collect()
    assert sum(g.toxic == (g.doc_id % 3 > 0) for g in got) >= 0.98 * len(got)
    early = np.array([list(g)[1:-3] for g in got])
    kind = np.array([g.doc_id % 3 for g in got])
    assert early[kind == 0].max() < 0.5 and (early[kind > 0].max(axis=1) > 0.5).mean() > 0.95
    assert all(len(set(early[kind == k].argmax(axis=1))) == 1 for k in (1, 2)) and early[kind == 1].argmax() % 2 != early[kind == 2].argmax() % 2


def test_toxicity_on_held_out_labels_by_language(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held))).select("doc_id", F.col("toxic").alias("said"))
    rows = scored.join(labels.where(held), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("toxic = 1")
    recall = {r.lang: (r.found, r.n) for r in rows.groupBy("lang").agg(F.count_if("said").alias("found"), F.count(F.lit(1)).alias("n")).collect()}
    assert len(recall) > 1 and all(found >= 0.7 * n for found, n in recall.values()), recall


def test_chain_uses_out_of_fold_predictions():
    r = np.random.default_rng(1)
    x = (r.random((600, 6)) < 0.5).astype(np.float32)
    first = (x[:, 0] > 0).astype(float)
    second = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    models = linear.chain(x, np.column_stack([first, second]), linear.folds(np.arange(600), 5), 5)
    p = linear.apply_chain(models, x)
    assert len(models[1].weight) == 7 and ((p > 0.5) == np.column_stack([first, second]).astype(bool)).mean() > 0.99


def test_logistic_one_class():
    assert linear.fit(np.ones((5, 2)), np.ones(5))(np.ones((1, 2)))[0] > 0.9
    assert linear.fit(np.zeros((0, 2)), np.zeros(0))(np.ones((1, 2)))[0] < 1e-6


def site_docs(docs):
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.concat("source", F.lit("/"), "lang").alias("path"))


def test_quality_on_held_out_labels(split):
    docs, train, test = split
    docs = site_docs(docs)
    rows = site_quality.judge(docs, site_quality.train(docs, train)).join(test, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_sites_shrink_towards_what_is_above(spark, split):
    """A bad site pulls a borderline document down; a site of one document says almost nothing."""
    docs, train, _ = split
    model = site_quality.train(site_docs(docs), train)
    good, bad = [r.text for r in docs.join(train.where("quality = 1"), "doc_id").limit(40).collect()], [r.text for r in docs.join(train.where("quality = 0"), "doc_id").limit(20).collect()]
    rows = [(i, t, "good.example", "good.example/a") for i, t in enumerate(good)] + [(100 + i, t, "bad.example", "bad.example/a") for i, t in enumerate(bad)] + [(200, good[0], "bad.example", "bad.example/b"), (201, good[0], "lone.example", "lone.example/a")]
    got = {r.doc_id: r for r in site_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), model).collect()}
    mean = sum(r.p_document for r in got.values()) / len(got)
    assert got[0].p_path > mean > got[100].p_path and got[200].p_path < mean
    assert abs(got[201].p_path - mean) < 0.1 and got[0].kept and not got[100].kept


def test_repeated_labelled_rows_reach_the_driver_once(spark, split, monkeypatch):
    docs, train, _ = split
    one = train.limit(1).select("doc_id")
    many = docs.join(one, "doc_id").crossJoin(spark.range(20_000).select(F.lit(1).alias("x"))).drop("x")
    model = site_quality.train(site_docs(docs.union(many)), train)
    plain = site_quality.train(site_docs(docs), train)
    assert np.allclose(model.mean, plain.mean) and np.allclose(model.logistic.weight, plain.logistic.weight)


def test_sites_of_addresses(spark):
    urls = ["https://Docs.Example.org/guide/a?x=1", "http://example.org", "http://user@example.org:8080//a/b", "not an address", None]
    host, path = site_quality.site_of(F.col("url"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()]
    assert got == [("docs.example.org", "docs.example.org/guide"), ("example.org", "example.org/"), ("example.org", "example.org/a"), (None, None), (None, None)]


def test_shrinkage_against_plain_sums(spark, split):
    """Priors of hosts and paths by hand, from the probabilities of the documents."""
    docs, train, _ = split
    rows = site_quality.judge(site_docs(docs), site_quality.train(site_docs(docs), train)).collect()
    p = {r.doc_id: round(r.p_document * 1e6) for r in rows}
    group = lambda key: {k: [p[r.doc_id] for r in rows if getattr(r, key) == k] for k in {getattr(r, key) for r in rows}}
    hosts, paths, n = group("host"), group("path"), len(rows)
    mean = (sum(p.values()) / 1e6 + 0.5) / (n + 1)

    def strength(groups):  # (n, sum, prior)
        between = sum(m * (s / m - q) ** 2 for m, s, q in groups)
        spread = (between - sum(q * (1 - q) for *_, q in groups)) / sum(m for m, *_ in groups)
        typical = sum(m * q * (1 - q) for m, _, q in groups) / sum(m for m, *_ in groups)
        return round(min(1e6, max(1.0, typical / spread - 1)), 3) if spread > 1e-9 else 1e6

    kh = strength([(len(v), sum(v) / 1e6, mean) for v in hosts.values()])
    inner = {h: (sum(v) / 1e6 + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength([(len(v), sum(v) / 1e6, inner[k.rsplit("/", 1)[0]]) for k, v in paths.items()])
    for r in rows[:50]:
        host = (sum(hosts[r.host]) / 1e6 - r.p_document + kh * mean) / (len(hosts[r.host]) - 1 + kh)
        path = (sum(paths[r.path]) / 1e6 - r.p_document + kp * host) / (len(paths[r.path]) - 1 + kp)
        assert abs(host - r.p_host) < 1e-6 and abs(path - r.p_path) < 1e-6


def test_quality_edges(spark, hard, nothing, split):
    docs, train, _ = split
    model = site_quality.train(site_docs(docs), train)
    nulls = hard.withColumn("host", F.when(F.col("doc_id") % 2 == 0, "h")).withColumn("path", F.lit(None).cast("string"))
    assert site_quality.judge(nulls, model).count() == hard.count()
    assert site_quality.judge(nulls, model).where("p_good is null or kept is null").isEmpty()
    assert site_quality.judge(nothing, model).isEmpty()
    assert site_quality.judge(nulls, site_quality.train(site_docs(docs), train.limit(0))).count() == hard.count()


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    out = io.BytesIO()
    w = warc_zip.ZipWriter(out, force64=wide)
    members = {"a.txt": b"x" * 1000, "dir/b.bin": bytes(range(256)), "empty": b""}
    for name, body in members.items():
        w.member(name, len(body), zlib.crc32(body), [body])
    w.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
    asked = []
    r = warc_zip.ZipReader(lambda at, n: asked.append(n) or data[at : at + n], len(data))
    assert {n: data[a : a + k] for n in members for a, k in [r.range_of(n)]} == members


def test_zip_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"with a PK\x05\x06 in it"
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 100, compress_type=zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    r = warc_zip.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, n = r.range_of("stored")
    assert data[at : at + n] == b"abc"
    with pytest.raises(ValueError, match="compressed"):
        r.range_of("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.ZipReader(lambda at, n: b"nothing"[at : at + n], 7)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 2000)
    rows = [(i, f"https://x.example/{i}", f"<p>page {i % 40}</p>") for i in range(120)]
    rows += [(900, None, None), (901, "u v\r\n", ""), (None, "x", "<p>page 1</p>"), (None, "y", "alone"), (902, "é", "é€\U0001d538"), (902, "é", "é€\U0001d538"), (903, "z", "long " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("last_id", F.lit(2)).repartition(3)
    folder = warc_zip.archive_folder(spark)
    archives = warc_zip.write_archives(pages, folder)
    back = warc_zip.read_archives(archives, folder)
    got = sorted((tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == brute.warc_rows([(i, h) for i, _, h in rows]) and archives.count() > 3
    assert back.rdd.getNumPartitions() == archives.count()
    lean = warc_zip.read_archives(archives, folder, payloads=False)
    assert lean.columns == back.columns[:-1] and lean.count() == back.count()
    bodies = {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert all(bodies[i] == (h or "") for i, _, h in rows if i in bodies and i is not None)
    with zipfile.ZipFile(archives.first().path) as z:
        assert z.testzip() is None


def test_no_pages(spark):
    folder = warc_zip.archive_folder(spark)
    archives = warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert archives.isEmpty() and warc_zip.read_archives(archives, folder).isEmpty()
