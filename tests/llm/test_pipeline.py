"""The pipeline's stages against plain versions, each on its own input."""

import brute
import corpus_pipeline
from mnemoscope.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, sf_docs):
    docs, columns = sf_docs, sf_docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dup", "decontaminate", "secrets", "mix"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}
    read = lambda df: {r.doc_id: r for r in df.collect()}

    clean = stages["toxicity"](spark, docs, SF).checkpoint()
    before = read(docs)
    assert clean.columns == columns and set(read(clean)) == set(before) - toxic and toxic

    single = stages["near_dup"](spark, clean, SF).checkpoint()
    classes = brute.near_classes([(i, r.text) for i, r in read(clean).items()])
    assert single.columns == columns and set(read(single)) == set(classes.values())

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    fair = stages["decontaminate"](spark, single, SF).checkpoint()
    leaked = {d for d, *_ in brute.leaks([(i, r.text) for i, r in read(single).items()], items)}
    assert fair.columns == columns and set(read(fair)) == set(read(single)) - leaked and leaked

    safe = stages["secrets"](spark, fair, SF).checkpoint()
    assert safe.columns == columns and set(read(safe)) == set(read(fair))
    for i, r in read(safe).items():
        held = any(brute.base_secrets(before[i].text)[:3])
        assert (r.text != before[i].text) >= held and r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars)
        assert not any(brute.base_secrets(r.text)[1:3])

    mixed = stages["mix"](spark, safe, SF)
    expected = {i: t for i, _, _, _, t in brute.mixed([(i, r.text, r.source) for i, r in read(safe).items()]) if t}
    assert {r.doc_id: r.taken for r in mixed.collect()} == expected


def test_run_equals_its_stages(spark, sf_docs):
    docs = sf_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
    key = lambda df: sorted((r.doc_id, r.copies, r.text) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def test_stages_on_hard_rows(spark, hard, nothing):
    """Nulls, repeats and extra columns pass through every stage; an empty table stays empty."""
    for docs in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF).checkpoint()
            assert name == "mix" or out.columns == docs.columns
            docs = out
    assert docs.isEmpty()
