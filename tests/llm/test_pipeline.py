"""The pipeline's stages, each against a plain version on its own input."""

import hashlib

import corpus_pipeline
from speechtab.llm import op3_quality
from speechtab.llm.common import materialize, table
from tests.llm.test_op1 import brute as base_spans
from tests.llm.test_op8 import brute as hits
from tests.llm.test_op10 import grouped

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect())
        if name != "tokens":
            assert docs.columns == table(spark, SF, "documents").columns
    before, after = seen["quality"]
    labels = table(spark, SF, "labels")
    source = table(spark, SF, "documents").select("doc_id", "text")
    verdict = {r.doc_id: r.kept for r in op3_quality.judge(source, op3_quality.fit(source, labels)).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if verdict[r.doc_id]}
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(good.get(r.doc_id, 0) == 1 for r in after) >= 0.95 * sum(good.get(r.doc_id, 0) == 1 and len(r.text.split()) >= 50 for r in before)

    before, after = seen["near_copies"]
    assert {r.doc_id for r in after} == grouped([(r.doc_id, r.text) for r in before])

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {h[0] for h in hits([(r.doc_id, r.text) for r in before], items) if h[5]}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad

    before, after = seen["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        if base_spans(r.text):
            assert not base_spans(texts[r.doc_id])
        else:
            assert texts[r.doc_id] == r.text

    before, after = seen["tokens"]
    assert {r.doc_id: r.decoded_sha256 for r in after} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before}
    assert all(r.exact for r in after)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "doc_id" in out.columns
