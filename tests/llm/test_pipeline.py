"""The pipeline, stage by stage, against plain versions on a small table."""

import numpy as np

import corpus_pipeline
from newswarden.llm import ngram_join, quality, sp_bpe
from newswarden.llm.queries import SP_MODEL
from tests.llm.test_decontam import brute as hits
from tests.llm.test_ngram_join import brute as classes

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = []
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DIR)
        now = spark.createDataFrame(now.collect(), now.schema)
        kept.append(now)
        assert name == list(stages)[-1] or now.columns == docs.columns
    good, unique, clean, private, ids = kept
    ids_of = lambda df: {r.doc_id for r in df.collect()}
    assert all(labels.get(i, 1) == 1 for i in ids_of(good)) or np.mean([labels[i] for i in ids_of(good) if i in labels]) > 0.97
    assert all(i in ids_of(good) for i, q in labels.items() if q == 1)
    want = classes([(r.doc_id, r.text) for r in good.collect()])
    assert ids_of(unique) == {i for i, (least, _, _) in want.items() if i == least}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (unique, clean))
    for i, t in before.items():
        n, hit, _ = hits(t, items)
        assert (i in after) == (hit <= 0.5 * n) and (hit or after[i] == t)
    assert all(hits(t, items)[1] == 0 for i, t in after.items() if after[i] != before[i])
    assert ids_of(private) == ids_of(clean) == ids_of(ids) and not [r for r in private.collect() if "@mail" in (r.text or "") and r.text == after[r.doc_id]]
    model = sp_bpe.load(SP_MODEL)
    texts = {r.doc_id: r.text for r in private.collect()}
    assert all(r.ids == model.library.encode(texts[r.doc_id], add_bos=True, add_eos=True) for r in ids.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "ids_sha256").collect())) == sorted((r.doc_id, r.ids_sha256) for r in ids.collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.collect() == [] and quality.GOOD == 0.3 and ngram_join.THRESHOLD == 0.8
