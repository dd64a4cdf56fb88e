import pandas as pd

import corpus_pipeline
from barloom.llm import decontaminate, near_dedup, packing, pii, toxicity
from barloom.llm.common import staged, table

SMALL = "/root/testdata/sf0.01"


def test_every_stage_decides_as_its_operator_says(spark):
    docs = table(spark, SMALL, "documents")
    ids = lambda frame: {r[0] for r in frame.select("doc_id").collect()}
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    scorer = model.scorer()
    texts = dict(pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    expected = {i for i, t in texts.items() if scorer.score(t.encode()) < model.threshold}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        if name == "near-duplicates":
            expected = {r.id for r in near_dedup.groups(docs).collect() if r.id == r.keeper}
        elif name == "decontamination":
            hits = decontaminate.scan(docs, table(spark, SMALL, "benchmark"))
            expected = {r.doc_id for r in hits.collect() if not r.n_hit}
        elif name == "personal-data":
            new = {r.doc_id: r.text for r in pii.surrogates(docs, key=corpus_pipeline.PII_KEY).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == new
        assert ids(out) == expected
        docs = out
    got = corpus_pipeline.run(spark, SMALL)
    pieces = packing.pieces(docs)
    assert got.count() == pieces.count() and ids(got) == expected
