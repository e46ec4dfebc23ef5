"""The pipeline, stage by stage, on what its predecessor kept."""

import corpus_pipeline
from starcheck.llm.scratch import Scratch


def test_stages_keep_columns_and_clean_documents(spark, docs, rows):
    scratch, kept = Scratch(spark, "test-stages"), docs
    counts = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = scratch.write(stage(spark, kept, "/root/testdata/sf0.001"), f"{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
            ids = {r.doc_id for r in found.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = found
        counts.append(kept.count())
    assert counts[0] > counts[1] > 0
    assert {"sequence_id", "offset", "ids"} <= set(kept.columns)


def test_stages_take_an_empty_table(spark, no_docs):
    scratch, kept = Scratch(spark, "test-empty"), no_docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = scratch.write(stage(spark, kept, ""), f"{number}")
        assert kept.count() == 0
