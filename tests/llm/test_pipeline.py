"""The corpus pipeline: columns, effects of each stage, and the registered queries on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from feedlake.llm import catalog, decontaminate, quality_rules, secrets
from feedlake.llm.common import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not on this machine")


def test_stages_on_real_rows(spark):
    docs = table(spark, FOLDER, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == first.columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and (after < before or name == "mask_secrets")
    assert decontaminate.overlap_table(docs, table(spark, FOLDER, "benchmark")).count() == 0
    assert secrets.secret_table(docs).filter("spans <> ''").count() == 0
    kept = {r.doc_id for r in quality_rules.rule_table(first).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= kept
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(len(r.token_ids) == r.n_tokens for r in got)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n != "pipeline"))
def test_registered_query(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER).count()
    # The contract gives op8 a row for each hit and op12 rows for each group; all others return one row for each document.
    assert rows == 200 if name not in ("op8_decontaminate", "op12_source_divergence") else rows > 0
