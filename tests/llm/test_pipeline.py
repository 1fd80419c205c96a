"""Each stage against brute force on its own input."""

from collections import Counter

import __spark_entry__ as contract
import brute
import corpus_pipeline
from linkwright.llm import queries
from linkwright.llm.common import stored


def test_stages_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = docs.columns
    hard = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "&&& ### 123", "en", "s", 11)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        after = docs.collect()
        if name == "language ID":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and len(gone) <= 3 + 0.02 * len(before)
        if name == "line dedup":
            gone = brute.repeated_lines(before, brute.line_keys(spark, before))
            left = {}
            for r in before:
                text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(gone[r.doc_id, r.text]))
                if brute.alnum(text) or not gone[r.doc_id, r.text]:
                    left[r.doc_id] = text
            assert {r.doc_id: r.text for r in after} == left
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "near-duplicates":
            assert sorted(r.doc_id for r in after) == sorted(g[0] for g in brute.near_groups(before) if g[3])
        if name == "decontamination":
            assert sorted(r.doc_id for r in after) == sorted(c[0] for c in brute.contamination(before, items) if not c[5])
        if name != "packing":
            assert docs.columns == schema
        else:
            assert Counter(r.doc_id for r in after).keys() == {r.doc_id for r in before}


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test-empty")
    assert docs.count() == 0
