"""The trees of the pipeline's rules stage."""

import numpy as np

import corpus_pipeline
from geoledger.llm import rules
from tests.llm.test_documents import LABELS, SCHEMA


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def test_rules_stage_learns_from_the_labelled_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = sentence(rng, 60)
        rows.append((k, text.upper() if bad else text, "en", "s", 1, None, None, None, None))
        labels.append((k, int(not bad), 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    trees = rules.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    verdict = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rules.judge(docs, trees).collect()}
    slipped = docs.where("doc_id % 4 > 0 or doc_id = 0")  # what a good classifier leaves: hardly a bad document
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, slipped, str(tmp_path)).collect()}
    assert verdict[0] == (False, False)  # only the trees tell
    assert kept == {k for k, v in verdict.items() if v[0] and k % 4 > 0}
