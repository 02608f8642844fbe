"""The corpus pipeline against its operators, one row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoledger.llm import quality, rules, simhash
from tests.llm.test_documents import LABELS, SCHEMA, classes, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for k in range(300):
        text = prose(k, int(rng.integers(25, 80)))
        if k % 6 == 0:
            text = " ".join(w + "###" for w in text.upper().split())
        if k % 10 == 1:
            text = prose(7, 50)
        rows.append((k, text, "en", "s", len(text), "own", 3, "f", "i"))
        labels.append((k, int(k % 6 > 0), 0))
    rows += [rows[1], (None, None, None, None, None, None, None, None, None), (301, "", None, None, 0, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_what_their_operators_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in df.collect())

    model = quality.fit(docs, labels)
    good = corpus_pipeline.quality_classifier(spark, docs, folder).cache()
    assert good.columns == docs.columns and texts(good) == [t for t in texts(docs) if model([t[1]])[0] >= quality.THRESHOLD]

    trees = rules.fit(good, labels)
    kept = corpus_pipeline.quality_rules(spark, good, folder).cache()
    verdict = {r["doc_id"]: r["kept"] for r in rules.judge(good, trees).collect()}
    assert kept.columns == docs.columns and texts(kept) == [t for t in texts(good) if verdict[None if t[0] == -1 else t[0]]]
    assert kept.where("score = 'own' and kept = 3").count() == kept.count() > 0

    single = corpus_pipeline.near_dedup(spark, kept, folder).cache()
    rest = texts(kept)
    roots = classes([simhash.fingerprint(t) for _, t in rest])
    assert single.columns == docs.columns and texts(single) == sorted({rest[k] for k in roots})

    packed = corpus_pipeline.pack(spark, single, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in single.collect()}


def test_run_ends_as_its_stages_do(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    name = ["doc_id", "start", "length", "ids_crc32"]
    total = lambda df: df.select(F.sum("length"), F.countDistinct("doc_id")).first()
    got = corpus_pipeline.run(spark, folder)
    assert set(name) <= set(got.columns) and total(got) == total(docs)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark, folder):
    """Columns named like what stages add, or like their helpers, come through as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = docs.selectExpr("doc_id", "text", "'s' as Score", "1 as `score (own)`", "2 as `own 0`", "3 as kept", "4 as _row0", "5 as `a.b`", "6 as probability")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns
        assert out.where("Score = 's' and `score (own)` = 1 and `own 0` = 2 and kept = 3 and _row0 = 4 and `a.b` = 5 and probability = 6").count() == out.count() > 0


def test_each_stage_lowers_the_batch(spark, folder):
    """Stages are also called on their own, not only by run()."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set(name, "10000")
        stage(spark, docs, folder)
        assert spark.conf.get(name) == "1000"
    spark.conf.set(name, before)


def test_other_stages_empty_the_memo_of_words():
    import weakref

    import pyarrow as pa

    from geoledger.llm import tokens
    from geoledger.llm.common import text_slices

    batch, path = pa.RecordBatch.from_pydict({"text": ["a b", None]}), tokens.default_tokenizer()
    ids = tokens.encode("some words", path)
    memo = weakref.ref(tokens.encoder(path).__self__)
    assert [t for _, t in text_slices(iter([batch]), memos=True)] == [["a b", ""]] and memo() is not None
    assert [t for _, t in text_slices(iter([batch]))] == [["a b", ""]] and memo() is None
    assert tokens.encode("some words", path) == ids
