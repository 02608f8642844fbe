"""Near copies of the pipeline's stage, against all pairs."""

import numpy as np

import corpus_pipeline
from geoledger.llm import nearcopies, simhash

WORDS = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in "lnrsx"]


def runs(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(runs(a) & runs(b)) / max(1, len(runs(a) | runs(b)))


def changed(text, rng, n):
    words = text.split()
    for k in rng.choice(len(words), n, replace=False):
        words[k] = "changed"
    return " ".join(words)


def test_stage_finds_near_copies_beyond_two_bits(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(40):
        base = " ".join(rng.choice(WORDS, 120))
        texts += [base, base.upper(), changed(base, rng, 1), changed(base, rng, 2), changed(changed(base, rng, 1), rng, 1), changed(base, rng, 30)]
    texts += ["", None, "one two", "One  two", "one two three", *(" ".join(rng.choice(WORDS, 60)) for _ in range(30))]
    marks = [simhash.fingerprint(t or "") for t in texts]
    root, beyond = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            copies, bits = jaccard(a or "", texts[j] or "") >= 0.8, (marks[i] ^ marks[j]).bit_count()
            beyond += copies and bits > 2
            if copies or bits <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert beyond > 20 and got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(i) for i in range(len(texts))})


def test_rows_without_ids_and_columns_of_any_name(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = " ".join(rng.choice(WORDS, 100))
    rows = [(None, base, 1), (7, changed(base, rng, 1), 2), (None, "other text", 3), (7, changed(base, rng, 1), 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid long")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 7] and {3, 5} <= {r["uid"] for r in got}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_large_group_of_near_copies_is_not_multiplied_out(spark, tmp_path, monkeypatch):
    """Texts that are alike with one base, but mostly not with each other: exact classes from few pairs."""
    rng = np.random.default_rng(3)
    base = " ".join(rng.choice(WORDS, 150))
    texts = [changed(base, rng, int(n)) for n in rng.integers(2, 9, 260)]
    texts = [t.replace("changed", f"{WORDS[k % 100]}{k}") for k, t in enumerate(texts)]
    texts += [changed(t, rng, 1) for t in texts[:40]]
    sets, marks, root = [runs(t) for t in texts], [simhash.fingerprint(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) or (marks[i] ^ marks[j]).bit_count() <= 2:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    rows, cut = [], nearcopies.checkpointed

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "checkpointed", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    want = sorted({find(i) for i in range(len(texts))})
    assert got == want and 20 < len(want) < len(texts)
    assert max(rows) <= nearcopies.BANDS * len(texts)
