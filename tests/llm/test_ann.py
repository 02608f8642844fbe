"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from geoledger.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, is_query, k=5):
    """Answers for usable rows: (query_id, rank) to vec_id, with rounded scores."""
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, a in usable.items():
        if is_query(q):
            scores = sorted((-round(float(a @ v / (np.linalg.norm(a) * np.linalg.norm(v))), 9), i) for i, v in usable.items() if i != q and len(v) == len(a))
            for rank, (s, i) in enumerate(scores[:k], 1):
                out[q, rank] = (i, -s)
    return out


def found(spark, rows, where):
    table = spark.createDataFrame([(i, v, 0, "own") for i, v in rows], SCHEMA)
    got = ann.nearest(table, where).collect()
    return {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in got}


def test_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200 + i, [2 * x for x in rows[4][1]]) for i in range(3)] + [rows[5], rows[5]]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 2.0, 3.0]), (303, [1.0, float("nan"), 0.0, 0.0]), (304, [1.0, float("inf"), 0.0, 0.0]), (None, rows[1][1]), (305, [1.0, 2.0]), (306, []), (307, [2.0, 1.0]), (308, [-1.0, 0.5]), (309, [1.0] * 5)]
    want = brute(dict(rows[:93]).items(), lambda q: q % 3 == 0)
    assert found(spark, rows, "vec_id % 3 = 0") == want


@pytest.mark.parametrize("n", [0, 1, 3, 6])
def test_few_rows(spark, n):
    rows = [(i, [1.0, float(i)]) for i in range(n)]
    assert found(spark, rows, "true") == brute(rows, lambda q: True)


def sphere(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_of(spark, x):
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype("f4")))}))


def recall_and_share(spark, x):
    """Recall of five neighbours of every fiftieth row against brute force, and the share of rows that a query reads."""
    search = ann.Search(table_of(spark, x), "vec_id % 50 = 0")
    got = {(r["query_id"], r["vec_id"]) for r in search.answers().collect()}
    x = x.astype("f4").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 50)
    alike = x[queries] @ x.T
    alike[np.arange(len(queries)), queries] = -9
    best = np.argsort(-alike, axis=1)[:, :5]
    assert len(got) == best.size
    return np.mean([(q, b) in got for q, row in zip(queries.tolist(), best.tolist()) for b in row]), search.read_share()


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(1)
    x = sphere(rng, 500, 32)[rng.integers(0, 500, 50_000)] + 0.08 * rng.normal(size=(50_000, 32))
    recall, share = recall_and_share(spark, x)
    assert recall >= 0.9 and share < 0.02


def test_noise_is_read_as_far_as_recall_needs(spark):
    recall, share = recall_and_share(spark, sphere(np.random.default_rng(1), 4_000, 12))
    assert recall >= 0.9 and share < 0.5


def test_levels_below_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "WHOLE_ROWS", 24)
    monkeypatch.setattr(ann, "FANOUT", 8)
    monkeypatch.setattr(ann, "UPPER_LEAST", 2)
    monkeypatch.setattr(ann, "ROUTE_ROWS", 500)
    rng = np.random.default_rng(6)
    x = sphere(rng, 60, 8)[rng.integers(0, 60, 3_000)] + 0.05 * rng.normal(size=(3_000, 8))
    search = ann.Search(table_of(spark, x), "vec_id % 50 = 0")
    assert len(search.index.levels) >= 3
    copies = {r["uid"]: r["count"] for r in search.index.lists.groupBy("uid").count().collect()}
    assert len(copies) == 3_000 and max(copies.values()) <= ann.MOST_COPIES
    recall, share = recall_and_share(spark, x)
    assert recall >= 0.9 and share < 0.25


def test_one_direction_is_no_endless_tree(spark):
    x = np.outer(np.arange(1, 1_001), [0.5, 0.25])
    got = ann.nearest(table_of(spark, x), "vec_id = 0").collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 4, 5]


def test_queries_in_small_lists_get_whole_answers(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    monkeypatch.setattr(ann, "WHOLE_ROWS", 3)
    rows = [(i, [1.0, float(i) ** 2]) for i in range(40)]
    got = found(spark, rows, "vec_id % 10 = 0")
    assert len(got) == 20


def test_graph_finds_what_all_centroids_would():
    rng = np.random.default_rng(2)
    x = sphere(rng, 4_000, 16)
    index = ann.Centroids(ann.balanced_clusters(x, 200))
    alike = x[:300] @ index.vectors.T
    row, place, distance = index.search(x[:300], 1.1)
    far = np.sqrt(2 - 2 * alike)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(far <= 1.1 * far.min(axis=1, keepdims=True)))))
    got = set(zip(row.tolist(), place.tolist()))
    assert len(want & got) / len(want) > 0.97 and np.allclose(distance, far[row, place], atol=1e-6)


def test_clusters_are_balanced():
    x = np.concatenate((np.random.default_rng(3).normal(size=(1_500, 8)), np.ones((500, 8))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = ann.balanced_clusters(x, 40)
    assert 25 <= len(centroids) <= 80


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "SUBLIST_ROWS", 16)
    monkeypatch.setattr(ann, "SUBLIST_WORK", 500)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in (1 + 0.05 * rng.normal(size=6))]) for i in range(300)]
    assert found(spark, rows, "vec_id % 5 = 0") == brute(rows, lambda q: q % 5 == 0)


def test_a_task_holds_few_answers(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD_ROWS", 50)
    best, rng, out = ann._Best(3), np.random.default_rng(8), []
    near = np.round(rng.random((20, 30)), 2)
    for u in range(30):
        for _ in range(2):  # an entry is in several lists
            out += list(best.add(np.arange(20), np.full(20, 100 + u), near[:, u], np.full(20, u)))
    out += list(best.flush())
    got = {}
    for batch in out:
        for r in batch.to_pylist():
            got.setdefault(r["quid"], set()).add((-r["near"], r["least"], r["uid"]))
    for q in range(20):
        want = sorted((-near[q, u], u, 100 + u) for u in range(30))[:3]
        assert sorted(got[q])[:3] == want


def test_a_query_is_one_row_for_a_block_of_lists(spark, monkeypatch):
    """Noise reads about half of all lists: rows that meet are far fewer than queries times lists, and none of the lists is left out."""
    rows, cut = [], ann._meeting

    def counted(held, streamed, key, part):
        rows.append((key, streamed.count()))
        return cut(held, streamed, key, part)

    monkeypatch.setattr(ann, "_meeting", counted)
    x = sphere(np.random.default_rng(9), 6_000, 24)
    search = ann.Search(table_of(spark, x), "vec_id % 50 = 0")
    lists = search.probes.selectExpr("sum(size(places))").first()[0]
    assert search.answers().count() == 600
    met = dict(rows)["block"]
    assert 120 * 20 < lists and met * 4 < lists
