"""Nearest neighbours against brute force, and on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import ann
from readloom.llm.registry import op12_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def true_neighbours(items: list[tuple[int, list[float]]], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """By plain Python: of each query, (id, cosine), nearest first."""
    items = list({(i, tuple(v)): None for i, v in items})
    out = {}
    for q in queries:
        best: dict[int, float] = {}
        for i, v in items:
            for j, w in items:
                if i == q != j:
                    s = float(np.dot(v, w) / (np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))))
                    best[j] = max(best.get(j, -2.0), s)
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def answers(df) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_query_finds_nine_of_ten_and_scores_exactly(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    norm, place, hit, total = np.sqrt((v * v).sum(1)), {r["vec_id"]: i for i, r in enumerate(rows)}, 0, 0
    got = answers(op12_neighbours(spark, data))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, near in got.items():
        s = v @ v[place[q]] / (norm * norm[place[q]])
        assert len(near) == 5 and q not in dict(near)
        assert all(math.isclose(score, s[place[i]], abs_tol=1e-12) for i, score in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        s[place[q]] = -2
        hit, total = hit + len({i for i, _ in near} & set(ids[np.lexsort((ids, -s))[:5]].tolist())), total + 5
    assert hit >= 0.9 * total


def test_clusters_need_few_visits_and_many_leaves_are_exact_when_all_are_visited(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    v = (centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 12))).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(2000)]
    seen = []
    plain = ann.calibrate
    monkeypatch.setattr(ann, "calibrate", lambda tree, *a: seen.append((plain(tree, *a), tree.leaves)) or seen[-1][0])
    # shards and blocks of queries that are far smaller than the leaves' rows and the queries
    monkeypatch.setattr(ann, "SHARD_BYTES", 8 * 12 * 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    d = spark.createDataFrame(rows, SCHEMA)
    got = answers(ann.search(d, F.col("vec_id") % 50 == 0, recall=1.0))
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    for q, near in got.items():
        s = u @ u[q]
        s[q] = -2
        assert [i for i, _ in near] == np.lexsort((np.arange(2000), -s))[:5].tolist()
    assert len(got) == 40 and seen[0][0] < seen[0][1] / 2


def test_odd_rows_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [
        (0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [2.0, 0.0]), (3, [4.0, 0.0]), (3, [4.0, 0.0]), (9, [0.0, -3.0]),
        (100, [1e-30, 1e-30]), (8, [-1.0, 0.5]), (8, [1.0, 0.5]), (150, [1.0, 0.0]), (150, [0.0, 1.0]), (11, [3e38, 3e38]),
    ]
    bad = [(1, None), (2, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (200, [0.0, -0.0]), (None, [1.0, 0.0]), (250, [1.0, 2.0, 3.0]), (300, [])]
    d = spark.createDataFrame([(i, v, 1) for i, v in good + bad], SCHEMA)
    as_read = [(r["vec_id"], r["embedding"]) for r in d.collect()[: len(good)]]
    want = true_neighbours(as_read, [0, 50, 100, 150], 5)
    got = answers(ann.search(d, F.col("vec_id") % 50 == 0))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_a_third_of_the_rows_being_copies(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).tolist(), 0) for i in range(900)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = answers(ann.search(d, F.col("vec_id") % 50 == 0, recall=1.0))
    want = true_neighbours([(r["vec_id"], r["embedding"]) for r in d.collect()], [0, 150], 5)
    assert len(got) == 18
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    for q in range(0, 900, 150):
        assert [i for i, _ in got[q]] == [i for i in range(0, 21, 3) if i != q][:5] and all(s == got[0][0][1] for _, s in got[q])


def test_few_rows_none_and_further_columns(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, score int")
    assert answers(ann.search(d, F.col("vec_id") == 0)).keys() == {0}
    assert [i for i, _ in answers(ann.search(d, F.col("vec_id") == 0))[0]] == [1, 2]
    assert answers(ann.search(d.where("vec_id = 0"), F.col("vec_id") == 0)) == {}
    assert answers(ann.search(d, F.col("vec_id") == 77)) == {}
    none = ann.search(d.limit(0), F.lit(True))
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]
    clash = d.withColumnsRenamed({"score": "leaf"}).selectExpr("*", "1 AS shard", "2 AS qk", "3 AS block", "4 AS v", "5 AS q", "6 AS id")
    assert answers(ann.search(clash, F.col("q") == 5)).keys() == {0, 1, 2}


def test_tree_and_shards():
    x = ann.unit(np.random.default_rng(1).normal(size=(3000, 6)))
    tree = ann.Tree.fit(x, 200)
    own = tree.assign(x)
    assert 100 < tree.leaves and np.bincount(own).max() <= math.ceil(3000 / 200)
    for q in x[:20]:
        order = list(tree.order(q))
        assert sorted(order) == list(range(tree.leaves))
    first = [list(tree.order(q)).index(leaf) for q, leaf in zip(x[:200], own[:200], strict=True)]
    assert np.mean(first) < tree.leaves / 20
    same = ann.Tree.fit(np.repeat(x[:1], 50, 0), 10)
    assert same.leaves == 1 and list(same.order(x[0])) == [0]
    sizes = np.array([5, 5, 30, 1, 0, 9, 10])
    place = ann.shards(sizes, 10)
    held: dict[int, float] = {}
    for n, (s, parts) in zip(sizes, place, strict=True):
        for k in range(parts):
            held[s + k] = held.get(s + k, 0) + n / parts
    assert max(held.values()) <= 10 and place[2] == (1, 3)
