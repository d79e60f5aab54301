"""Nearest neighbours against brute force, and their defined cases."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import neighbours
from feedlake.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def exact(rows, k=10, every=100):
    """(query, its row number) -> [(distance, id)] by the plain sum of squares."""
    ids = [i for i, _ in rows]
    points = np.array([v for _, v in rows], np.float64)
    out = {}
    for at, i in enumerate(ids):
        if i % every == 0:
            far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
            out[i] = sorted((far[j], ids[j]) for j in range(len(ids)) if j != at)[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["neighbour"] if "neighbour" in r else r["vec_id"]))
    return out


def recall(got, want):
    assert set(got) <= set(want)
    for q in want:
        assert len(got[q]) == len(want[q])
        assert got[q] == sorted(got[q])
    return np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / max(len(want[q]), 1) for q in want])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op11_neighbours"](spark, path)), exact(rows)
    assert recall(got, want) >= 0.95
    true = {(q, i): d for q, near in want.items() for d, i in near}
    assert all(abs(d - true[q, i]) < 1e-12 for q, near in got.items() for d, i in near if (q, i) in true)


def test_a_third_of_the_rows_are_copies_and_a_third_near_copies(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=16)
    rows = [(i, (hot if i % 3 == 0 else hot + rng.normal(size=16) * 1e-4 if i % 3 == 1 else rng.normal(size=16)).tolist())
            for i in range(3000)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 100 == 0))
    want = exact(rows)
    assert recall(got, want) >= 0.95
    assert got[0] == [(0.0, i) for i in range(3, 33, 3)] and got[300][:2] == [(0.0, 0), (0.0, 3)]


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(neighbours, "HELD", 50)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    got = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0))
    assert recall(got, exact(rows, every=10)) >= 0.93


def test_forest(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(1000, 6))
    tree = neighbours.Tree(points, np.random.default_rng(3))
    leaves = tree.leaves_of(points)
    assert tree.leaves > 8 and set(leaves) == set(range(tree.leaves))
    counts = [np.bincount(leaves, minlength=tree.leaves)]
    margins = tree.margins(points[:1])
    every = neighbours.search([tree], counts, [margins[0]], float("inf"), 10)
    p = tree.priorities(margins[0])
    assert sorted(f for _, f in every) == list(range(tree.leaves))
    assert [p[f] for _, f in every] == sorted(p) and p[leaves[0]] == 0
    few = neighbours.search([tree], counts, [margins[0]], 0.0, 100)
    assert sum(counts[0][f] for _, f in few) > 100 and few == every[:len(few)]
    assert neighbours.Tree(np.ones((500, 6)), np.random.default_rng(3)).leaves == 1


def test_defined_cases(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [3.0, 0.0]), (100, [0.0, 2.0])]
    df = spark.createDataFrame(bad + good, VECTORS).selectExpr("*", "1 AS id", "2 AS h", "'x' AS v", "3 AS rank")
    got = found(neighbours.nearest(df, F.col("id") % 100 == 0))
    root = float(np.sqrt(2.0))
    assert got == {0: [(root, 8), (root, 9), (2.0, 10), (float(np.sqrt(5.0)), 100)],
                   100: [(1.0, 8), (1.0, 9), (float(np.sqrt(5.0)), 0), (float(np.sqrt(13.0)), 10)]}
    assert neighbours.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id < 8 AND vec_id > 0"), F.col("id") % 100 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])], VECTORS)
    assert sorted(map(tuple, neighbours.nearest(twice, F.col("id") % 100 == 0).collect())) == [
        (0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 0, root), (0, 2, 0, root)]
