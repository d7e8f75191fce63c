"""Neighbours where the sample is thin for the number of lists, so that queries lie on centroids."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from silvane.llm import ann


def test_queries_on_centroids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 2)
    monkeypatch.setattr(ann, "SAMPLE", 1200)
    rng = np.random.default_rng(8)
    points = rng.standard_normal((2400, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 2400, 20):
        near = points @ points[q]
        near[q] = -np.inf
        assert len(got[q]) == 20
        hits += len(got[q] & set(np.argsort(-near)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_reads_on_past_small_lists():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((900, 4))
    graph = ann.CentroidGraph(centers)
    held = np.ones(900, np.int64)
    held[::2] = 0
    row, lists = ann.reach(graph, held, centers[:5], 300)
    for i in range(5):
        mine = lists[row == i]
        assert len(set(mine.tolist())) == len(mine) and held[mine].sum() == 300
    row, lists = ann.reach(graph, held, centers[:5], 10_000)
    assert all(held[lists[row == i]].sum() == held.sum() for i in range(5))
    row, lists = ann.reach(graph, np.full(900, 10_000), centers[:5], 300)
    assert min(np.bincount(row)) >= ann.LEAST


def test_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(21)
    points = rng.integers(-1, 2, (1500, 16)).astype(float)
    points[7] = points[11] = points[400]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.flatnonzero(points.any(1))
    for q in range(0, 1500, 20):
        near = points[whole] @ points[q]
        order = [i for i in np.lexsort((whole, -near)) if whole[i] != q][:20]
        assert got[q] == [(whole[i], near[i]) for i in order]
