"""Neighbours of dense vectors over several blocks and slabs."""

from __future__ import annotations

import re

import numpy as np

from wayfield.plans import registry, stars

from .oracle import TESTDATA, difference


def test_neighbours_over_small_blocks_and_slabs(spark, monkeypatch):
    monkeypatch.setattr(stars, "BLOCK", 70)
    monkeypatch.setattr(stars, "CELLS", 300)
    for name in ("sim4_vector_knn", "joi1_vector_mutual_knn"):
        assert difference(spark, registry.QUERIES[name], registry.SQL[name], f"{TESTDATA}/sf0.001") == ""


def test_ties_and_a_vector_without_length(spark, tmp_path):
    """Twelve equal vectors, whose neighbours are those of least number, and one of zeros, which is near to nothing."""
    rows = [(k, [1.0, 0.0]) for k in range(12)] + [(12, [0.0, 0.0]), (13, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in stars.vector_neighbours(spark, str(tmp_path), 3).collect():
        got.setdefault(r.i, []).append((r["rank"], r.j, r.d))
    assert {i: [j for _, j, _ in sorted(v)] for i, v in got.items()} == {**{k: [j for j in range(4) if j != k][:3] for k in range(12)}, 13: [0, 1, 2]}


def test_blocks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """The greatest block of 400 vectors has no more than twice BLOCK, where one of sixteen blocks had 25."""
    x = np.random.default_rng(0).normal(size=(400, 4))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(stars, "BLOCK", 10)
    found = stars.vector_neighbours(spark, str(tmp_path), 2)
    assert re.search(r"pmod\(vec_id#\d+L?, [^)]*40", found._jdf.queryExecution().analyzed().toString())
    assert found.count() == 800
