"""Blocks of few vectors: the ascent ends at the root, and all are candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann


def unit(n, dim=64, seed=5):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [2, 10, 21])
def test_every_vector_of_a_small_block_is_a_candidate(n):
    v = unit(n)
    for k, found, scores in ann.search(v, v, 21):
        assert found.tolist() == list(range(n)) and np.allclose(scores, v @ v[k])


@pytest.mark.parametrize("n", [700, 2500])
def test_a_block_of_some_hundreds(n):
    v, hit = unit(n), 0
    for k, found, _ in ann.search(v, v[:100], 21):
        hit += len(set(np.argsort(-(v @ v[k]))[:21].tolist()) & set(found.tolist()))
    assert hit >= 0.98 * 100 * 21


def test_neighbours_of_few_unit_vectors(spark):
    rows = [(i, v.tolist()) for n, dim, start in ((2, 64, 0), (10, 32, 100), (21, 48, 200)) for i, v in enumerate(unit(n, dim), start)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, F.lit(True), block=15, group=7).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i, v in rows:
        others = [(-ann.exact_score(np.array(v), np.array(w)), j) for j, w in rows if j != i and len(w) == len(v)]
        assert got[i] == [j for _, j in sorted(others)[:20]]
