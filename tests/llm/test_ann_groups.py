"""Recall where vectors crowd: near copies of one vector, copies, and lists of many blocks."""

import numpy as np
import pytest

from aerolens.llm import ann


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_copies_are_told_apart(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
        monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    x[::3] = x[0] + 0.02 * rng.normal(size=(1000, 32))
    x[1::30] = x[1]
    x = x.astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann.search(frame, lambda c: c % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    assert out.groupby("query_id").size().eq(20).all() and not (out.query_id == out.vec_id).any()
    share = []
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        got = out[out.query_id == q]
        assert np.array_equal(s[got.vec_id], got.score) and list(got["rank"]) == list(range(1, 21))
        assert np.array_equal(np.lexsort((got.vec_id, -got.score)), np.arange(20))
        share.append(len(set(np.lexsort((np.arange(3000), -s))[:20]) & set(got.vec_id)) / 20)
    assert np.mean(share) >= 0.9


def test_groups_hold_every_list():
    sizes = np.array([0, 5, 40_000, 3, 16_384, 0, 2, 16_383])
    group, parts = ann.grouped(sizes)
    filled = np.bincount(group, weights=sizes, minlength=len(parts))
    assert (np.diff(group) >= 0).all() and (filled <= parts * ann.BLOCK_ROWS).all() and parts[group[2]] == 3
