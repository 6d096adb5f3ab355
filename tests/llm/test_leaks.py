"""Recall of the walks and samples of benchmark decontamination, by themselves."""

import numpy as np
import pytest

from angula.llm import decontaminate as D


@pytest.mark.parametrize("kind", [None, "insert", "delete", "replace"])
@pytest.mark.parametrize("m", [1, 3, 5, 9, 11, 16, 20, 23, 40, 64, 100])
def test_walks_reach_the_target(m, kind):
    """On other copies than those that set the number of walks, of sizes on and off the grid."""
    walks = D.walks_of([m], D.SIMILARITY)[m]
    first = D.first_walks(m, D.SIMILARITY, 300, D.MAX_WALKS, kind, seed=11)
    assert walks > 0 and (first < walks).mean() >= D.TARGET - 0.01


def test_more_recall_takes_more_walks():
    few, many = D.walks_of([60], D.SIMILARITY, 0.5)[60], D.walks_of([60], D.SIMILARITY, 0.995)[60]
    assert 0 < few < many
    first = D.first_walks(60, D.SIMILARITY, 300, D.MAX_WALKS, seed=3)
    assert (first < few).mean() >= 0.5 and (first < 1).mean() < 1


def test_items_beyond_the_walks_go_by_words_in_common(monkeypatch):
    """Where the walks fall short, nothing is lost."""
    monkeypatch.setattr(D, "MAX_WALKS", 1)
    D._walks.cache_clear()
    try:
        rng = np.random.default_rng(2)
        each = [rng.integers(1, 1 << 63, 40).astype(np.uint64) for _ in range(40)]
        items = D.Items(np.arange(40), np.cumsum([40] * 40), np.concatenate(each), D.SIMILARITY)
        assert (items.walks == 0).all()
        for i, x in enumerate(each):
            around = rng.integers(1, 1 << 63, (2, 60)).astype(np.uint64)
            h = np.concatenate([around[0], D.edited(rng, x, 8), around[1]])
            assert [j for _, j, _, _ in items.matches(h, np.zeros(len(h), np.int64))] == [i]
    finally:
        D._walks.cache_clear()


def test_what_no_walk_finds_is_not_reported(monkeypatch):
    """The samples decide: without any, nothing is found."""
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1 << 63, 40).astype(np.uint64)
    items = D.Items(np.arange(1), np.array([40]), x, D.SIMILARITY)
    monkeypatch.setattr(items, "walked", items.walked[:0])
    h = D.edited(rng, x, 5)
    assert list(items.matches(h, np.zeros(len(h), np.int64))) == []
