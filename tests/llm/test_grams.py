"""Sums of grams by merging sorted runs."""

import numpy as np

from kinetra.llm import ctw


def test_sorted_runs_are_merged_with_the_sums_of_their_counts():
    rng = np.random.default_rng(0)
    parts = [np.sort(rng.integers(0, 50, n)) for n in (30, 0, 70)]
    keys, counts = np.concatenate(parts), np.arange(100.0)
    for runs in (True, False):
        distinct, n, twice = ctw._summed(keys, counts, 2 * counts, runs=runs)
        assert distinct.tolist() == np.unique(keys).tolist()
        assert n.tolist() == [counts[keys == k].sum() for k in distinct] and (twice == 2 * n).all()
    empty, n = ctw._summed(np.zeros(0, np.int64), np.zeros(0), runs=True)
    assert len(empty) == len(n) == 0
