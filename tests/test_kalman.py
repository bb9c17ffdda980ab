"""Filters of many tracks side by side against one track after another."""

from __future__ import annotations

import numpy as np
import pandas as pd

from kinetra.operators import kalman


def test_side_by_side():
    rng = np.random.default_rng(5)
    tracks = []
    for n in (1, 2, 3, 40, 7, 12, 11):
        f = np.cumsum(rng.integers(1, 5, n)) - 3
        corner = np.cumsum(rng.normal(0, 6, (n, 2)), axis=0) + 80 * (rng.random((n, 1)) < 0.1)
        tracks.append((f, np.hstack([corner, corner + rng.uniform(0.2, 40, (n, 2))])))
    for (f, b), got in zip(tracks, kalman.side_by_side(tracks), strict=True):
        rows = pd.DataFrame(b, columns=["x1", "y1", "x2", "y2"]).assign(frame_idx=f)
        assert np.array_equal(np.array([r[1:] for r in kalman.run_on(None, rows)[1]]), got)
    assert kalman.side_by_side([]) == []
