"""What hides a box by its neighbours against the same by all boxes of a frame."""

from __future__ import annotations

import numpy as np
import pytest

from kinetra.operators import review


@pytest.mark.parametrize("most", [0.0, 0.5, 0.85])
def test_covered_by_neighbours(most):
    rng = np.random.default_rng(8)
    for wide in (2.0, 12.0, 40.0):
        corner = np.round(rng.random((120, 2)) * 40)
        boxes = np.hstack([corner, corner + np.round(rng.random((120, 2)) * wide)])
        ids = np.arange(120) // 2 * 2
        want = np.full(120, np.nan)
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                share = both / max((a[2] - a[0]) * (a[3] - a[1]), 1e-6)
                if ids[i] != ids[j] and b[3] > a[3] and share > most:
                    want[i] = np.fmax(want[i], share)
        assert np.array_equal(review._covered(boxes, ids, most), want, equal_nan=True)
        assert np.isfinite(want).any()


def test_no_pair_of_a_frame_is_joined(spark):
    box = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 9.0, 9.0), (0, 2, 0, 0.0, 0.0, 9.0, 9.5), (0, 3, 1, 0.0, 0.0, 9.0, 9.5)], "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    made = review.visibility(box)
    assert sorted(tuple(r) for r in made.collect()) == [(0, 1, 0, 0.0, True), (0, 2, 0, 1.0, False), (0, 3, 1, 1.0, False)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
