"""Complementary tracks in tiles, against the pairs one by one."""

import numpy as np

from kinetra.operators import pairs, tiles


def test_pairs_are_found_over_blocks_and_only_what_fits_leaves_a_task(spark, monkeypatch):
    monkeypatch.setattr(pairs, "WHOLE", 3)
    rng, rows = np.random.default_rng(0), []
    for t in range(20):
        for f in range(70):
            if rng.random() < (0.05 if t % 2 else 0.5) and (t % 4 == 0) <= (f < 40):
                rows.append((1, t, f, float(rng.integers(0, 40)), 0.0, 0.0, 100.0 if rng.random() < 0.95 else 0.0))
    rows = [(s, t, f, x, y, x + 30.0, b) for s, t, f, x, y, _, b in rows]
    expected, ids = {}, sorted({r[1] for r in rows})
    for a in ids:
        for b in ids:
            union = sorted((r for r in rows if r[1] in (a, b)), key=lambda r: r[2])
            met = [(p, q) for p, q in zip(union, union[1:]) if p[1] != q[1]]
            if a < b and met and len({r[2] for r in union}) == len(union) and all(p[6] > 0 and q[6] > 0 and abs(p[3] - q[3]) <= 30 for p, q in met):
                expected[a, b] = (len(met), max(abs(p[3] - q[3]) for p, q in met))
    assert any(n > 1 for n, _ in expected.values()) and any(n == 1 for n, _ in expected.values())
    obs = spark.createDataFrame(rows, "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    called, real = [], tiles.within
    monkeypatch.setattr(tiles, "within", lambda *args: called.append(args[3]) or real(*args))
    got = pairs.complementary(obs, near=0.3, speed=0.25).collect()
    assert called == [3] and {(r.a, r.b): (r.boundaries, r.farthest) for r in got} == expected and len(got) == len(expected)
