"""Choices in rounds against the same choices made one after another."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import choice, evaluate, links, masks, merging, pose, tiles


def graphs(seed):
    rng = random.Random(seed)
    return [(g, a, b) for g in range(6) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.1 + 0.1 * g]


def test_suppression_is_that_of_one_after_another(spark):
    edges = graphs(1)
    got = {(r["g"], r["node"]) for r in choice.suppressed(spark.createDataFrame(edges, "g long, first long, then long"), ["g"]).collect()}
    want = set()
    for g, a, b in sorted(edges):
        if (g, a) not in want:
            want.add((g, b))
    assert got == want
    assert choice.suppressed(spark.createDataFrame([], "g long, first long, then long"), ["g"]).count() == 0


def test_duplicates_take_turns(spark):
    rng = random.Random(2)
    edges = [(0, g, a, b, rng.choice([a, b])) for g, a, b in graphs(3)]
    got = {(r["frame_idx"], r["track_id"]) for r in pose.suppressed_duplicates(spark.createDataFrame(edges, "seq_id long, frame_idx long, a long, b long, loser long")).collect()}
    want = set()
    for (g, a), mine in itertools.groupby(sorted(edges, key=lambda e: e[1:4]), key=lambda e: (e[1], e[2])):
        if (g, a) not in want:
            for e in mine:
                if (g, e[3]) not in want:
                    want.add((g, e[4]))
    assert got == want


def test_accepted_in_order_and_by_cost(spark):
    rng = random.Random(4)
    rows = [(g, a, b, rng.randint(1, 6) / 2) for g in range(5) for a in range(8) for b in range(7) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "g long, a long, b long, cost double")
    first, cheapest = set(), set()
    for g in range(5):
        for order, out in ((sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[3], r[2])), first), (sorted([r for r in rows if r[0] == g], key=lambda r: (r[3], r[1], r[2])), cheapest)):
            used = set()
            for _, a, b, _ in order:
                if ("a", a) not in used and ("b", b) not in used:
                    used |= {("a", a), ("b", b)}
                    out.add((g, a, b))
    assert {tuple(r) for r in choice.accepted(df, ["g"], ["cost"], []).collect()} == first
    # By one cost in one total order: the cheapest link left is taken, again and again.
    total = [F.col("cost"), F.col("a"), F.col("b")]
    assert {tuple(r) for r in choice.accepted(df, ["g"], total, total).collect()} == cheapest


@pytest.mark.parametrize("seed", range(3))
def test_assignment_is_the_cheapest_of_the_largest(spark, seed):
    rng = random.Random(seed)
    rows = [(s, a, b + (0 if s else 100), round(rng.random(), 3)) for s in range(3) for a in range(5) for b in range(5) if rng.random() < 0.35]
    got = links.assigned(spark.createDataFrame(rows, "seq_id long, a long, b long, cost double"), 0.8).collect()
    for s in range(3):
        mine = {(r[1], r[2]): r[3] for r in rows if r[0] == s and r[3] < 0.8}
        best = (0, 0.0)
        for k in range(1, 6):
            for chosen in itertools.combinations(mine, k):
                if len({a for a, _ in chosen}) == len({b for _, b in chosen}) == k:
                    best = max(best, (k, -sum(mine[c] for c in chosen)))
        pairs = [r for r in got if r["seq_id"] == s]
        assert len({r["a"] for r in pairs}) == len({r["b"] for r in pairs}) == len(pairs)
        assert (len(pairs), pytest.approx(-sum(r["cost"] for r in pairs))) == best


def test_the_sum_alone_may_count(spark):
    """One link worth 10 beats two worth 1 each."""
    rows = [(0, 1, 11, -10.0), (0, 1, 12, -1.0), (0, 2, 11, -1.0)]
    got = links.assigned(spark.createDataFrame(rows, "seq_id long, a long, b long, cost double"), 0.0, 0.0).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 11)]


def test_chains_take_the_first_name(spark):
    obs = spark.createDataFrame([(0, t, f, 0.0) for t, f in ((7, 0), (7, 1), (3, 2), (3, 3), (5, 3), (5, 4), (9, 0))], "seq_id long, track_id long, frame_idx long, x1 double")
    chain = spark.createDataFrame([(0, 3, 5), (0, 7, 3)], "seq_id long, a long, b long")
    assert sorted((r["track_id"], r["frame_idx"]) for r in links.linked_tracks(obs, chain).collect()) == [(7, 0), (7, 1), (7, 2), (7, 3), (7, 4), (9, 0)]


BOXES = "seq_id long, track_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double"


def test_the_earlier_match_beats_the_larger_overlap(spark):
    """In frame 0 track 11 is alone on the box; in frame 1 track 12 overlaps it more, in frame 3 after a gap it wins."""
    at = lambda t, f, x: (0, t, f, float(x), 0.0, x + 100.0, 100.0)
    reference = spark.createDataFrame([at(1, f, 0) for f in (0, 1, 3)], BOXES)
    found = spark.createDataFrame([at(11, 0, 20), at(11, 1, 20), at(12, 1, 5), at(11, 3, 20), at(12, 3, 5)], BOXES)
    got = sorted((r["frame_idx"], r["ref_id"], r["found_id"]) for r in evaluate.carried_matches(reference, found).collect())
    assert got == [(0, 1, 11), (1, 1, 11), (3, 1, 12)]
    r = evaluate.clear(reference, found, evaluate.carried_matches(reference, found)).first()
    assert (r["tp"], r["fp"], r["fn"], r["id_switches"], r["fragments"]) == (3, 2, 0, 1, 1)


def test_matches_are_carried_like_frame_by_frame(spark):
    rng = random.Random(9)
    boxes = {name: [(s, t + shift, f, x, 0.0, x + 60.0, 50.0) for s in (0, 1) for f in range(25) for t in range(4) if rng.random() < 0.85 for x in [15.0 * t + rng.uniform(-12, 12)]] for name, shift in (("ref", 0), ("found", 10))}
    got = {}
    for r in evaluate.carried_matches(*(spark.createDataFrame(boxes[k], BOXES).repartition(3) for k in ("ref", "found")), 0.4).collect():
        got.setdefault((r["seq_id"], r["frame_idx"]), set()).add((r["ref_id"], r["found_id"]))

    def iou(a, b):
        both = max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * 50
        return both / (6000 - both)

    for s in (0, 1):
        last = set()
        for f in range(25):
            refs, founds = ([b for b in boxes[k] if (b[0], b[2]) == (s, f)] for k in ("ref", "found"))
            fit = {(a[1], b[1]): iou(a, b) for a in refs for b in founds if iou(a, b) >= 0.4}
            best, chosen = -1.0, set()
            for k in range(len(fit) + 1 if len(fit) < 5 else 5):
                for some in itertools.combinations(fit, k):
                    if len({a for a, _ in some}) == len({b for _, b in some}) == k:
                        worth = sum(fit[p] + 1000 * (p in last) for p in some)
                        if worth > best:
                            best, chosen = worth, set(some)
            assert got.get((s, f), set()) == chosen
            last = chosen


@pytest.mark.parametrize("seed", range(3))
def test_merging_apart_is_that_of_link_after_link(spark, seed):
    rng = random.Random(seed)
    nodes = [(s, n) for s in (0, 1) for n in range(12)]
    links_ = [(s, a, b, rng.randint(1, 9) / 4) for s in (0, 1) for a, b in itertools.permutations(range(12), 2) if rng.random() < 0.25]
    apart = [(s, a, b) for s in (0, 1) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.12]
    want = {n: n for n in nodes}
    walls = {(s, *p) for s, a, b in apart for p in ((a, b), (b, a))}
    for s, a, b, _ in sorted(links_, key=lambda e: (-e[3], e[1], e[2])):
        x, y = want[s, a], want[s, b]
        one, two = ([n for n in nodes if want[n] == g] for g in (x, y))
        if x != y and not any((s, p[1], q[1]) in walls for p in one for q in two):
            for n in one + two:
                want[n] = min(x, y)
    got = merging.merged_apart(spark.createDataFrame(nodes, "seq_id long, node long"), spark.createDataFrame(links_, "seq_id long, a long, b long, weight double"), spark.createDataFrame(apart, "seq_id long, a long, b long"))
    assert {(r["seq_id"], r["node"]): (r["seq_id"], r["root"]) for r in got.collect()} == want


def test_layers_with_a_circle(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 3, 4), (0, 1, 4), (1, 5, 6), (1, 5, 7), (1, 6, 7)], "seq_id long, a long, b long")
    nodes = spark.createDataFrame([(0, n) for n in (1, 2, 3, 4)] + [(1, n) for n in (5, 6, 7, 8)], "seq_id long, node long")
    got = {(r["seq_id"], r["node"]): r["layer"] for r in merging.layers(edges, nodes).collect()}
    # 1 and 3 win one more than they lose: the smaller one opens the circle.
    assert got == {(0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 3, (1, 5): 0, (1, 6): 1, (1, 7): 2, (1, 8): 0}


def test_masks_by_pixels(spark):
    rng = random.Random(5)
    runs = [(0, f, t, y, x, x + rng.randint(0, 6)) for f in (0, 1) for t in range(4) for y in range(6) for x in [rng.randint(0, 10) for _ in range(3)]]
    df = masks.tidy(spark.createDataFrame(runs, "seq_id long, frame_idx long, track_id long, y long, x0 long, x1 long"))
    pixels = {}
    for _, f, t, y, a, b in runs:
        pixels.setdefault((f, t), set()).update((y, x) for x in range(a, b))
    for r in masks.boxes(df, 2).collect():
        p = pixels[r["frame_idx"], r["track_id"]]
        ys, xs = [y for y, _ in p], [x for _, x in p]
        assert (r["x1"], r["y1"], r["x2"], r["y2"], r["area"]) == (max(0, min(xs) - 2), max(0, min(ys) - 2), max(xs) + 3, max(ys) + 3, len(p))
    got = {(r["frame_idx"], r["a"], r["b"]): (r["shared"], r["iou"], r["a_in_b"]) for r in masks.overlaps(df).collect()}
    for f in (0, 1):
        for a, b in itertools.combinations(range(4), 2):
            p, q = pixels[f, a], pixels[f, b]
            assert got.get((f, a, b), (0, 0, 0)) == pytest.approx((len(p & q), len(p & q) / len(p | q), len(p & q) / len(p)))
    larger = {}
    for r in masks.resized(df, F.lit(1.5), F.lit(2.0)).collect():
        larger.setdefault((r["frame_idx"], r["track_id"]), set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    assert larger == {k: {(y, x) for y in range(12) for x in range(30) if (y // 2, int(x / 1.5)) in p} for k, p in pixels.items()}


@pytest.mark.parametrize("cell", [1, 3, 8])
def test_boxes_by_cells(monkeypatch, cell):
    """The box that is overlapped most, looked for by cells, against all boxes; of equals the first. Most boxes are never looked at."""
    monkeypatch.setattr(links, "CELL", cell)
    rng, looked = np.random.default_rng(3), []
    whole = tiles.iou
    for size, least in ((0, 0.3), (6, 0.0), (40, 0.1), (40, 0.3)):
        corners = rng.integers(0, 40, (400, 2)) / 2.0
        boxes = np.concatenate([corners, corners + rng.integers(0, 4, (400, 2)) * size / 4.0], axis=1)
        cells, taken = links.Cells(boxes[:200]), np.zeros(200, bool)
        for box in boxes[200:] - rng.integers(0, 2, (200, 1)) * 3.25:
            over = np.nan_to_num(whole(box, boxes[:200]), nan=-1.0)
            over[taken] = -1.0
            best = int(over.argmax())
            monkeypatch.setattr(tiles, "iou", lambda a, b: looked.append(len(b)) or whole(a, b))
            got = cells.best(box, least)
            monkeypatch.setattr(tiles, "iou", whole)
            assert got == ((best, over[best]) if over[best] >= least else (-1, got[1]))
            if over[best] >= least:
                cells.taken[best] = taken[best] = True
    assert sum(looked) < 4 * 200 * 200
