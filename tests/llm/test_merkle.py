"""Merkle manifest: trees, proofs and node records against a plain restatement, with trees that reach over many partitions."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kinetra.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fanout):
    """Levels of nodes from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, place, fanout):
    out = []
    for nodes in levels[:-1]:
        parent = place // fanout
        run = nodes[parent * fanout : (parent + 1) * fanout]
        out.append((run[: place % fanout], run[place % fanout + 1 :]))
        place = parent
    return out


def brute(rows, tampered, fanout):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    levels = {s: tree([leaf(r) for r in trees[s]], fanout) for s in order}
    top = tree([levels[s][-1][0] for s in order], fanout)
    out, nodes = [], []
    small = {k: k + 32 for k in range(65, 91)}
    for k, s in enumerate(order):
        nodes += [(s, level, p, d) for level, ds in enumerate(levels[s]) if level for p, d in enumerate(ds)]
        for place, r in enumerate(trees[s]):
            path = siblings(levels[s], place, fanout) + siblings(top, k, fanout)
            claim = leaf((*r[:4], r[4].translate(small) if r[4] is not None else None)) if tampered(r) else leaf(r)
            for left, right in path:
                claim = h(*left, claim, *right)
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], h(*[x for left, right in path for x in left + right]), claim, claim == top[-1][0]))
    nodes += [(None, -level, p, d) for level, ds in enumerate(top) if level for p, d in enumerate(ds)]
    return out, nodes, top[-1][0]


def same(got, want):
    k = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=k) == sorted(want, key=k)


def documents(n, sources, seed=2):
    rng = random.Random(seed)
    names = [None, "", "0", "1", "é", "z", "Z", "a b"] + [f"s{k}" for k in range(sources)]
    rows = [(i, rng.choice(names) if rng.random() < 0.6 else "hot", rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", f"Text {i}", f"text {i}", "É Ü %s" % ("x" * i)])) for i in range(n)]
    return rows + [(None, "hot", None, None, None), (None, "hot", None, None, None), (None, None, None, None, "A"), rows[5], rows[5], (rows[6][0], rows[6][1], "de", 1, "Other"), (-5, "lone", "en", 1, "L")]


@pytest.mark.parametrize(("n", "sources", "fanout", "leaves"), [(400, 5, 16, 1 << 17), (300, 3, 2, 11), (500, 120, 4, 7), (7, 0, 16, 4)])
def test_manifest(spark, monkeypatch, n, sources, fanout, leaves):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    rows = documents(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "part", "leaf", "claim", "place", "level", "digest", "tie", "place_by")}).repartition(5)
    made = merkle.Manifest(docs, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)), fanout=fanout)
    want, nodes, root = brute(rows, lambda r: r[0] is not None and r[0] % 3 == 0, fanout)
    same(made.proofs().collect(), want)
    same(made.nodes().collect(), nodes)
    assert [r["root"] for r in made.root().collect()] == [root]
    if leaves < 20:
        assert made.trees.runs is not None and made.trees.runs.count() > 0
    assert any(r[-1] for r in want)


def test_one_document_and_none(spark):
    row = (3, "s", "en", 2, "Ab")
    found = merkle.Manifest(spark.createDataFrame([row], SCHEMA)).proofs().collect()
    assert [tuple(r) for r in found] == [(3, leaf(row), leaf(row), leaf(row), h(""), leaf(row), True)]
    none = merkle.Manifest(spark.createDataFrame([], SCHEMA))
    assert none.proofs().collect() == [] and none.nodes().collect() == [] and none.root().collect() == []


def test_a_range_keeps_open_runs_only():
    done = []
    range_ = merkle.MountainRange(1000, 4, lambda *node: done.append(node))
    for k in range(37, 900):
        range_.push(k, str(k))
        assert all(len(run) < 4 for run in range_.open)
    assert (1, 10, merkle.digest(["40", "41", "42", "43"])) in done and not [d for d in done if d[:2] == (1, 9)]
    assert [p for p in range_.left() if p[0] == 0] == [(0, k, str(k)) for k in (37, 38, 39)]
