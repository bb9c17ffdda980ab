"""Line dedup by runs: against a plain restatement, in one go and batch by batch."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinetra.llm import line_runs

BLANKS = " \t\n\x0b\x0c\r"
SMALL = {k: k + 32 for k in range(65, 91)}


def key(line):
    return line.strip(BLANKS).translate(SMALL)


def brute(rows, least=3, chars=20):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < chars or len(held[key(x)]) < least or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def documents(n=120, seed=3):
    rng = random.Random(seed)
    pool = [f"A common LINE number {k} of the pool" for k in range(30)] + ["ÀÉ İstanbul line that is long ENOUGH", "short", "", "　wide blanks are kept at the ends　", "exactly twenty chars"[:20], "exactly nineteen ch"]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", "  ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randint(0, 12))] + [f"a line of its own for {rng.random()}"]
        rng.shuffle(lines)
        rows.append((i * 3, "\n".join([rng.choice([x, x.upper()]) for x in lines]) + rng.choice(["", "\n"])))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, rows[4][1]), (None, rows[4][1]), (None, None), rows[7], (rows[8][0], rows[9][1])]
    return rows + [(2000, "\n".join(rng.choice(pool) for _ in range(50000)))]


def same(got, want):
    k = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=k) == sorted(want, key=k)


@pytest.mark.parametrize(("least", "chars", "batches"), [(3, 20, 5), (2, 1, 9), (3, 20, 1)])
def test_dedup(spark, least, chars, batches):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h1", "docs", "last", "at", "t", "dropped", "lines", "kept")})
    same(line_runs.dedup(docs.repartition(3), least, chars, batches).collect(), brute(rows, least, chars))
    assert line_runs.dedup(docs.limit(0)).count() == 0


def test_hot_keys_are_told_by_count(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "HOT_SHARE", 20)
    rows = documents()
    same(line_runs.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_batches_as_they_come(spark):
    """Older batches may come first; settled lines of later ones are left out of the new run; merges need no shuffle."""
    rows = [(i, t) for i, t in documents(60, 5) if i is not None and i < 150]
    runs = line_runs.LineRuns(3, 2)
    for a, b in ((0, 60), (90, 151), (60, 90)):
        runs.add(line_runs.line_keys(spark.createDataFrame([r for r in rows if a <= r[0] < b], "doc_id long, text string"), 20))
    assert [len(level) for level in runs.levels] == [1, 1]
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    late = sum(1 for ids in held.values() if len([i for i in ids if i >= 90]) >= 3)
    between = sum(1 for ids in held.values() if any(60 <= i < 90 for i in ids))
    assert late and runs.levels[0][0].count() < between
    with line_runs._planned_ahead(spark):
        assert "Exchange" not in line_runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    settled = sorted(r["last"] for r in runs.settled().collect())
    assert settled == sorted(max(ids) for ids in held.values() if len(ids) >= 3)
