"""Closure of tournaments."""

from __future__ import annotations

from kinetra.operators import study


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("z", None)]
    got = {(r["w"], r["l"]) for r in study.closure(spark.createDataFrame(chain + cycle, "w string, l string")).collect()}
    want = {(f"c{i}", f"c{j}") for i in range(41) for j in range(i + 1, 41)}
    assert got == want | {(a, b) for a in "xyz" for b in [*"xyz", None]}


def test_one_task_orders_a_group(spark):
    """Thirty names in a circle and a line of thirty: a round of jobs for each name would be sixty."""
    edges = spark.range(30).selectExpr("id as w", "(id + 1) % 30 as l").union(spark.range(29).selectExpr("id + 100 as w", "id + 101 as l"))
    pool = spark.range(30).selectExpr("0L as grp", "id as name").union(spark.range(30).selectExpr("1L as grp", "id + 100 as name"))
    sc = spark.sparkContext
    sc.setJobGroup("peeling", "")
    found = {(r.grp, r.place): (r.name, r.forced) for r in study.peel(edges, pool).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("peeling"))
    sc.setJobGroup("others", "")
    assert found == {(0, k): (k, k == 0) for k in range(30)} | {(1, k): (k + 100, False) for k in range(30)} and jobs < 20
