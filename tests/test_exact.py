"""The exact log of maintained views against recomputation after every update, whatever the batches."""

from __future__ import annotations

import random

import pytest

from deltaloom.operators import lifetimes as lt
from deltaloom.plans.model import query, read_names, read_queries
from deltaloom.streaming.microbatch import View, Views
from tests.test_deltas import QUERIES, as_changes, expected, random_log

BOUNDS = [(0, 40), (0, 7, 8, 9, 30, 40)]


@pytest.mark.parametrize("case", range(3))
def test_every_update_in_any_batches(spark, tmp_path, case):
    log = random_log(random.Random(20 + case), 40)
    bounds = BOUNDS[case % 2]
    view = View(spark, QUERIES[case], str(tmp_path / "view"), fold=2, exact=True)
    for batch, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        view.apply(as_changes(spark, log[lo:hi]), batch)
        if batch == 1:
            view.apply(as_changes(spark, log[lo:hi]), batch)
    found = {(r.op, r.seq, *(int(r[c]) for c in QUERIES[case].out)) for r in view.exact_log().collect()}
    assert found == expected(log, QUERIES[case])


def test_shared_nodes_and_violations(spark, tmp_path):
    """A node's own exact log feeds those that use it; changes that a set can't take are left out; changes of a node are refused."""
    log = random_log(random.Random(31), 40)
    node, use = query("N", "R(x,y) S(y,z)", "x,z"), query("use", "N(x,z) R(z,w)", "x,w")
    views = Views(spark, [node, use], str(tmp_path / "views"), exact=True)
    noisy = [(*log[0][:3], "+", 1), *log, (*log[-1][:3], log[-1][3], 41), ("N", 1, 1, "+", 42), ("Other", 1, 1, "-", 43)]
    for batch in range(3):
        views.apply_all(as_changes(spark, noisy[15 * batch : 15 * batch + 15]), batch)
    assert {(r.op, r.seq, int(r.x), int(r.w)) for r in views.exact_log(1).collect()} == expected(log, QUERIES[0])
    assert sorted((r.rel, r.seq, r.violation) for r in views.refused().collect()) == [("N", 42, "derived_relation"), ("Other", 43, "unknown_relation")]


def test_merging_over_slices_of_time(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k % 3, s, None if rng.random() < 0.02 else s + rng.randint(1, 9)) for k in range(300) for s in [rng.randrange(400)]]
    want = set()
    for y in range(3):
        covered = sorted((s, float("inf") if e is None else e) for k, s, e in rows if k == y)
        start, end = covered[0]
        for s, e in covered[1:]:
            if s > end:
                want.add((y, start, end))
                start, end = s, e
            end = max(end, e)
        want.add((y, start, end))
    frame = spark.createDataFrame(rows, "y int, _start bigint, _end bigint")
    frame = lt.longest(frame, query("q", "R(y)", "y"))
    for slices in ((2, 5), (16, 32), ()):
        monkeypatch.setattr(lt, "SLICES", slices)
        assert {(r.y, r._start, float("inf") if r._end is None else r._end) for r in lt.merged(frame).collect()} == want


def test_names_of_relations():
    names = read_names("0 knows\n7 person\t3 tag")
    assert names == {0: "knows", 7: "person", 3: "tag"}
    assert [a.relation for a in read_queries("1 2 1 0 2 5 6 2 7 2 6 8 2 5 8", names)[0].atoms] == ["knows", "person"]
    with pytest.raises(ValueError):
        read_names("1 a 2")
