"""Delta logs against recomputation after every update, and the maintained stream against both."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import lifetimes as lt
from deltaloom.plans.model import query
from deltaloom.streaming.microbatch import View, Views
from tests.test_joins import brute

QUERIES = [query("path", "R(x,y) S(y,z) R(z,w)", "x,w"), query("star", "R(a,b) S(a,c)", "b"), query("self", "R(a,b) R(b,c)", "a,c")]


def random_log(rng: random.Random, n: int) -> list[tuple]:
    """(rel, x, y, op, seq): each tuple's inserts and deletes alternate."""
    live: set[tuple] = set()
    log = []
    for seq in range(1, n + 1):
        t = (rng.choice("RS"), rng.randrange(4), rng.randrange(4))
        log.append((*t, "-" if t in live else "+", seq))
        live ^= {t}
    return log


def expected(log: list[tuple], q) -> set[tuple]:
    state: dict[str, set[tuple]] = {"R": set(), "S": set()}
    before, out = set(), set()
    for rel, x, y, op, seq in log:
        (state[rel].add if op == "+" else state[rel].discard)((x, y))
        after = brute(state, q)
        out |= {("+", seq, *r) for r in after - before} | {("-", seq, *r) for r in before - after}
        before = after
    return out


@pytest.mark.parametrize("seed", range(3))
def test_every_update(spark, seed):
    log = random_log(random.Random(seed), 90)
    frame = spark.createDataFrame(log, "rel string, x int, y int, op string, seq bigint")
    logs = lambda name: frame.where(frame.rel == name).drop("rel")
    for q in QUERIES:
        deltas = lt.delta_log(logs, q)
        assert {tuple(r) for r in deltas.collect()} == expected(log, q)
        state: dict[str, set[tuple]] = {"R": set(), "S": set()}
        for rel, x, y, op, seq in log:
            if seq <= 50:
                (state[rel].add if op == "+" else state[rel].discard)((x, y))
        want = brute(state, q)
        assert {tuple(r) for r in lt.state_at(logs, q, 50).collect()} == want == {tuple(r) for r in lt.replayed(deltas, 50).collect()}


def test_touching_lives_merge(spark):
    frame = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 14), (2, 1, 8), (2, 2, 3)], "y int, _start bigint, _end bigint")
    assert sorted(map(tuple, lt.merged(frame).select("y", "_start", "_end").collect())) == [(1, 0, 9), (1, 12, 14), (2, 1, 8)]


def test_violations(spark):
    frame = spark.createDataFrame([(1, "+", 1), (1, "+", 2), (2, "-", 1), (3, "+", 1), (3, "-", 2)], "x int, op string, seq bigint")
    assert sorted((r.x, r.seq, r.violation) for r in lt.violations(frame).collect()) == [(1, 2, "duplicate_insert"), (2, 1, "missing_delete")]


def test_formatted(spark):
    frame = spark.createDataFrame([("+", 4, 1, None)], "op string, seq bigint, a int, b string")
    assert [r.line for r in lt.formatted(frame, 7).collect()] == ["+ 7 1, null"]


def test_empty_log(spark):
    empty = spark.createDataFrame([], "x int, y int, op string, seq bigint")
    assert lt.delta_log(lambda name: empty, QUERIES[0]).isEmpty()


def test_micro_batches(spark, tmp_path):
    log = random_log(random.Random(9), 60)
    q = QUERIES[0]
    view = View(spark, q, str(tmp_path / "view"))
    state: dict[str, set[tuple]] = {"R": set(), "S": set()}
    before: set[tuple] = set()
    for batch in range(3):
        part = log[batch * 20 : batch * 20 + 20]
        frame = spark.createDataFrame([(r, [str(x), str(y)], op, seq) for r, x, y, op, seq in part], "rel string, cells array<string>, op string, seq bigint")
        out = view.apply(frame, batch)
        if batch == 1:  # a batch that runs again changes nothing
            out = view.apply(frame, batch)
        for rel, x, y, op, _ in part:
            (state[rel].add if op == "+" else state[rel].discard)((x, y))
        after = brute(state, q)
        got = {(r.op, int(r.x), int(r.w)) for r in out.collect()}
        assert got == {("+", *t) for t in after - before} | {("-", *t) for t in before - after}
        before = after
    assert {(int(r.x), int(r.w)) for r in view.results().collect()} == before


LATE = 1 << 34


def test_seqs_of_any_size(spark):
    frame = spark.createDataFrame([(1, "+", 5), (1, "-", LATE + 1), (1, "+", LATE + 5), (2, "+", LATE + 5), (2, "-", LATE + 9)], "x int, op string, seq bigint")
    q = query("one", "R(x)", "x")
    assert sorted(map(tuple, lt.delta_log(lambda name: frame, q).collect())) == [("+", 5, 1), ("+", LATE + 5, 1), ("+", LATE + 5, 2), ("-", LATE + 1, 1), ("-", LATE + 9, 2)]
    assert sorted(r.x for r in lt.state_at(lambda name: frame, q, LATE + 7).collect()) == [1, 2]


def test_endless_lives_merge(spark):
    frame = spark.createDataFrame([(1, 0, None), (1, 5, 9), (1, 12, None), (2, 1, 8), (2, 3, None)], "y int, _start bigint, _end bigint")
    assert sorted(map(tuple, lt.merged(frame).select("y", "_start", "_end").collect())) == [(1, 0, None), (2, 1, None)]


LOOP = query("loop", "R(a,a) S(a,b)", "a,b")


def loop(state: dict[str, set[tuple]]) -> set[tuple]:
    return {(a, b) for a, x in state["R"] if a == x for c, b in state["S"] if c == a}


def as_changes(spark, part):
    return spark.createDataFrame([(r, [str(x), str(y)], op, seq) for r, x, y, op, seq in part], "rel string, cells array<string>, op string, seq bigint")


def test_repeated_attribute(spark, tmp_path):
    log = random_log(random.Random(4), 60)
    frame = spark.createDataFrame(log, "rel string, x int, y int, op string, seq bigint")
    state: dict[str, set[tuple]] = {"R": set(), "S": set()}
    before, want = set(), set()
    for rel, x, y, op, seq in log:
        (state[rel].add if op == "+" else state[rel].discard)((x, y))
        after = loop(state)
        want |= {("+", seq, *r) for r in after - before} | {("-", seq, *r) for r in before - after}
        before = after
    assert {tuple(r) for r in lt.delta_log(lambda name: frame.where(F.col("rel") == name).drop("rel"), LOOP).collect()} == want
    view = View(spark, LOOP, str(tmp_path / "view"))
    for batch in range(2):
        view.apply(as_changes(spark, log[batch * 30 : batch * 30 + 30]), batch)
    assert {(int(r.a), int(r.b)) for r in view.results().collect()} == before


def test_views_hold_sets(spark, tmp_path):
    view = View(spark, query("one", "R(x,y)", "x"), str(tmp_path / "view"))
    view.apply(as_changes(spark, [("R", 1, 1, "+", 1), ("R", 1, 1, "+", 2), ("R", 2, 2, "-", 3)]), 0)
    out = view.apply(as_changes(spark, [("R", 1, 1, "+", 4), ("R", 1, 1, "-", 5), ("R", 3, 3, "+", 6), ("R", 9, 9, "-", 7), ("Other", 1, 1, "+", 8)]), 1)
    assert sorted((r.op, r.x) for r in out.collect()) == [("+", "3"), ("-", "1")]
    assert [r.x for r in view.results().collect()] == ["3"]
    assert sorted((r.batch, r.seq, r.violation) for r in view.violations().collect()) == [(0, 2, "duplicate_insert"), (0, 3, "missing_delete"), (1, 4, "duplicate_insert"), (1, 7, "missing_delete")]


def test_shared_nodes_and_folds(spark, tmp_path):
    """Queries over a shared node, with the state folded every second batch, against recomputation."""
    node, path, ends = query("N", "R(x,y) S(y,z)", "x,z"), query("path", "N(x,z) R(z,w)", "x,w"), query("ends", "N(a,b)", "b")
    whole = [query("N", "R(x,y) S(y,z)", "x,z"), QUERIES[0], query("ends", "R(x,y) S(y,z)", "z")]
    views = Views(spark, [node, path, ends], str(tmp_path / "views"), fold=2)
    log = random_log(random.Random(7), 60)
    state: dict[str, set[tuple]] = {"R": set(), "S": set()}
    before: list[set] = [set()] * 3
    for batch in range(6):
        part = log[batch * 10 : batch * 10 + 10]
        out = views.apply_all(as_changes(spark, part), batch)
        if batch in (3, 4):
            out = views.apply_all(as_changes(spark, part), batch)
        for rel, x, y, op, _ in part:
            (state[rel].add if op == "+" else state[rel].discard)((x, y))
        after = [brute(state, q) for q in whole]
        for k in range(3):
            assert {(r[0], *map(int, r[1:])) for r in out[k].collect()} == {("+", *t) for t in after[k] - before[k]} | {("-", *t) for t in before[k] - after[k]}, (batch, k)
        before = after
    for k in range(3):
        assert {tuple(map(int, r)) for r in views.results(k).collect()} == before[k]


def test_what_nobody_asks_for_is_not_joined(spark):
    """300 tuples of R under the key of 300 of S: one merged life of R's meets each of S's, not 300."""
    rows = [("S", k, 7, "+", k) for k in range(300)] + [("R", k, 7, "+", 300 + k) for k in range(300)] + [("R", k, 7, "-", 1000 + k) for k in range(300)]
    frame = spark.createDataFrame(rows, "rel string, x int, y int, op string, seq bigint")
    logs = lambda name: frame.where(frame.rel == name).drop("rel")
    q = query("n", "R(a,b) S(c,b)", "b,c")
    assert lt.joined_lives(logs, q).count() == 300
    assert {tuple(r) for r in lt.delta_log(logs, q).collect()} == {(op, seq, 7, c) for c in range(300) for op, seq in (("+", 300), ("-", 1299))}


@pytest.mark.parametrize("limit", [0, 1000])
def test_crowded_results_merge_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(lt, "CROWDED", limit)
    log = random_log(random.Random(21), 90)
    frame = spark.createDataFrame(log, "rel string, x int, y int, op string, seq bigint")
    logs = lambda name: frame.where(frame.rel == name).drop("rel")
    for q in QUERIES:
        assert lt.crowded(logs, q) == (limit == 0)
        assert {tuple(r) for r in lt.delta_log(logs, q).collect()} == expected(log, q)


@pytest.mark.parametrize("few", [0, 100_000])
def test_views_over_few_and_many_rows(spark, tmp_path, monkeypatch, few):
    """The exact log and the results, whether a batch's rows are sent to the state or brought together with it."""
    from deltaloom.streaming import microbatch

    monkeypatch.setattr(microbatch, "FEW", few)
    monkeypatch.setattr(microbatch, "CROWDED", 2)
    log = random_log(random.Random(31), 60)
    again = [("R", 1, 1, "+", seq) for seq in (61, 62)] + [("R", 1, 1, "-", 63)]
    view = View(spark, QUERIES[0], str(tmp_path / "view"), exact=True)
    for batch in range(3):
        view.apply(as_changes(spark, log[batch * 20 : batch * 20 + 20] + (again if batch == 2 else [])), batch)
    assert {(r[0], r[1], *map(int, r[2:-1])) for r in view.exact_log().collect() if r.seq <= 60} == expected(log, QUERIES[0])


def test_a_batch_is_shuffled_once_to_be_checked(spark, tmp_path, monkeypatch):
    """Changes and the state's rows of their tuples meet in one exchange and one sort."""
    from deltaloom.streaming import microbatch

    monkeypatch.setattr(microbatch, "FEW", 0)
    view = View(spark, query("one", "R(x,y)", "x"), str(tmp_path / "view"), exact=True)
    view.apply(as_changes(spark, [("R", 1, 1, "+", 1)]), 0)
    plan = view._checked(as_changes(spark, [("R", 1, 1, "-", 2)]), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Join" not in plan


def test_a_larger_state_stays_where_it_is(spark, tmp_path, monkeypatch):
    """Of a state that is larger than the batch only rows that match go on; a smaller one has no join."""
    from deltaloom.streaming import microbatch

    monkeypatch.setattr(microbatch, "FEW", 0)
    view = View(spark, query("one", "R(x,y)", "x"), str(tmp_path / "view"))
    state, one = spark.range(50).withColumnRenamed("id", "k"), spark.range(7, 8).withColumnRenamed("id", "k")
    assert [r.k for r in view._matching(state, one, ["k"]).collect()] == [7]
    assert view._matching(one, state, ["k"]).collect() == one.collect()


@pytest.mark.parametrize("few", [0, 100_000])
def test_counts_smaller_and_larger_than_a_batch(spark, tmp_path, monkeypatch, few):
    """Net changes, whether the counts so far are summed with the joined rows, met in one aggregation or read for a few; some batches run twice."""
    from deltaloom.streaming import microbatch

    monkeypatch.setattr(microbatch, "FEW", few)
    log, view = random_log(random.Random(12), 90), View(spark, QUERIES[0], str(tmp_path / "view"), fold=3)
    state: dict[str, set[tuple]] = {"R": set(), "S": set()}
    before: set[tuple] = set()
    for batch, (lo, hi) in enumerate([(0, 5), (5, 40), (40, 43), (43, 44), (44, 90)]):
        for _ in range(1 + batch % 2):
            out = view.apply(as_changes(spark, log[lo:hi]), batch)
        for rel, x, y, op, _ in log[lo:hi]:
            (state[rel].add if op == "+" else state[rel].discard)((x, y))
        after = brute(state, QUERIES[0])
        assert {(r.op, int(r.x), int(r.w)) for r in out.collect()} == {("+", *t) for t in after - before} | {("-", *t) for t in before - after}
        before = after
    assert {(int(r.x), int(r.w)) for r in view.results().collect()} == before


def test_counts_meet_what_changes_in_one_shuffle(spark, tmp_path, monkeypatch):
    """A batch's joined rows, what they change and the counts so far take one exchange by result: a state no larger than the batch isn't joined."""
    from deltaloom.streaming import microbatch

    monkeypatch.setattr(microbatch, "FEW", 0)
    view, plans = View(spark, query("one", "R(x,y)", "x"), str(tmp_path / "view")), {}
    write = view._write
    monkeypatch.setattr(view, "_write", lambda df, name, batch: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), write(df, name, batch))[1])
    for batch in range(2):
        view.apply(as_changes(spark, [("R", batch, k, "+", 10 * batch + k) for k in range(5)]), batch)
    assert plans["counts/0"].count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning" not in plans["output/0"] and "Join" not in plans["output/0"]
