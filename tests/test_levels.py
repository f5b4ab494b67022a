"""Views maintained level by level against recomputation after every batch, and the queries that use them."""

from __future__ import annotations

import random

import pytest

from deltaloom import catalog
from deltaloom.plans.model import query
from deltaloom.streaming import keyed, microbatch
from deltaloom.streaming.levels import LevelViews
from tests.test_deltas import LOOP, loop
from tests.test_joins import brute
from tests.test_keyed import CASES, nodes_brute, random_changes, replay

SCHEMA = "rel string, cells array<string>, op string, seq bigint"


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def applied(spark, views, parts):
    for k, part in enumerate(parts):
        views.apply_all(spark.createDataFrame(part, SCHEMA), k)
    return views


@pytest.mark.parametrize("case, few", [(0, 5), (1, 100_000), (2, 0)])
def test_against_recomputation(spark, tmp_path, monkeypatch, case, few):
    """All states, live tuples, results and violations, whether changes count as few or as many; folded every second batch."""
    monkeypatch.setattr(microbatch, "FEW", few)
    q, top, every = CASES[case]
    changes = random_changes(random.Random(10 * case + few % 7), sorted({a.relation for a in q.atoms} | {"Other"}), 90)
    views = LevelViews(spark, [q], str(tmp_path / "views"), [top], every, leaves=True, fold=2)
    applied(spark, views, [changes[45 * k : 45 * k + 45] for k in range(2)])
    nodes, rows = views.layout.nodes, lambda found: [(r["batch"], tuple(r.asDict()[c] for c in found.columns if c != "batch")) for r in found.collect()]
    states = [rows(views.states_after(i, [0, 1])) for i in range(len(nodes))]
    live = {i: rows(views.live_after(i, [0, 1])) for i in range(len(nodes)) if nodes[i].parent is None or i in views.watched}
    moved, before = rows(views.output()), set()
    for k in range(2):
        state, wrong = replay([c for c in changes[: 45 * k + 45] if c[0] != "Other"])
        counts, want = nodes_brute(state, q, views)
        for i, n in enumerate(nodes):
            assert sorted((t[:-2], t[-2], t[-1]) for b, t in states[i] if b == k) == sorted((t, c, c == len(n.children)) for t, c in counts[i].items())
            if every or views.layout.needed[i]:
                assert sorted(t for b, t in live[i] if b == k) == sorted(want[i])
        after = brute({r: state.get(r, set()) for r in "RST"}, q)
        assert {t for b, t in moved if b == k} == {("+", *t) for t in after - before} | {("-", *t) for t in before - after}
        before = after
    assert {tuple(r) for r in views.results().collect()} == before
    assert sorted((r.rel, tuple(r.cells), r.op, r.seq) for r in views.violations().collect()) == sorted(wrong)


def test_query_sets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(microbatch, "FEW", 20)
    queries = [query("a", "R(x,y) S(y,z)", "x"), query("b", "R(x,y) T(x,w)", "x,y"), query("c", "R(p,q) S(q,r) T(r,s)", "p,s"), query("d", "R(x,y)", "y")]
    changes = random_changes(random.Random(11), "RST", 90)
    views = applied(spark, LevelViews(spark, queries, str(tmp_path / "views"), [0, 0, 0, 0], sets=True), [changes[:45], changes[45:]])
    found = {}
    for r in views.query_sets_after([0, 1]).collect():
        found.setdefault(r.batch, {})[r.x, r.y] = r.qids
    for k, upto in enumerate([45, 90]):
        state, _ = replay(changes[:upto])
        want = {t: [n for n, q in enumerate(queries) if brute(state | {"R": {t}}, q)] for t in state["R"]}
        assert found[k] == {t: ",".join(map(str, own)) for t, own in want.items() if own}
    for n, q in enumerate(queries):
        assert {tuple(r) for r in views.results(n).collect()} == brute(state, q)
    with pytest.raises(ValueError, match="query sets"):
        LevelViews(spark, queries, str(tmp_path / "bad"), [0, 1, 0, 0], sets=True)


def test_repeated_attribute_and_nulls(spark, tmp_path):
    changes = [(r, [x, y], "+", k) for k, (r, x, y) in enumerate((r, x, y) for r in "RS" for x in ("1", "2", None) for y in ("1", "2", None))]
    views = applied(spark, LevelViews(spark, [LOOP], str(tmp_path / "views")), [changes[:7], changes[7:]])
    state, _ = replay([c for c in changes if None not in c[1]])
    assert {tuple(r) for r in views.results().collect() if None not in tuple(r)} == loop({r: state[r] for r in "RS"})


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    q = query("j", "R(a,b) S(b,c)", "a,c")
    parts = [[("R", ["1", "2"], "+", 1)], [("S", ["2", "3"], "+", 2)]]
    views = applied(spark, LevelViews(spark, [q], str(tmp_path / "views"), [0]), parts)
    views.apply_all(spark.createDataFrame(parts[1], SCHEMA), 1)
    assert [tuple(r) for r in views.results().collect()] == [("1", "3")]
    assert [tuple(r) for r in views.states(0).collect()] == [("1", "2", 1, True)] and [tuple(r) for r in views.live(1).collect()] == [("2", "3")]


def test_existence_atoms_are_not_joined(spark, tmp_path, monkeypatch):
    """Of an atom without output only keys meet other tuples, never its tuples one by one."""
    seen, output = [], LevelViews._output
    monkeypatch.setattr(LevelViews, "_output", lambda self, q, *a: seen.append([x.attrs for x in q.atoms]) or output(self, q, *a))
    q = query("c", "CN(c,n) OC(o,c) LO(o,p)", "c,n")
    changes = [("CN", ["1", "9"], "+", 1), ("OC", ["5", "1"], "+", 2)] + [("LO", ["5", str(k)], "+", 3 + k) for k in range(50)]
    views = applied(spark, LevelViews(spark, [q], str(tmp_path / "views")), [changes])
    assert seen == [[("c", "n")]] and [tuple(r) for r in views.results().collect()] == [("1", "9")]
    assert spark.read.parquet(f"{tmp_path}/views/counts/0/v=0").collect()[0]["_n"] == 1


@pytest.mark.parametrize("name", ["stream_alive", "stream_generalized", "stream_keyed", "stream_live", "stream_onhold", "stream_query_sets"])
def test_registered_queries_call_no_python_for_a_change(spark, monkeypatch, name):
    """A batch of the registered streams is joins and aggregations of columns: no operator takes its changes one by one."""
    monkeypatch.setattr(keyed._Operator, "handleInputRows", None)
    monkeypatch.setattr(keyed.KeyedViews, "start", None)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
