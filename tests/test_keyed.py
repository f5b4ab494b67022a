"""The keyed view against recomputation after every batch: node states, live tuples, results."""

from __future__ import annotations

import random

import pytest

from deltaloom.plans.model import query, tree
from deltaloom.streaming import keyed
from deltaloom.streaming.keyed import KeyedView, KeyedViews, latency, state_reads
from tests.test_deltas import LOOP, loop
from tests.test_joins import brute


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Small batches: each operator of the line as one task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def random_changes(rng, rels, n, size=4, width=2):
    """(rel, cells, op, seq): inserts and deletes, some of which a set can't take."""
    live, out = set(), []
    for seq in range(n):
        t = (rng.choice(rels), *(str(rng.randrange(size)) for _ in range(width)))
        op = ("-" if t in live else "+") if rng.random() < 0.9 else rng.choice("+-")
        out.append((t[0], list(t[1:]), op, seq))
        (live.add if op == "+" else live.discard)(t)
    return out


def replay(changes):
    state, wrong = {}, []
    for rel, cells, op, seq in changes:
        own = state.setdefault(rel, set())
        if (tuple(cells) in own) == (op == "+"):
            wrong.append((rel, tuple(cells), op, seq))
        (own.add if op == "+" else own.discard)(tuple(cells))
    return state, wrong


def run(spark, view, path, parts):
    """Feeds the parts as one batch each."""
    schema = "rel string, cells array<string>, op string, seq bigint"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    q = view.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q.awaitTermination()
    return q


def nodes_brute(state, q, view):
    """For each node of the tree: tuple -> number of satisfied children; and its live tuples."""
    nodes = view.layout.nodes
    rows = [{tuple(dict(zip(n.atom.attrs, t))[a] for a in n.attrs) for t in state.get(n.atom.relation, ()) if all(dict(zip(n.atom.attrs, t))[a] == v for a, v in zip(n.atom.attrs, t))} if n.atom else set() for n in nodes]
    pick = lambda i, t, names: tuple(dict(zip(nodes[i].attrs, t))[a] for a in names)
    counts, alive = [{} for _ in nodes], [set() for _ in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i].height):
        n = nodes[i]
        keys = {c: {pick(c, t, view.layout.shared(c)) for t in alive[c]} for c in n.children}
        own = rows[i] if n.atom else set().union(*keys.values())
        counts[i] = {t: sum(pick(i, t, view.layout.shared(c)) in keys[c] for c in n.children) for t in own}
        alive[i] = {t for t, k in counts[i].items() if k == len(n.children)}
    live = [set() for _ in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i].depth):
        n = nodes[i]
        above = None if n.parent is None else {pick(n.parent, t, view.layout.shared(i)) for t in live[n.parent]}
        live[i] = {t for t in alive[i] if above is None or pick(i, t, view.layout.shared(i)) in above}
    return counts, live


CASES = [
    (query("end", "R(x,y) S(y,z) T(z,w)", "x,y"), None, False),
    (query("star", "R(a,b) S(a,c) R(a,d)", "b,c"), 2, True),
    (query("deep", "R(a,b) S(b,c) T(c,d) S(b,e)", "d,e"), ("b",), True),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_against_recomputation(spark, tmp_path, case):
    q, top, every = CASES[case]
    rng = random.Random(case)
    changes = random_changes(rng, sorted({a.relation for a in q.atoms} | {"Other"}), 90)
    view = KeyedView(spark, q, str(tmp_path / "view"), top, every)
    last = run(spark, view, str(tmp_path / "in"), [changes[30 * k : 30 * k + 30] for k in range(3)])
    before = set()
    for k in range(3):
        state, wrong = replay([c for c in changes[: 30 * k + 30] if c[0] != "Other"])
        counts, live = nodes_brute(state, q, view)
        for i, n in enumerate(view.layout.nodes):
            assert {tuple(r[:-2]): (r.n_satisfied, r.alive) for r in view.states(i, k).collect()} == {t: (c, c == len(n.children)) for t, c in counts[i].items()}
            if every or view.layout.needed[i]:
                assert {tuple(r) for r in view.live(i, k).collect()} == live[i]
            else:
                assert view.live(i, k).isEmpty()
        after = brute({r: state.get(r, set()) for r in "RST"}, q)
        assert {tuple(r) for r in view.results(0, k).collect()} == after
        assert {(r[0], *r[1:-1]) for r in view.output().where(f"batch = {k}").collect()} == {("+", *t) for t in after - before} | {("-", *t) for t in before - after}
        before = after
    assert sorted((r.rel, tuple(r.cells), r.op, r.seq) for r in view.violations().collect()) == sorted(wrong)
    assert [(b, n) for b, n, s in latency(last) if s > 0] == [(k, 30) for k in range(3)]


def test_goes_on_where_it_stopped(spark, tmp_path):
    q = query("j", "R(a,b) S(b,c)", "a,c")
    view = KeyedView(spark, q, str(tmp_path / "view"))
    run(spark, view, str(tmp_path / "in"), [[("R", ["1", "2"], "+", 1)]])
    again = KeyedView(spark, q, str(tmp_path / "view"))
    run(spark, again, str(tmp_path / "in"), [[("S", ["2", "3"], "+", 2)], [("R", ["1", "2"], "-", 3)]])
    assert [(r.op, r.a, r.c, r.batch) for r in again.output().orderBy("batch").collect()] == [("+", "1", "3", 1), ("-", "1", "3", 2)]


def test_repeated_attribute_and_nulls(spark, tmp_path):
    changes = [(r, [x, y], "+", k) for k, (r, x, y) in enumerate((r, x, y) for r in "RS" for x in ("1", "2", None) for y in ("1", "2", None))]
    view = KeyedView(spark, LOOP, str(tmp_path / "view"))
    run(spark, view, str(tmp_path / "in"), [changes, []])
    state, _ = replay([c for c in changes if None not in c[1]])
    assert {tuple(r) for r in view.results().collect() if None not in tuple(r)} == loop({r: state[r] for r in "RS"})


def test_dangling_changes_are_never_joined(spark, tmp_path):
    """99 of 100 changes find no partner: what is joined stays in proportion to the results."""
    q = query("w", "R(a,b) S(b,c)", "a,c")
    changes = [("S", [str(k), "s"], "+", k) for k in range(5)] + [("R", [f"r{k}", str(k)], "+", 10 + k) for k in range(500)]
    view = KeyedView(spark, q, str(tmp_path / "view"), 0)
    run(spark, view, str(tmp_path / "in"), [changes])
    said = {r.what: r.rows for r in view.traffic().collect()}
    assert said["result"] == 5 and said["live"] == 10 and said["state"] == 505


def test_existence_atoms_hold_one_count_a_key(spark, tmp_path):
    """An atom without output is never told about live rows nor joined, however many tuples a key has."""
    q = query("c", "CN(c,n) OC(o,c) LO(o,p)", "c,n")
    changes = [("CN", ["1", "9"], "+", 1), ("OC", ["5", "1"], "+", 2)] + [("LO", ["5", str(k)], "+", 3 + k) for k in range(50)]
    view = KeyedView(spark, q, str(tmp_path / "view"))
    assert "join" not in view.layout.kinds and "exists_down" not in view.layout.kinds
    run(spark, view, str(tmp_path / "in"), [changes])
    assert [tuple(r) for r in view.results().collect()] == [("1", "9")] and view.live(2).isEmpty()


def test_trees():
    q = query("t", "R(a,b) S(b,c) T(c,d)", "a")
    nodes = tree(q, 1)
    assert [(n.parent, n.height, n.depth) for n in nodes] == [(1, 0, 1), (None, 1, 0), (1, 0, 1)]
    general = tree(query("g", "CN(c,n) SN(s,n)", "n,s"), ("n",))
    assert [(n.parent, n.height) for n in general] == [(2, 0), (2, 0), (None, 1)] and general[2].atom is None
    for bad, top in ((query("x", "R(a,b) S(b,c) T(c,a)", "a"), 0), (query("p", "R(a,b) S(c,d)", "a"), 0), (q, ("a", "d"))):
        with pytest.raises(ValueError):
            tree(bad, top)


def test_query_sets(spark, tmp_path):
    """The queries in which each tuple of R is live, after every batch; one line for all three queries."""
    queries = [query("a", "R(x,y) S(y,z)", "x"), query("b", "R(x,y) T(x,w)", "x,y"), query("c", "R(p,q) S(q,r) T(r,s)", "p,s")]
    changes = random_changes(random.Random(11), "RST", 90)
    views = KeyedViews(spark, queries, str(tmp_path / "view"), [0, 0, 0], sets=True)
    run(spark, views, str(tmp_path / "in"), [changes[45 * k : 45 * k + 45] for k in range(2)])
    for k in range(2):
        state, _ = replay(changes[: 45 * k + 45])
        want = {}
        for t in state["R"]:
            own = [n for n, q in enumerate(queries) if brute(state | {"R": {t}}, q)]
            if own:
                want[t] = ",".join(map(str, own))
        assert {(r[0], r[1]): r.qids for r in views.query_sets(k).collect()} == want
        for n, q in enumerate(queries):
            assert {tuple(r) for r in views.results(n, k).collect()} == brute(state, q)
    with pytest.raises(ValueError, match="query sets"):
        KeyedViews(spark, queries, str(tmp_path / "bad"), [0, 1, 0], sets=True)


def test_reads_stay_flat_while_the_state_grows(spark, tmp_path):
    """A batch of 50 changes reads about as much of a state ten times as large."""
    read = {}
    for size in (200, 2000):
        old = [("S", [str(k), "s"], "+", k) for k in range(size)] + [("R", [f"r{k}", str(k)], "+", size + k) for k in range(size)]
        new = [("R", [f"n{k}", str(4 * k)], "+", 9000 + k) for k in range(25)] + [("S", [str(4 * k), "s"], "-", 9100 + k) for k in range(25)]
        view = KeyedView(spark, query("w", "R(a,b) S(b,c)", "a,c"), str(tmp_path / f"view{size}"))
        found = dict(state_reads(run(spark, view, str(tmp_path / f"in{size}"), [old, new])))
        read[size] = found[1]
        assert view.output().where("batch = 1 AND op = '-'").count() == 25
    assert 0 < read[2000] < 1.5 * read[200]


class Held(dict):
    """A map state that counts its calls."""

    calls = 0

    def getMapState(self, *names):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_calls_of_the_state_store_are_fewer_than_changes():
    """A bucket of 2,000 tuples takes two calls a leaf, and what is said of them goes on in packs."""
    layout, held = keyed.Layout([query("w", "R(a,b) S(b,c)", "a,c")], [0], False, False), Held()
    base = keyed.KINDS["base"](layout, 0)
    base.init(held)

    def fed(op, n):
        rows = [keyed._Event(f"0:S:{keyed._text([str(k), 's'])}", "change", -1, None, op, k, None) for k in range(n)]
        said = list(base.handleInputRows(("0:7",), iter(rows), None))
        return [r for r in said if r.addr.startswith("out:")], [r for r in said if not r.addr.startswith("out:")]

    out, on = fed(1, 2000)
    assert len(out) == 2000 / keyed.PACK and len(on) == 4000 and held.calls <= 2 * keyed.LEAVES
    out, on = fed(-1, 1000)
    assert len(out) == 1000 / keyed.PACK and len(on) == 2000
    fed(-1, 2000)
    assert not held


def test_no_more_partitions_than_cores(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    view = KeyedView(spark, query("e", "R(a,b) S(b,c)", "b"), str(tmp_path / "view"))
    last = run(spark, view, str(tmp_path / "in"), [[("R", ["1", "2"], "+", 1), ("S", ["2", "3"], "+", 2)]])
    assert {o["numShufflePartitions"] for p in last.recentProgress for o in p["stateOperators"]} == {spark.sparkContext.defaultParallelism}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and view.results().count() == 1
