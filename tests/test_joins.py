"""Joins, reduction and query classes against brute force on small relations."""

from __future__ import annotations

import itertools
import random

import pytest

from deltaloom.operators import snapshot as sn
from deltaloom.plans.model import Query, classify, join_tree, query
from tests.test_fixed_lines import CLASS_NAMES, CLASSES

QUERIES = [
    query("path", "R(a,b) S(b,c)", "a,c"),
    query("path3", "R(a,b) S(b,c) R(c,d)", "a,d"),
    query("star", "R(a,b) S(a,c) R(a,d)", "a,b"),
    query("self", "R(a,b) R(b,a)", "a,b"),
    query("triangle", "R(a,b) S(b,c) R(c,a)", "a,c"),
    query("loop", "R(a,a) S(a,b)", "b"),
    query("single", "R(a,b)", "b"),
]


def brute(tables: dict[str, list[tuple]], q: Query) -> set[tuple]:
    found = set()
    for rows in itertools.product(*(tables[a.relation] for a in q.atoms)):
        env: dict[str, object] = {}
        if all(env.setdefault(x, v) == v for a, row in zip(q.atoms, rows) for x, v in zip(a.attrs, row)):
            found.add(tuple(env[x] for x in q.out))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_and_reduction(spark, seed):
    rng = random.Random(seed)
    data = {name: sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(n)}) for name, n in (("R", 9), ("S", 7))}
    frames = {name: spark.createDataFrame(rows, "x int, y int") for name, rows in data.items()}
    for q in QUERIES:
        want = brute(data, q)
        for form in (sn.snapshot, sn.reduced):
            assert {tuple(r) for r in form(frames.get, q).collect()} == want, (q.name, form)


def test_empty_relations(spark):
    empty = spark.createDataFrame([], "x int, y int")
    for q in QUERIES:
        assert sn.snapshot(lambda name: empty, q).isEmpty() and sn.reduced(lambda name: empty, q).isEmpty()


def test_nulls_never_join(spark):
    frames = {"R": spark.createDataFrame([(1, None), (2, 3)], "x int, y int"), "S": spark.createDataFrame([(None, 4), (3, 5)], "x int, y int")}
    assert [tuple(r) for r in sn.snapshot(frames.get, QUERIES[0]).collect()] == [(2, 5)]


def test_classes():
    assert [classify(q) for q in CLASSES] == CLASS_NAMES


def test_products_are_refused(spark):
    q = query("x", "R(a,b) S(c,d)", "a,c")
    with pytest.raises(ValueError):
        sn.snapshot(lambda name: spark.createDataFrame([(1, 2)], "x int, y int"), q)
    with pytest.raises(ValueError):
        Query("y", q.atoms, ("z",))


def test_join_tree_takes_one_ear_at_a_time():
    assert join_tree([{"a", "b"}, {"a", "b"}, {"b", "c"}, {"c", "a"}]) is None
    assert join_tree([{"a", "b"}, {"a", "b"}, {"b", "c"}]) is not None


def test_node_states(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    left, right = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    got = {(r.a, r.b): (r.n_satisfied, r.alive) for r in sn.satisfied(rows, [left, right]).collect()}
    assert got == {(1, 1): (2, True), (1, 2): (1, False), (2, 1): (1, False)}
    keys = {r.k: r.alive for r in sn.generalized([spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")], ["k"]).collect()}
    assert keys == {1: False, 2: True}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_siblings_keep_their_tasks(spark):
    """The joins of siblings run in the tasks that the key was dealt to, whatever adaptive execution finds small."""
    q = query("star", "R(a,b) S(a,c) R(a,d)", "b,c,d")
    data = {"R": [(k % 4, k) for k in range(12)], "S": [(k % 4, -k) for k in range(8)]}
    frames = {name: spark.createDataFrame(rows, "x int, y int") for name, rows in data.items()}
    rows_of = sn.dealt(frames.get, "a", 7)
    for form in (sn.snapshot, sn.reduced):
        found = form(frames.get, q, rows_of)
        assert "hashpartitioning(a" in plan(found) and "7), REPARTITION_BY_NUM" in plan(found)
        assert sorted(map(tuple, found.collect())) == sorted(brute(data, q))


def test_whole_rows_are_not_made_distinct_again(spark):
    """Joined rows of sets with all of their attributes are distinct: no aggregate holds them."""
    q = query("full", "R(a,b) S(b,c)", "c,a,b")
    data = {"R": [(k % 3, k % 4) for k in range(12)], "S": [(k % 4, k) for k in range(8)]}
    frames = {name: spark.createDataFrame(rows, "x int, y int") for name, rows in data.items()}
    for form in (sn.snapshot, sn.reduced):
        assert sorted(map(tuple, form(frames.get, q).collect())) == sorted(brute(data, q))
    assert "Aggregate" not in plan(sn.snapshot(frames.get, q))


GATHERED = query("gathered", "R(a,b) S(b,c) T(c,d)", "a,d")


@pytest.mark.parametrize("longest", [2, 1_000])
def test_gathered_values(spark, longest):
    rng = random.Random(longest)
    data = {name: sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(40)}) for name in "RST"}
    frames = {name: spark.createDataFrame([*rows, (None, 3), (4, None)], "x int, y int") for name, rows in data.items()}
    want = {tuple(r) for r in sn.snapshot(frames.get, GATHERED).collect()}
    found = [tuple(r) for r in sn.gathered(frames.get, GATHERED, "a", 3, longest).collect()]
    assert len(found) == len(want) and set(found) == want
    assert (4, None) not in data["T"] and any(d is None for _, d in want) and any(a is None for a, _ in want)


def test_gathered_values_are_unfolded_where_they_stay(spark, tmp_path):
    """The registered query moves a row for each list of values, and none for each value."""
    from deltaloom import catalog

    spark.range(40).selectExpr("id AS o_orderkey", "id % 4 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4_000).selectExpr("id % 40 AS l_orderkey", "id % 7 AS l_partkey", "id % 101 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["non_free_connex_snapshot"](spark, str(tmp_path))
    assert found.count() == sn.snapshot(catalog._tables(spark, str(tmp_path)), catalog.SNAPSHOTS[13]).count() == 4 * 101
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Exchange" not in plan[: plan.index("Generate explode")]


def test_gathering_needs_one_value(spark):
    frames = {n: spark.createDataFrame([(1, 2)], "x int, y int") for n in "RST"}
    for q, by in ((query("two", "R(a,b) S(b,c)", "a"), "a"), (query("own", "R(a,b) S(b,c)", "a,c"), "c")):
        with pytest.raises(ValueError, match="not one attribute"):
            sn.gathered(frames.get, q, by, 2)
