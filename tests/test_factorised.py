"""Factorised answers against plain joins: counts, expansion, pages, and what is shuffled."""

from __future__ import annotations

import random

import pytest

from deltaloom.operators.factorised import factorised
from deltaloom.plans.model import query
from tests.test_joins import brute

CASES = [
    (query("star", "R(a,b) S(a,c) R(a,d)", "a,b,c,d"), 0),
    (query("path", "R(a,b) S(b,c) R(c,d)", "a,b,c,d"), 1),
    (query("deep", "R(a,b) S(b,c) R(c,d) S(c,e) R(a,f)", "f,a,b,c,d,e"), 0),
    (query("same", "R(a,b) S(a,b) R(b,c)", "a,b,c"), 2),
    (query("one", "R(a,b)", "b,a"), 0),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("chunk", [2, 1024])
def test_against_joins(spark, case, chunk):
    q, root = CASES[case]
    rng = random.Random(case)
    data = {name: sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(n)}) for name, n in (("R", 12), ("S", 9))}
    frames = {name: spark.createDataFrame(rows, "x int, y int") for name, rows in data.items()}
    f = factorised(frames.__getitem__, q, root, chunk)
    want = brute(data, q)
    got = [tuple(r) for r in f.expanded().collect()]
    assert sorted(got) == sorted(want) and f.count().first().n == len(want)
    order = [*f.nodes[f.root].attrs, *(a for a in q.out if a not in f.nodes[f.root].attrs)]
    ranked = sorted(want, key=lambda t: [dict(zip(q.out, t))[a] for a in order])
    for start, size in ((0, 5), (3, 7), (len(want) - 2, 10), (len(want) + 1, 4)):
        page = sorted(tuple(r) for r in f.page(start, size).collect())
        assert page == [(k, *ranked[k]) for k in range(start, min(start + size, len(want)))]


def test_products_are_not_expanded(spark):
    """Two lists of 3,000 under one key are nine million answers, counted from a few rows."""
    r = spark.range(3000).selectExpr("0 AS x", "CAST(id AS INT) AS y")
    hub = spark.createDataFrame([(0, 0), (1, 1)], "x int, y int")
    f = factorised({"H": hub, "R": r, "S": r}.__getitem__, query("p", "H(a,h) R(a,b) S(a,c)", "a,h,b,c"))
    assert f.count().first().n == 9_000_000 and f.rows.count() < 200
    assert [tuple(x) for x in f.page(8_999_998, 5).orderBy("rank").collect()] == [(8_999_998, 0, 0, 2999, 2998), (8_999_999, 0, 0, 2999, 2999)]


def test_empty_and_projected(spark):
    none = spark.createDataFrame([], "x int, y int")
    f = factorised(lambda name: none, query("e", "R(a,b) S(b,c)", "a,b,c"))
    assert f.count().first().n == 0 and f.expanded().isEmpty() and f.page(0, 3).isEmpty()
    with pytest.raises(ValueError, match="all attributes"):
        factorised(lambda name: none, query("e", "R(a,b) S(b,c)", "a,c"))


def test_a_page_gathers_only_what_it_touches(spark):
    """The sizes come from counts; of the children only rows below the page's root rows are gathered."""
    rows = {"H": [(k, k) for k in range(50)], "R": [(k, j) for k in range(50) for j in range(4)]}
    frames = {name: spark.createDataFrame(found, "x int, y int") for name, found in rows.items()}
    f = factorised(frames.__getitem__, query("p", "H(a,h) R(a,b) R(a,c)", "a,h,b,c"))
    assert "collect_list" not in f._sizes()._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in f._sizes().collect()} == {(k, k, 16) for k in range(50)}
    touched = spark.createDataFrame([(3, 3), (4, 4)], "a int, h int")
    assert [r.count() for r in f._below(touched)] == [2, 8, 8]
    assert [tuple(r) for r in f.page(16 * 3 + 15, 2).orderBy("rank").collect()] == [(63, 3, 3, 3, 3), (64, 4, 4, 0, 0)]
