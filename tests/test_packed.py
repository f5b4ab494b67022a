"""Lists of values as bytes, and the joins that move them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaloom import catalog
from deltaloom.operators import lifetimes as lt
from deltaloom.operators import packed
from deltaloom.operators import snapshot as sn
from deltaloom.plans.model import query

EDGES = [0, 1, -1, 70_000, -(1 << 63), (1 << 63) - 1, 1 << 62]
Q = query("g", "R(a,b) S(b,c) T(c,d)", "a,d")


@pytest.mark.parametrize("width", [1, 3])
def test_round_trip(width):
    rng = np.random.default_rng(width)
    for k in range(60):
        sizes = rng.integers(0, 6, rng.integers(0, 8))
        n = int(sizes.sum())
        columns = [((rng.choice(np.array(EDGES), n) if k % 2 else np.sort(rng.integers(0, 300, n))), rng.random(n) < 0.7) for _ in range(width)]
        found, own = packed.decoded(*packed.encoded(columns, sizes), width)
        assert list(own) == list(sizes)
        for (values, there), (values2, there2) in zip(columns, found):
            assert list(there) == list(there2) and list(values[there]) == list(values2[there])


def test_sorted_neighbours_take_a_byte():
    values = np.arange(0, 60_000, 20) + 7_000_000
    data, ends = packed.encoded([(values, np.ones(len(values), bool))], np.array([len(values)]))
    assert len(data) == ends[-1] == len(values) + 3


def random_log(rng, n, nulls):
    """R, S, T with inserts and deletes; some values null, few in the first column, so that some have many lives."""
    live, out = set(), []
    for seq in range(1, n):
        t = (rng.choice("RST"), rng.choice([0, 1, 2, None] if nulls else [0, 1, 2, 1 << 62]), rng.choice([0, 1, 2, 3, None] if nulls else [0, 1, -5, 1 << 61]))
        out.append((*t, "-" if t in live else "+", seq))
        live ^= {t}
    return out


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("chunk", [1, 40, 500_000])
def test_gathered_log(spark, monkeypatch, nulls, chunk):
    """The same log as by joining lives one by one, however few values are unpacked at a time and however short lists are."""
    monkeypatch.setattr(packed, "CHUNK", chunk)
    log = random_log(random.Random(chunk), 160, nulls)
    frame = spark.createDataFrame(log, "rel string, x bigint, y bigint, op string, seq bigint")
    logs = lambda name: frame.where(frame.rel == name).drop("rel")
    want = sorted(map(str, lt.delta_log(logs, Q).collect()))
    assert sorted(map(str, lt.gathered_log(logs, Q, "a", 2, 3).collect())) == want and len(want) > 40
    live = lambda name: logs(name).groupBy("x", "y").agg(F.max_by("op", "seq").alias("op")).where("op = '+'").drop("op")
    found = sn.gathered(live, Q, "a", 2, 3).collect()
    assert sorted(map(str, found)) == sorted(map(str, sn.snapshot(live, Q).collect()))


def test_gathered_log_needs_two_numbers(spark):
    frame = spark.createDataFrame([("1", "2", "+", 1)], "x string, y string, op string, seq bigint")
    with pytest.raises(ValueError, match="two whole numbers"):
        lt.gathered_log(lambda name: frame, Q, "a", 2)
    assert [tuple(r) for r in sn.gathered(lambda name: frame.select("x", F.lit("2").alias("y")) if name == "R" else frame.select(F.lit("2").alias("x"), "y"), Q, "a", 2).collect()] == [("1", "2")]


def shuffled(spark, frame):
    """Bytes that all stages of a frame's run write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        empty = spark._jvm.java.util.ArrayList()
        stages = store.stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    frame.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("name", ["non_free_connex_snapshot", "delta_non_free_connex"])
def test_joined_rows_move_with_a_list(spark, tmp_path, name):
    """24,000 joined pairs of customer and part meet 100 suppliers each: about a quarter of a byte is moved for each of these (before 1 and 3 bytes)."""
    spark.range(6_000).selectExpr("id AS o_orderkey", "id % 600 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(24_000).selectExpr("id % 6000 AS l_orderkey", "(id * 7919) % 240 AS l_partkey", "((id * 7919) % 240 + (id div 240) * 41) % 4001 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()[name](spark, str(tmp_path))
    pairs = 24_000 * 100
    assert shuffled(spark, found) < 0.6 * pairs
