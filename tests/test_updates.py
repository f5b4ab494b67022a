"""Line decoders: their formats' corner cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from deltaloom.functions.fields import csv_fields
from deltaloom.plans.model import query, read_queries
from deltaloom.sources import updates as up


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_piped(spark):
    lines = spark.createDataFrame([("+|KN|1|5|6",), ("*",), ("?|KN|1",), ("+",), ("-|PE|7||x||",), ("",), (None,)], "value string")
    assert rows(up.decode_piped(lines)) == [("+", "KN", ["1", "5", "6"]), ("-", "PE", ["7", "", "x"])]


def test_tabled(spark):
    lines = spark.createDataFrame([('1 title 7,"a, b",x',), ("0 title 8,,y",), ("title 9",), ("1 title",), ("word",), ("",), (None,)], "value string")
    assert rows(up.decode_tabled(lines)) == [("+", "title", ["7", "a, b", "x"]), ("-", "title", ["8", "null", "y"]), ("+", "title", ["9"])]


def test_missing_values_join(spark):
    lines = spark.createDataFrame([("1 a ,1",), ("1 b ,2",)], "value string")
    d = up.decode_tabled(lines).selectExpr("tag", "cells[0] AS k")
    assert d.where("tag = 'a'").join(d.where("tag = 'b'").drop("tag"), "k").count() == 1


def test_csv(spark):
    cases = {'ab"c,d"e,f': ["abc,de", "f"], r'"a\"b\\c\n"': [r'a"b\c\n'], r"a\"b"[:2]: ["a\\"], " x ,  y": ["x", "y"], ",": ["", ""], "": []}
    frame = spark.createDataFrame(list(cases.items()), "value string, want array<string>")
    for r in frame.select("value", "want", csv_fields("value").alias("got")).collect():
        assert r.got == r.want, r.value


def test_routing(spark):
    changes = spark.createDataFrame([("+", "T", ["1", "x"]), ("-", "T", ["z", "x"]), ("+", "U", ["1"]), ("+", "T", [])], "op string, tag string, cells array<string>")
    got = rows(up.routed(changes, [("T", "r1", 0, [1, 0]), ("T", "r2", 0, [5])]).orderBy("op", "relation", "key"))
    assert got == [("+", "r1", 1, ["x", "1"], True), ("+", "r2", 1, [None], False), ("-", "r1", None, ["x", "z"], False), ("-", "r2", None, [None], False)]


def split_by_character(line: str) -> list[str]:
    """The same fields, one character at a time."""
    if not line:
        return []
    out, field, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == "\\" and i + 1 < len(line):
            field += line[i + 1] if line[i + 1] in '"\\' else line[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
        i += 1
    return [f.strip("".join(map(chr, range(33)))) for f in [*out, field]]


def test_csv_against_characters(spark):
    rng = random.Random(3)
    odd = ['a,"b,c', r'"a\"b,c', "  ", "\ta,\t", '"', '"\\', 'x"\\', "a\nb,c"]
    lines = odd + ["".join(rng.choice('ab,,"""\\\\ \t\nü') for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ['"' + "a," * 3000 + '"', "x" * 20000]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    for r in frame.select("value", csv_fields("value").alias("got")).collect():
        assert r.got == split_by_character(r.value), r.value


def test_tabled_separators(spark):
    lines = spark.createDataFrame([("1\ttitle 7,x",), ("  0  a 1",), ("1 a  ",), ("0 a 1,\t",), ("b  ,",)], "value string")
    assert rows(up.decode_tabled(lines)) == [("+", "1\ttitle", ["7", "x"]), ("-", "a", ["1"]), ("-", "a", ["1", "null"]), ("+", "b", ["null", "null"])]


def test_numbers_follow_the_files(spark, tmp_path):
    """Lines of files in many blocks get one number after the other; those that aren't updates get none."""
    kept = []
    for name in ("b", "a"):
        with open(tmp_path / f"{name}.txt", "w") as f:
            for k in range(4000):
                f.write(f"{'?' if k % 7 == 0 else '+'}|T|{name}{k}\n")
    for name in ("a", "b"):
        kept += [f"{name}{k}" for k in range(4000) if k % 7]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        found = up.read_updates(spark, str(tmp_path), "piped").select("seq", F.col("cells")[0].alias("c")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.seq, r.c) for r in found] == list(enumerate(kept, 1))


def test_schema_file(spark, tmp_path):
    (tmp_path / "schema.txt").write_text("KN,knows1,1,1,2   # key 1\n\nPE, person1, 0, 2\n2 # queries\n0\nperson1.0,1\nknows1,0\n1\nknows1.2,1\n")
    assert up.read_schema(spark, str(tmp_path / "schema.txt")) == ([("KN", "knows1", 1, [1, 2]), ("PE", "person1", 0, [2])], [[("person1", 0, 1), ("knows1", 0, 0)], [("knows1", 2, 1)]])


def test_query_file():
    text = "2\n\n2\n1 0 2 1 2\n2 3 2 2 3\n2 1 3\n\n1\n5 0 1 9\n1 9\n"
    assert read_queries(text, {0: "R", 3: "S"}) == [query("q0", "R(a1,a2) S(a2,a3)", "a1,a3"), query("q1", "R(a9)", "a9")]


def test_lines_are_numbered_where_they_lie(spark, tmp_path):
    """No lines are shuffled or sorted to be numbered: only blocks are counted together."""
    (tmp_path / "a.txt").write_text("+|T|1\n?|T|2\n-|T|3\n")
    found = up.read_updates(spark, str(tmp_path / "a.txt"), "piped")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert sorted((r.seq, r.op, r.cells) for r in found.collect()) == [(1, "+", ["1"]), (2, "-", ["3"])]
