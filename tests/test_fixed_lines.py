"""Line decoders, field splitter, routing and query classes on fixed lines and queries, by line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.functions.fields import csv_fields
from deltaloom.plans.model import classify, query
from deltaloom.sources import updates as up

CLASSES = [
    query("path", "R(a,b) S(b,c) T(c,d)", "a,b,c,d"),
    query("path_prefix", "R(a,b) S(b,c) T(c,d)", "a,b"),
    query("path_ends", "R(a,b) S(b,c) T(c,d)", "a,d"),
    query("star", "R(a,b) S(a,c) T(a,d)", "b,c,d"),
    query("star_hub", "R(a,b) S(a,c) T(a,d)", "a,b,c"),
    query("triangle", "R(a,b) S(b,c) T(c,a)", "a,b,c"),
    query("doubled_triangle", "R(a,b) R2(a,b) S(b,c) T(c,a)", "a,b,c"),
    query("two_parts", "R(a,b) S(c,d)", "a,c"),
    query("single", "R(a,b)", "a"),
]
CLASS_NAMES = ["free_connex", "free_connex", "acyclic", "acyclic", "free_connex", "cyclic", "cyclic", "disconnected", "free_connex"]
PIPED_LINES = ["+|KN|1|5|6", "-|KN|1|5|6", "*", "?|KN|1", "+|XX|1", "+", "+|PE|7||x||", "+|ME|3|a"]
TABLED_LINES = ['1 title 7,"a, b",x', '0 title 7,"a, b",x', "title 8,,y", "noline", "1 title", '1 note 9,"say \\"hi\\" \\\\ \\n",z']
CSV_LINES = ["a,b", " a , b ", '"a,b",c', '"x \\"y\\"",z', "a,,c", "a,", ""]
REGISTRY = [("KN", "knows1", 1, [1, 2]), ("KN", "knows2", 1, [2, 1]), ("PE", "person1", 0, [0, 2]), ("ME", "message1", 0, [0, 5])]


def numbered(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_piped_lines(spark):
    found = up.decode_piped(numbered(spark, PIPED_LINES)).withColumn("cells", F.array_join("cells", ";"))
    assert rows(found, "line_no", "op", "tag", "cells") == [(0, "+", "KN", "1;5;6"), (1, "-", "KN", "1;5;6"), (4, "+", "XX", "1"), (6, "+", "PE", "7;;x"), (7, "+", "ME", "3;a")]


def test_tabled_lines(spark):
    found = up.decode_tabled(numbered(spark, TABLED_LINES)).withColumn("cells", F.array_join("cells", ";"))
    assert rows(found, "line_no", "op", "tag", "cells") == [(0, "+", "title", "7;a, b;x"), (1, "-", "title", "7;a, b;x"), (2, "+", "title", "8;null;y"), (5, "+", "note", '9;say "hi" \\ \\n;z')]


def test_fields(spark):
    found = numbered(spark, CSV_LINES).select("line_no", F.array_join(csv_fields("value"), "|").alias("fields"), F.size(csv_fields("value")).alias("n"))
    assert rows(found, "line_no", "fields", "n") == [(0, "a|b", 2), (1, "a|b", 2), (2, "a,b|c", 2), (3, 'x "y"|z', 2), (4, "a||c", 3), (5, "a|", 2), (6, "", 0)]


def test_routing(spark):
    found = up.routed(up.decode_piped(numbered(spark, PIPED_LINES)), REGISTRY).withColumn("values", F.array_join("values", ";", "<none>"))
    want = [(0, "+", "knows1", 5, "5;6", True), (0, "+", "knows2", 5, "6;5", True), (1, "-", "knows1", 5, "5;6", True), (1, "-", "knows2", 5, "6;5", True), (6, "+", "person1", 7, "7;x", True), (7, "+", "message1", 3, "3;<none>", False)]
    assert rows(found, "line_no", "op", "relation", "key", "values", "ok") == want


def test_classes():
    assert [classify(q) for q in CLASSES] == CLASS_NAMES
