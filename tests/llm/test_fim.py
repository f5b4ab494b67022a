"""Filling in the middle against SQL, plain Python and round trips."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaloom.llm import fim
from tests.llm.test_shards import DOC, same_as_sql

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A[\t\n\x0b\f\r ]+|[^\t\n\x0b\f\r ]+[\t\n\x0b\f\r ]*", "char": r"(?s:.)"}


def plain(doc_id, text, unit="line", rate=100, spm=50, tags=("<P>", "<S>", "<M>")):
    """n, form, prefix_chars, middle_chars and output, as the contract says."""
    units = re.findall(PATTERNS[unit], text or "")
    assert "".join(units) == (text or "")
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(t in text for t in tags) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    pre, mid, suf = ("".join(u) for u in (units[:x], units[x:y], units[y:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    p, s, m = tags
    return n, form, len(pre), len(mid), f"{s}{suf}{p}{pre}{m}{mid}" if form == "spm" else f"{p}{pre}{s}{suf}{m}{mid}"


def odd_rows():
    rng = random.Random(5)
    texts = ["", None, "\n", "\n\n\n", "a", "é\n🙂 ü\n", "a\nb", "a\nb\n", "<P>", "x<S>y\nz", "<", "P>\n<", "<P\n>", "x" * 9_000_000, "l\n" * 500_000, "a\r\nb\x0bc", " \t lead", "tail \n "]
    texts += ["".join(rng.choice("ab\n <PSM>é🙂") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id\nat all"), (-4, "minus\nfour"), (1 << 40, "large\nid\n")]


@pytest.mark.parametrize(("unit", "rate", "tags"), [("line", 100, fim.SENTINELS), ("word", 60, fim.SENTINELS), ("char", 100, ("␂pre", "␃", "[M]"))])
def test_against_plain_python(spark, unit, rate, tags):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "own", 7, "own") for i, t in rows], DOC)
    docs = docs.withColumn("output", F.lit("own")).withColumn("n", F.lit(3)).withColumn("h1", F.lit(1))
    found = fim.restore(fim.transform(docs, unit, rate, sentinels=tags), tags)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found.collect()), key=repr)
    want = sorted(((i, *plain(i, t, unit, rate, tags=tags), t or "") for i, t in rows), key=repr)
    assert len(got) == len(want)
    assert [k for k, (a, b) in enumerate(zip(got, want)) if a != b] == []


def test_damage_and_sentinels(spark):
    broken = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="each sentinel once"):
        fim.restore(broken).collect()
    for tags in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(broken, sentinels=tags)


def test_empty_table_and_sql(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], DOC))).isEmpty()
    same_as_sql(fim.op11_fim(spark, "/root/testdata/sf0.001"), fim.ORACLE, duckdb.connect())
