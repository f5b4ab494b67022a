"""The divergence audit against SQL and plain Python, and radix selection against sorting."""

from __future__ import annotations

import collections
import itertools
import random
import re

import duckdb
import pytest

from deltaloom.llm import divergence as dv
from tests.llm.test_shards import DOC, SF, same_as_sql


def brute(docs, min_docs, k):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, over all terms."""
    docs = [tuple(x or "" for x in d) for d in docs]
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    tf, df = collections.Counter(), collections.Counter()
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        tf.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {d[1] for d in docs}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        sources = sorted({d[2] for d in docs if d[1] == lang}, key=lambda s: s.encode())

        def shares(counts):
            return [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept)) for c in counts]

        own = {s: [tf[lang, s, t] for t in kept] for s in sources}
        p = {s: shares(c) for s, c in own.items()}
        q = shares([sum(c) for c in zip(*own.values())])
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(map(gap, p[s], p[o]))) for o in sources if o != s]
            terms = [(t, gap(a, b)) for t, c, a, b in zip(kept, own[s], p[s], q) if c and a > b]
            for part, rows in (("pair", pairs), ("term", terms)):
                ordered = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, *r, n) for n, r in enumerate(ordered if part == "pair" else ordered[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "aB", "É", "é", "zz", "ö1ö", "x" * 300, "x" * 299 + "y", "x" * 299, "日本", "日"]
    text = lambda: "".join(rng.choice(words) + rng.choice(" \n,.0_") for _ in range(rng.randint(0, 12)))
    docs = [(text(), rng.choice(["en", "fr", None]), rng.choice(["s", "t", "ü", "", None])) for _ in range(60)]
    docs += [(None, "en", "only nulls"), ("rare words", "la", "one"), ("", "la", "two"), ("alone", "it", "x")] + [docs[0]] * 5
    table = spark.createDataFrame([(k, t, lang, source, 0, "own", 7, "own") for k, (t, lang, source) in enumerate(docs)], DOC).repartition(3)
    table = table.selectExpr("*", "1 AS term", "2 AS tf", "3 AS value")
    for k in (1, 3, 10):
        assert sorted(map(tuple, dv.audit(table, 3, k).collect())) == brute(docs, 3, k)


def test_radix_selection(spark):
    """Values of many sizes, groups of ties with long common beginnings, k inside ties."""
    rng = random.Random(1)
    rows = [("large", f"i{k}", rng.choice([0, 1, 65535, 65536, 1 << 31, (1 << 47) + 5, (1 << 62) + k % 3])) for k in range(200)]
    rows += [("ties", "same beginning " * 20 + f"{k}", 9) for k in range(150)] + [("ties", "same beginning " * 20, 9), ("few", "é", 3), ("few", "z", 3), ("zero", "a", 0)]
    table = spark.createDataFrame(rows, "g string, item string, value bigint")
    for k in (1, 7, 100):
        want = []
        for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[2], r[1].encode())), key=lambda r: r[0]):
            want += [(*r, n) for n, r in enumerate(list(group)[:k], 1)]
        assert sorted(map(tuple, dv.largest(table, ["g"], k).collect())) == sorted(want)
    with pytest.raises(Exception, match="items repeat"):
        dv.largest(spark.createDataFrame([("g", "a", 1)] * 3, "g string, item string, value bigint"), ["g"], 2).collect()


def test_slices_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(dv, "SLICE", 7)
    text = "Some words, some LONGER-words 12 é" * 9
    assert {k.decode(): n for k, n in dv.text_terms(text).items()} == collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
    c, n, v = 4 * 10**12, 10**15, 10**9
    got = spark.range(1).selectExpr(f"CAST({c} AS BIGINT) AS c", f"CAST({n} AS BIGINT) AS n", f"CAST({v} AS BIGINT) AS v").select(dv.share("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_empty_table_and_sql(spark):
    assert dv.audit(spark.createDataFrame([], DOC)).isEmpty()
    same_as_sql(dv.op13_divergence(spark, SF), dv.ORACLE, duckdb.connect())
