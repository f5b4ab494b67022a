"""Sharding by slots: its law, its map's versions, numbering, odd and hot records."""

from __future__ import annotations

import collections
import zlib

from pyspark.sql import functions as F

from deltaloom.llm import sharding

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids int, fp string"


def same_as_sql(df, sql, con, docs=f"SELECT * FROM '{SF}/documents.parquet'"):
    """The rows of a query against DuckDB's."""
    con.sql(f"CREATE VIEW documents AS {docs}")
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def loads(rows, weight="size"):
    out = collections.Counter()
    for r in rows:
        out[r["shard"]] += r[weight]
    return out


def check(rows, docs, shards):
    """Every record once, sizes and digests as of its text, places gapless in each shard."""
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs]
    assert sorted(map(repr, ((r.doc_id, r.size, r.text_crc32) for r in rows))) == sorted(map(repr, want))
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sharding.op12_sharding(spark, SF).collect()
    check(rows, docs, 24)
    sizes = loads(rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_hot_and_odd_records(spark):
    """One record a third of all rows, null ids and texts, copies of a text, one text of a shard's size."""
    docs = [(5, "same" * 20)] * 700 + [(None, None)] * 300 + [(k, "copy" * 30) for k in range(500)] + [(k, "y" * (k % 97)) for k in range(1000, 1600)] + [(1600, "é" * 3000)]
    table = spark.createDataFrame([(i, t, "en", "s", 0, "own", 7, "own") for i, t in docs], DOC).repartition(5).withColumn("shard", F.lit(1)).withColumn("slot", F.lit(1))
    rows, root = sharding.shard(table, shards=6, slots=512)
    rows = rows.collect()
    check(rows, docs, 6)
    sizes = loads(rows)
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in rows)
    maps = [sharding.read_map(spark, root, v).collect() for v in (0, 1)]
    for m in maps:
        assert {r.vslot for r in m} == set(range(512)) and sum(r.bytes for r in m) == sum(r.size for r in rows)
        assert len({(r.vslot, r.part) for r in m}) == len(m)
    assert loads(maps[1], "bytes") == sizes


def test_growth_moves_into_the_new_shard_only(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab', CAST(id % 211 AS INT))").alias("text"))
    _, root = sharding.shard(docs, shards=7, slots=1024)
    old = {(r.vslot, r.part): r for r in sharding.read_map(spark, root, 1).collect()}
    new = sharding.write_map(sharding.grown(sharding.read_map(spark, root, 1), 7), root, 2).collect()
    assert {(r.vslot, r.part) for r in new} == set(old)
    moved = [r for r in new if r.shard != old[r.vslot, r.part].shard]
    assert moved and {r.shard for r in moved} == {7}
    sizes = loads(new, "bytes")
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    again = sharding.write_map(sharding.rebalanced(sharding.read_map(spark, root, 2), 8), root, 3).collect()
    assert sum(r.bytes for r in again) == sum(r.bytes for r in new)
    for rows in (sharding.assigned(sharding.records(docs, 1024), sharding.read_map(spark, root, v)).collect() for v in (1, 3)):
        assert len(rows) == 4000


def test_empty_table_and_stable_slots(spark):
    rows, root = sharding.shard(spark.createDataFrame([], DOC))
    assert rows.isEmpty() and sharding.read_map(spark, root, 1).count() == sharding.SLOTS
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one, two = ({r.doc_id: r.vslot for r in sharding.records(d).collect()} for d in (docs, docs.where("doc_id % 2 = 0").repartition(3)))
    assert all(one[k] == v for k, v in two.items())
