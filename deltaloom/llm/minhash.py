"""Near-duplicate texts by the similarity of their five-word shingles.

Candidates come from two sources: MinHash bands over the shingles, and links of SimHash
fingerprints. Texts whose shares of common shingles are SIMILAR agree in at least one of BANDS bands
of ROWS minimum hashes with probability 1 - (1 - SIMILAR^ROWS)^BANDS, which is 0.99995. Every
candidate pair is decided on both whole sets of shingles, whichever source named it and however long
its texts are: only a miss of all bands can lose a link, and nothing but similarity makes one.

A link between fingerprints, or an equal one, names the pair of its first texts alone: the texts of a
SimHash component can be as unlike as many, and its links are few.

Buckets of the same texts are one bucket. A bucket of more than BLOCK texts is dealt to pairs of
blocks, so that no task holds more than two blocks of one. A text is compared only with those that
no link has reached yet, so a bucket of like texts takes one pass over its sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, cut, pieces
from deltaloom.llm.components import connected_components
from deltaloom.llm.simhash import SIMILAR, SIMILAR_SHINGLE, _shingle_hashes, _unite, _whole_shards, fingerprint, links
from deltaloom.llm.tokens import mix

BANDS = 25
ROWS = 5
#: Texts of a bucket that one block holds.
BLOCK = 1024
#: Shingles that are hashed at a time.
STEP = 4096

_XOR, _MUL = (np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, :, None]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, sorted; a shorter text is one shingle."""
    return np.unique(_shingle_hashes(text, SIMILAR_SHINGLE).view(">u8").ravel().astype(np.uint64))


def text_digest(text: str | None) -> bytes:
    """128 bits that name the words of a text."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8", "replace").lower().split()))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key per band; none for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), STEP):
        least = np.minimum(least, ((shingles[None, k : k + STEP] ^ _XOR) * _MUL).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + row)
    return keys.view(np.int64)


def similar_stars(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that links of SIMILAR pairs reach from it."""
    star, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    own = np.flatnonzero(sizes)
    if len(own) < 2:
        return star
    full = [sets[i] for i in own]
    sizes, near = sizes[own], np.arange(len(own))
    uniq, flat = np.unique(np.concatenate(full), return_inverse=True)
    at, flag = np.r_[0, np.cumsum(sizes)], np.zeros(len(uniq), bool)
    for i in range(len(own) - 1):
        apart = near[i + 1 :] != near[i]
        if not apart.any():
            continue
        mine = flat[at[i] : at[i + 1]]
        flag[mine] = True
        shared = np.add.reduceat(flag[flat[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
        flag[mine] = False
        alike = np.flatnonzero(apart & (shared / (sizes[i] + sizes[i + 1 :] - shared) >= SIMILAR)) + i + 1
        near = _unite(near, np.full(len(alike), i), alike)
    star[own] = own[near]
    return star


def candidate_shards(nodes: DataFrame) -> DataFrame:
    """(shard, fp), written: texts `fp` that are compared with each other, one shard a task; nodes are (node, fp, bands).

    Equal fingerprints and links name pairs with the first text of a fingerprint, never whole
    components: as many as there are texts and links.
    """
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    near = links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select("x", "y")
    by_print = same.unionByName(near).select(F.xxhash64(F.lit("fp"), F.least("x", "y"), F.greatest("x", "y")).alias("key"), F.explode(F.array("x", "y")).alias("node")).distinct()
    members = cut(nodes.select("node", F.explode("bands").alias("key")).unionByName(by_print), "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("who")).where("n > 1")
    chosen = sizes.groupBy("n", "who").agg(F.min("key").alias("key"))
    dealt = members.join(chosen, "key").withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    dealt = dealt.select("node", "key", F.expr("pmod(xxhash64(node), blocks)").alias("b"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("c"))
    return cut(dealt.select(F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c")).alias("shard"), F.col("node").alias("fp")), "met")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, group, component_id) per row of docs (doc_id, text, row), ids not null.

    Two texts link if at least SIMILAR of the five-word shingles of both are shared; equal words,
    in lower case (A-Z), always link. component_id is the smallest doc_id that links reach, group
    names the component itself, as rows of one id can lie in several. row is a bigint that the
    caller tells rows apart by; other columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "row", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = batch.column("text").to_pylist()
            prints = np.array([fingerprint(t) for t in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([text_digest(t) for t in rows], pa.binary()), pa.array(prints), pa.array([bands(shingle_set(t)) for t in rows], pa.list_(pa.int64()))], ["doc_id", "row", "digest", "fp", "bands"])

    rows = cut(texts.mapInArrow(named, "doc_id bigint, row bigint, digest binary, fp bigint, bands array<bigint>"), "named")
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id()), "nodes")

    met = candidate_shards(nodes)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            mine = [text_digest(t) == d for t, d in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist(), strict=True)]
            own = batch.filter(pa.array(mine, pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column("fp"), pa.array([shingle_set(t).tobytes() for t in own.column("text").to_pylist()], pa.binary())], ["fp", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, node, held in _whole_shards(batches):
            sets = [np.frombuffer(x, np.uint64) for x in held.column("shingles").to_pylist()]
            edge = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
            star = np.concatenate([similar_stars(sets[a:b]) + a for a, b in zip(edge, edge[1:])])
            moved = star != np.arange(len(star))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (node[moved], node[star[moved]])], ["a", "b"])

    bounded_batches(spark)
    wanted = met.select("fp").distinct().join(nodes.select(F.col("node").alias("fp"), "digest", F.col("least").alias("doc_id")), "fp")
    found = texts.join(cut(wanted, "wanted"), "doc_id").select("fp", "digest", "text").mapInArrow(sets_of, "fp bigint, shingles binary")
    sets = cut(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")
    sorted_ = met.join(sets, "fp").select("shard", "fp", "shingles").repartition("shard").sortWithinPartitions("shard", "fp")
    edges = cut(sorted_.mapInArrow(compared, "a bigint, b bigint"), "similar")

    rooted = cut(nodes.select("digest", "least", "node").join(connected_components(edges), "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "row", "digest").join(rooted.join(component, "root").select("digest", F.col("root").alias("group"), "component_id"), "digest").drop("digest")
