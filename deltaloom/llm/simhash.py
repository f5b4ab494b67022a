"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Two fingerprints within `radius` bits agree on one of radius + 1 bit blocks at least, so each link
lies within a shard of those that agree on the first bits of a block. Shards share as few bits as
leave about SHARD_NODES / 4 fingerprints to each. One with more than SHARD_NODES, as near copies make
them, is split by blocks of its remaining free bits, radius + 1 of them, one of which must agree; that
ends where the free bits alone bound a shard at 2^LAST_BITS fingerprints. So no shard grows with the
corpus, and no link is lost.

Each shard holds a BK-tree: a child hangs on its parent at the integer Hamming distance between
them, and a search follows only the edges within radius of its own distance to the node. Trees are
sent to their queries by shuffle, since together they grow with the corpus. A shard reports its
links as stars, one row per fingerprint, never as pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, cut, cut_at, pieces, remove
from deltaloom.llm.components import connected_components

SEED = 42
#: Words of a shingle, and differing bits up to which two fingerprints link.
SHINGLE = 3
RADIUS = 2
#: A shard with more fingerprints is split again, unless its free bits bound it.
SHARD_NODES = 2048
LAST_BITS = 11
#: Similarity of two sets of shingles of so many words, from which their texts link.
SIMILAR_SHINGLE = 5
SIMILAR = 0.8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The bytes of each shingle's hash, high byte first: one row per shingle, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(shingle, len(words))
    slices = [joined[a : b - 1] for a, b in zip(ends, ends[width:])]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, slices, repeat(SEED))), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned; 0 for a text without words."""
    hashes = _shingle_hashes(text, shingle)
    counts = np.zeros(2048, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[k : k + (1 << 16)] + _BYTE).ravel(), minlength=2048)
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row: fp is the fingerprint as a signed bigint. A null text has none of its words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _signed_array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def bk_edges(shard: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of many shards at once; rows of a shard are adjacent and its first row is the root.

    Returns the sorted keys parent * 65 + distance and the child on each: one child per key.
    """
    n = len(fps)
    node = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    left, keys, children = np.flatnonzero(node != np.arange(n)), [], []
    while left.size:
        at = node[left] * 65 + np.bitwise_count(fps[left] ^ fps[node[left]])
        key, first, of = np.unique(at, return_index=True, return_inverse=True)
        keys.append(key)
        children.append(left[first])
        node[left] = left[first][of]
        left = left[node[left] != left]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def bk_search(queries: np.ndarray, root: np.ndarray, fps: np.ndarray, keys: np.ndarray, children: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within radius; level by level, only along edges within radius of the distance."""
    q, node = queries, root[queries]
    while q.size:
        d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
        near = (d <= radius) & (node != q)
        yield q[near], node[near]
        lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 1))
        n = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right") - lo
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, node = np.repeat(q, n), children[np.repeat(lo, n) + step]


def _unite(star: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """star with the stars of each pair's ends made one."""
    while a.size:
        x, y = star[a], star[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if a.size:
            least = np.minimum(x, y)
            np.minimum.at(star, x, least)
            np.minimum.at(star, y, least)
            while (star[star] != star).any():
                star = star[star]
    return star


def shard_stars(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its shard that links reach from it; rows of a shard are adjacent."""
    n = len(fps)
    root = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    keys, children = bk_edges(shard, fps)
    star = np.arange(n)
    largest = int(np.bincount(root).max())
    step = max(64, (1 << 20) // largest)
    for k in range(0, n, step):
        for a, b in bk_search(np.arange(k, min(n, k + step)), root, fps, keys, children, radius):
            star = _unite(star, a, b)
    return star


def _masks(bits: list[int], parts: int) -> list[int]:
    return [sum(1 << b for b in x.tolist()) for x in np.array_split(np.array(bits), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


Path = tuple[int, int, int]


def first_paths(radius: int, total: int) -> list[Path]:
    """(path, -1, mask of the bits that its shards share): the first bits of each of radius + 1 blocks, for so many fingerprints."""
    bits = max(0, (4 * total // SHARD_NODES).bit_length())
    blocks = _masks(list(range(64)), radius + 1)
    masks = {sum(1 << b for b in [b for b in range(64) if m >> b & 1][:bits]) for m in blocks}
    return [(i, -1, m) for i, m in enumerate(sorted(masks))]


def next_paths(paths: list[Path], crowded: set[int], radius: int) -> list[Path]:
    """(path, parent path, mask): the crowded paths with one of radius + 1 blocks of their free bits."""
    below = [(p, m | part) for p, _, m in paths if p in crowded for part in _masks([b for b in range(64) if not m >> b & 1], radius + 1)]
    return [(i, p, m) for i, (p, m) in enumerate(below)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): star edges between distinct fingerprints (column fp) that connect all within radius."""
    spark, out, paths = fps.sparkSession, None, first_paths(radius, fps.count())
    bounded_batches(spark, 50_000)
    entries, used = fps.select("fp", F.lit(-1).alias("parent")), None
    while True:
        named = spark.createDataFrame([(i, p, _signed(m)) for i, p, m in paths], "path int, parent int, mask bigint")
        keyed = entries.join(F.broadcast(named), "parent").select("fp", "path", F.xxhash64("path", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
        sizes = keyed.groupBy("path", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized, sized_path = cut_at(keyed.join(sizes, ["path", "shard"]), "sized")
        last = all(64 - m.bit_count() <= LAST_BITS for _, _, m in paths)
        small = sized if last else sized.where(F.col("n") <= SHARD_NODES)
        found = cut(_stars(small, radius), "stars")
        out = found if out is None else out.unionByName(found)
        if used:
            remove(spark, used)
        # as many as there are paths, at most
        crowded = set() if last else {r["path"] for r in sized.where(F.col("n") > SHARD_NODES).select("path").distinct().collect()}
        if not crowded:
            remove(spark, sized_path)
            return out
        paths = next_paths(paths, crowded, radius)
        entries, used = sized.where(F.col("n") > SHARD_NODES).select("fp", F.col("path").alias("parent")), sized_path


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(shard, fps, rows) of sorted rows, cut between shards."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
        if held is None or not held.num_rows:
            continue
        shard = held.column("shard").to_numpy()
        whole = len(shard) if batch is None else int(np.searchsorted(shard, shard[-1]))
        if whole:
            yield shard[:whole], held.column("fp").to_numpy()[:whole].view(np.uint64), held.slice(0, whole)
        held = held.slice(whole)


def _signed_array(fps: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(fps).view(np.int64))


def _stars(shards: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fps, _ in _whole_shards(batches):
            star = shard_stars(shard, fps, radius)
            moved = star != np.arange(len(star))
            yield pa.RecordBatch.from_arrays([_signed_array(fps[moved]), _signed_array(fps[star[moved]])], ["a", "b"])

    dealt = shards.select("shard", "fp").repartition("shard")
    return dealt.sortWithinPartitions("shard", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs (doc_id, text; other columns are left out).

    Texts are lower-cased (A-Z) and split at ASCII white space; a text shorter than a shingle is one
    shingle, and one without words, null or empty, has fingerprint zero and links like any other.
    component_id is the smallest doc_id that links reach. Equal fingerprints meet before the search,
    so a group of copies is one node. Repeated ids keep their rows; a null id never becomes a
    component_id unless all of its component are null.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return _named(prints, nodes, links(nodes.select("fp"), radius))


def _named(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each row of prints with the smallest doc_id of its fingerprint's component."""
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    rooted = cut(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(component, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint, component_id, as near_duplicates() has them."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
