"""Benchmark decontamination by spaced seeds.

A mask fixes some of the words in a short span and ignores the others, so two passages that agree
in the fixed words share a seed hash although words between them were replaced. Seeds of all
benchmark items and of all documents are joined on their hash; each hit names an item and a
diagonal (document position minus item position). Around it the words of both are compared along
the diagonal, and a pair is reported if enough of them agree.

Documents are filtered first by a Bloom filter over the item seeds, of bounded size, so that only
documents with a hit are shuffled. A filter that a very large benchmark fills lets more rows
through to the join and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, cut, pieces
from deltaloom.llm.tokens import mix, word_hashes

#: Six fixed words each, over spans of six to eleven.
MASKS = ("111111", "1101111", "11101011", "110100111", "1100101011", "11001010011")
#: Items of fewer words are no evidence and never match.
MIN_WORDS = 6
#: Words that have to agree (or all of a shorter item), and the share of the compared words that must.
MATCHED = 13
IDENTITY = 0.8
#: Bits of the Bloom filter at least and at most, bits for each seed, and probes.
BLOOM_BITS = (1 << 20, 1 << 27)
BLOOM_SPREAD = 256
PROBES = 3


def seeds(hashes: np.ndarray, offsets: np.ndarray, mask_no: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, seed hashes) of one mask at every place where it fits into a text."""
    mask = MASKS[mask_no]
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, mask_no + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    fits = np.ones(n, bool)
    for end in offsets[1:-1]:
        fits[max(0, end - len(mask) + 1) : end] = False
    at = np.flatnonzero(fits)
    return at, mix(total[at])


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * k)) ^ (h << np.uint64(7 * k))) & np.uint64(bits - 1) for k in range(PROBES)]


def keyed_items(items: DataFrame) -> DataFrame:
    """(item_key, item_id, text): item_key is a hash of id and text, so rows that share an id but not a text are items of their own."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("item_id", "text").alias("item_key"), "*").dropDuplicates(["item_key"])


def item_seeds(keyed: DataFrame) -> DataFrame:
    """(seed, item_key, item_pos): every seed of every keyed item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            hashes, offsets = word_hashes(batch.column("text"))
            for m in range(len(MASKS)):
                at, seed = seeds(hashes, offsets, m)
                of = np.searchsorted(offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column("item_key").take(pa.array(of)), pa.array((at - offsets[of]).astype(np.int32))], ["seed", "item_key", "item_pos"])

    return keyed.select("item_key", "text").mapInArrow(run, "seed bigint, item_key bigint, item_pos int")


def item_words(keyed: DataFrame) -> DataFrame:
    """(item_key, item_id, item): the word hashes of every keyed item, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            hashes, offsets = word_hashes(batch.column("text"))
            words = [hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("item_id"), pa.array(words, pa.binary())], ["item_key", "item_id", "item"])

    return keyed.mapInArrow(run, "item_key bigint, item_id bigint, item binary")


def bloom(seeds_: DataFrame) -> np.ndarray:
    """The filter's bits over column seed. The driver gets at most BLOOM_BITS[1] / 64 distinct words of it."""
    n = seeds_.count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << max(1, n * BLOOM_SPREAD - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column("seed").to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    out = np.zeros(bits // 64, np.uint64)
    for r in seeds_.select("seed").mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toLocalIterator():
        out[r["word"]] = np.uint64(r["bit"] & (1 << 64) - 1)
    return out


def text_digest() -> Column:
    """What names the text of a row: a null text is the empty one."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def hits(docs: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """(row_id, doc_id, text_digest, words, seed, pos): documents with seeds that pass the filter, one row per document.

    seed and pos are arrays. row_id is a hash of id and text: equal rows share it.
    """
    table = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, bits = table.value, len(table.value) * 64
        for batch in pieces(batches, "text", 4 << 20):
            hashes, offsets = word_hashes(batch.column("text"))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for m in range(len(MASKS)):
                at, seed = seeds(hashes, offsets, m)
                for k in range(PROBES):
                    p = _probes(seed, bits)[k]
                    ok = flat[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) > 0
                    at, seed = at[ok], seed[ok]
                found.append((at, seed))
            at, seed = (np.concatenate(x) for x in zip(*found))
            of = np.searchsorted(offsets, at, side="right") - 1
            order = np.argsort(of, kind="stable")
            at, seed, of = at[order], seed[order], of[order]
            docs_, first = np.unique(of, return_index=True)
            ids = batch.column("doc_id").take(pa.array(docs_))
            words = [hashes[offsets[d] : offsets[d + 1]].tobytes() for d in docs_]
            bounds = pa.array(np.r_[first, len(of)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text_digest").take(pa.array(docs_)), pa.array(words, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(seed.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array((at - offsets[of]).astype(np.int32)))],
                ["doc_id", "text_digest", "words", "seed", "pos"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("text_digest"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id bigint, text_digest string, words binary, seed array<bigint>, pos array<int>")
    return found.select(F.xxhash64("doc_id", "text_digest").alias("row_id"), "*")


def aligned(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """The best segment of an item on a diagonal of a document: (first word in the document, words, matched).

    All that both have on the diagonal counts if IDENTITY of it agrees; else, of the segments of
    which IDENTITY agrees, one with the most matches, without mismatches at its ends.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    need = min(MATCHED, len(item))
    if len(same) == len(item) and same.sum() >= max(IDENTITY * len(same), min(need, IDENTITY * len(item))):
        return lo + diagonal, len(same), int(same.sum())
    # IDENTITY of a segment agrees if its sum of 1 per match and -cost per mismatch is not negative
    cost = round(IDENTITY / (1 - IDENTITY), 6)
    sums, matches = np.r_[0, np.cumsum(np.where(same, 1.0, -cost))], np.r_[0, np.cumsum(same)]
    # for each end the first start from which the sum is not negative
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(matches - matches[starts]))
    hits = np.flatnonzero(same[starts[end] : end]) + starts[end]
    return (lo + diagonal + int(hits[0]), int(hits[-1] - hits[0]) + 1, len(hits)) if len(hits) >= need else None


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_digest, item_id, doc_pos, n_words, n_matched, item_words), one row per text of a document and text of an item that overlap.

    What names candidates are keys and diagonals; the words of both sides join them once they are
    one row per pair.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = cut(keyed_items(items), "items")
    item = cut(item_seeds(keyed), "item-seeds")
    found = cut(hits(docs, bloom(item)), "seed-hits")
    flat = found.select("row_id", F.explode(F.arrays_zip("seed", "pos")).alias("h")).select("row_id", F.col("h.seed").alias("seed"), F.col("h.pos").alias("pos"))
    pairs = flat.join(item, "seed").select("row_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    lined = pairs.groupBy("row_id", "item_key").agg(F.collect_list("diagonal").alias("diagonals"))
    whole = lined.join(item_words(keyed), "item_key").join(found.dropDuplicates(["row_id"]).select("row_id", "doc_id", "text_digest", "words"), "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, digest, item_id, words, own, diagonals in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_digest", "item_id", "words", "item", "diagonals")), strict=True):
                doc, item_ = np.frombuffer(words, np.uint64), np.frombuffer(own, np.uint64)
                best = max((x for d in diagonals if (x := aligned(doc, item_, d))), key=lambda x: (x[2], -x[0]), default=None)
                if best:
                    out.append((doc_id, digest, item_id, *best, len(item_)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_digest", "item_id", "doc_pos", "n_words", "n_matched", "item_words"])

    return whole.select("doc_id", "text_digest", "item_id", "words", "item", "diagonals").mapInArrow(run, "doc_id bigint, text_digest string, item_id bigint, doc_pos int, n_words int, n_matched int, item_words int")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_pos, n_words, n_matched, item_words), one row per document and item that overlap.

    Words are lower-cased in A-Z and split at ASCII white space. A pair overlaps if along one
    diagonal at least MATCHED words agree (all compared words of a shorter item, IDENTITY of them),
    and IDENTITY of the segment's words do. Null texts are empty; rows without an id and items of
    fewer than MIN_WORDS words never match. Rows that share an id, of documents or items, are
    compared text by text and reported once, by their best overlap. Items and documents may be of
    any length.
    """
    best = F.max_by(F.struct("doc_pos", "n_words", "n_matched", "item_words"), F.struct("n_matched", -F.col("doc_pos"), "n_words", "item_words"))
    return overlaps(docs, items).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.doc_pos", "b.n_words", "b.n_matched", "b.item_words")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap, as contaminated() has them."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
