"""Text scoring by an interpolated modified Kneser-Ney trigram model in memory-mapped hash arrays.

Counting runs in Spark, an exchange for each order and one for the continuation counts of each lower
order. Map tasks count the n-grams of their texts in numpy and send each bucket sorted arrays of keys
with counts, so frequent keys are merged before they are shuffled. A reduce task merges its bucket
and writes it as raw sorted arrays into a model folder on the shared file system:

* words: the sorted 64-bit hashes; a word's number is its rank. For each number its count and the
  number of distinct words before it.
* bigrams: sorted keys, number of the first word times 2^32 plus that of the second, with counts and
  the number of distinct words before the bigram. A bigram's number is its rank.
* trigrams: for each bigram's number the sorted numbers of the words that follow it, with counts.
  They lie in shards of about SHARD_TOKENS, so that bigrams of one frequent first word part.

The lower orders are of continuation counts: what counts for a bigram is before how many distinct
words it stands, or its count at the start of a text; the same for words. The first token of a text
has only the text's start before it and is scored by bigrams.

Scoring tasks map those files and look n-grams up by binary search. Only the buckets' sizes and
counts of counts reach the driver. The model folder has to be a path that executors can map, in the
file system that spark.checkpoint.dir names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, crc_mod, new_path, pieces, release, remove
from deltaloom.llm.tokens import word_hashes

FOLDS = 10
#: Bytes of text in a bucket, about, and buckets at most.
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 15
#: Trigrams of a shard, about, repeats included.
SHARD_TOKENS = 3 << 20
#: The hash of the end of a text, which is also what its first word follows.
END = np.uint64(0x5DEECE66D1F3A9B7)
#: Bytes of text that a worker turns into arrays at a time, and keys that it merges at a time.
STEP = 4 << 20
MERGE = 2_000_000
_PAIR = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def words_and_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's words, then one end."""
    hashes, offsets = word_hashes(texts)
    n = len(texts)
    out = np.full(len(hashes) + n, END, np.uint64)
    at = offsets + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[at[1:] - 1] = False
    out[keep] = hashes
    return out, at


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted integers as differences, byte by byte of equal weight, compressed."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    return len(gaps).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def _deal(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has keys; bounds are the buckets' first keys."""
    cut = np.searchsorted(keys, bounds[1:])
    for b, (lo, hi) in enumerate(zip(np.r_[0, cut], np.r_[cut, len(keys)])):
        if hi > lo:
            yield _row(b, keys[lo:hi], counts[lo:hi])


def _row(bucket: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([_squeeze(keys)], pa.binary()), pa.array([pa.compress(counts.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)], pa.binary())], schema=_PAIR)


def _counted(texts: Iterator[pa.RecordBatch], keys_of: Callable[[pa.Array], np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts the keys of a task's texts; sorted arrays go out once there are MERGE distinct keys."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    fresh = 0
    for batch in pieces(texts, "text", STEP):
        keys, counts = np.unique(keys_of(batch.column("text")), return_counts=True)
        parts.append((keys, counts))
        fresh += len(keys)
        if fresh > MERGE:
            parts = [_merge(parts)]
            fresh = 0
            if len(parts[0][0]) > MERGE:
                yield from _deal(*parts[0], bounds)
                parts = []
    if parts:
        yield from _deal(*_merge(parts), bounds)


def _gather(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The merged keys and counts of one bucket."""
    merged = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for keys, counts in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        k = _unsqueeze(keys)
        waiting.append((k, np.frombuffer(pa.decompress(counts, 4 * len(k), codec="zstd", asbytes=True), np.uint32).astype(np.int64)))
        if sum(len(c) for _, c in waiting) > MERGE:
            merged, waiting = _merge([merged, *waiting]), []
    return _merge([merged, *waiting])


def _save(path: str, array: np.ndarray) -> None:
    """Writes a file at once: a second attempt of the task replaces it by the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, path)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2, and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.99, 1.99, 2.99])


@dataclass
class Model:
    """Where the arrays lie, the first number of each bucket's words, of its bigrams and of each shard's bigrams, and the totals."""

    folder: str
    buckets: int
    first: np.ndarray
    pair_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    shard_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    tokens: int = 0
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((4, 4)))
    lower_back: float = 1.0
    end: int = -1

    def __post_init__(self) -> None:
        self.maps: dict[tuple[str, int], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    @property
    def words(self) -> int:
        return int(self.first[-1])

    @property
    def pairs(self) -> int:
        return int(self.pair_first[-1])

    def map(self, kind: str, bucket: int, dtype: type) -> np.ndarray:
        """One array of a bucket, mapped; an absent or empty one has no entries."""
        found = self.maps.get((kind, bucket))
        if found is None:
            path = f"{self.folder}/{kind}-{bucket}"
            found = np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
            self.maps[kind, bucket] = found
        return found

    def hash_bounds(self) -> np.ndarray:
        """The smallest hash of each bucket of words."""
        return np.array([b * (1 << 64) // self.buckets for b in range(self.buckets)], np.uint64)

    def pair_bounds(self) -> np.ndarray:
        """The smallest key of each bucket of bigrams."""
        return self.first[:-1].astype(np.uint64) << np.uint64(32)

    def _numbers(self, kind: str, keys: np.ndarray, bounds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of each key in the sorted arrays of all buckets, -1 if it is unknown."""
        uniq, of = np.unique(keys, return_inverse=True)
        out = np.full(len(uniq), -1, np.int64)
        cut = np.r_[0, np.searchsorted(uniq, bounds[1:]), len(uniq)]
        for b in np.flatnonzero(np.diff(cut)):
            known, mine = self.map(kind, b, np.uint64), uniq[cut[b] : cut[b + 1]]
            if len(known):
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                out[cut[b] : cut[b + 1]] = np.where(known[at] == mine, at + first[b], -1)
        return out[of]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for an unknown word."""
        return self._numbers("hash", hashes, self.hash_bounds(), self.first)

    def pair_numbers(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each bigram, -1 for an unknown one."""
        known = (before >= 0) & (word >= 0)
        out = np.full(len(word), -1, np.int64)
        out[known] = self._numbers("pair", before[known].astype(np.uint64) << np.uint64(32) | word[known].astype(np.uint64), self.pair_bounds(), self.pair_first)
        return out

    def values(self, kind: str, numbers: np.ndarray, dtype: type, first: np.ndarray | None = None) -> np.ndarray:
        """Each number's entry in one of the arrays of words, or of what `first` numbers; 0 for -1."""
        first = self.first if first is None else first
        uniq, of = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(uniq), np.float64 if dtype == np.float32 else np.int64)
        cut = np.r_[np.searchsorted(uniq, first[:-1]), len(uniq)]
        for b in np.flatnonzero(np.diff(cut)):
            held = self.map(kind, b, dtype)
            if len(held):
                out[cut[b] : cut[b + 1]] = held[uniq[cut[b] : cut[b + 1]] - first[b]]
        return out[of]

    def pair_counts(self, numbers: np.ndarray) -> np.ndarray:
        """The count of each bigram number, 0 for -1."""
        out = self.values("pair_count", numbers, np.uint8, self.pair_first)
        big = np.flatnonzero(out == 255)
        of = np.searchsorted(self.pair_first, numbers[big], side="right") - 1
        for b in np.unique(of):
            mine = big[of == b]
            out[mine] = self.map("many_count", b, np.int64)[np.searchsorted(self.map("many", b, np.int64), numbers[mine] - self.pair_first[b])]
        return out

    def triple_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The count of each trigram, of a bigram's number and a word's; 0 if it is unknown."""
        out = np.zeros(len(word), np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        known = known[np.argsort(context[known], kind="stable")]
        cut = np.r_[np.searchsorted(context[known], self.shard_first[:-1]), len(known)]
        for t in np.flatnonzero(np.diff(cut)):
            mine = known[cut[t] : cut[t + 1]]
            start, words = self.map("triple_start", t, np.uint32), self.map("triple_word", t, np.uint32)
            at = context[mine] - self.shard_first[t]
            lo, end, want = start[at].astype(np.int64), start[at + 1].astype(np.int64), word[mine]
            hi = end.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                less = words[mid] < want[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            hit = np.flatnonzero(lo < end)
            hit = hit[words[lo[hit]] == want[hit]]
            count = self.map("triple_count", t, np.uint8)[lo[hit]].astype(np.int64)
            big = count == 255
            if big.any():
                count[big] = self.map("triple_many_count", t, np.int64)[np.searchsorted(self.map("triple_many", t, np.int64), lo[hit][big])]
            out[mine[hit]] = count
        return out

    def prob(self, before: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The probability of each word (a number or -1), where `before` precedes it; a text begins at each of `starts`."""
        n = self.values("before", word, np.uint32)
        lower = (n - self.discounts[1][np.minimum(n, 3)]) / max(1, self.pairs) + self.lower_back / (self.words + 1)
        lower = np.where(n > 0, lower, self.lower_back / (self.words + 1))
        pair = self.pair_numbers(before, word)
        follow = self.values("follow", before, np.uint64).astype(np.float64)
        kinds = np.stack([self.values(f"follow{k}", before, np.uint32) for k in (1, 2, 3)])
        count, safe = self.values("adjusted", pair, np.uint32, self.pair_first), np.maximum(follow, 1)
        second = np.where(follow > 0, (count - self.discounts[2][np.minimum(count, 3)]) / safe + (self.discounts[2][1:] @ kinds) / safe * lower, lower)
        context = np.r_[-1, pair[:-1]]
        context[starts] = -1
        total = self.pair_counts(context)
        count, safe = self.triple_counts(context, word), np.maximum(total, 1)
        back = self.values("back", context, np.float32, self.pair_first)
        return np.where(total > 0, (count - self.discounts[3][np.minimum(count, 3)]) / safe + back * second, second)


def _pairs(hashes: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(before, word): numbers of each token and of what it follows."""
    word = model.ranks(hashes)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    if len(offsets) > 1:
        before[offsets[:-1]] = word[-1]
    return before, word


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model has to be mapped: spark.checkpoint.dir must be a shared file: folder, not {path}")
    return at.path


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, 3 or more, and how many there are."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum()), len(counts)]


def _summed(rows: DataFrame) -> list[int]:
    """The sum of each place of the arrays in column kinds."""
    return list(rows.where("kinds IS NOT NULL").agg(*(F.coalesce(F.sum(F.col("kinds")[k]), F.lit(0)) for k in range(6))).first())


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Counts the texts of docs into a model folder. Null texts are empty; each text ends in one end token."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = _local(folder or new_path(spark, "lm"))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    model = Model(folder, int(min(MAX_BUCKETS, max(1, -(-size // BUCKET_BYTES)))), np.zeros(1, np.int64))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, lambda t: words_and_ends(t)[0], model.hash_bounds())

    def save_words(key: tuple, rows: pa.Table) -> pa.Table:
        os.makedirs(folder, exist_ok=True)
        keys, counts = _gather(rows)
        _save(f"{folder}/hash-{key[0].as_py()}", keys)
        _save(f"{folder}/count-{key[0].as_py()}", counts.astype(np.uint64))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    found = texts.mapInArrow(count_words, _DDL).groupBy("bucket").applyInArrow(save_words, "bucket int, words bigint, tokens bigint").collect()
    sizes = np.zeros(model.buckets, np.int64)
    for r in found:
        sizes[r["bucket"]] = r["words"]
    model.first, model.tokens = np.r_[0, np.cumsum(sizes)], sum(r["tokens"] for r in found)
    if model.words >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    if not model.words:
        return model
    model.end = int(model.ranks(np.array([END]))[0])
    release(spark)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(t: pa.Array) -> np.ndarray:
            before, word = _pairs(*words_and_ends(t), model)
            return before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)

        yield from _counted(batches, keys, model.pair_bounds())

    def save_pairs(key: tuple, rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, counts = _gather(rows)
        _save(f"{folder}/pair-{b}", keys)
        _save(f"{folder}/pair_count-{b}", np.minimum(counts, 255).astype(np.uint8))
        many = np.flatnonzero(counts >= 255)
        _save(f"{folder}/many-{b}", many)
        _save(f"{folder}/many_count-{b}", counts[many])
        after, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        dealt = pa.Table.from_batches(_deal(after, before, model.first[:-1].astype(np.uint64)), _PAIR)
        # a shard ends where SHARD_TOKENS trigrams of the bucket are full
        shard = (np.cumsum(counts) - counts) // SHARD_TOKENS
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        rest = [None] * (dealt.num_rows - 1)
        dealt = dealt.append_column("of", pa.array([b, *rest], pa.int32()))
        return dealt.append_column("shards", pa.array([[*starts.tolist(), len(keys)], *rest], pa.list_(pa.int64())))

    pairs_path = new_path(spark, "lm-pairs")
    ddl = _DDL + ", of int, shards array<bigint>"
    texts.mapInArrow(count_pairs, _DDL).groupBy("bucket").applyInArrow(save_pairs, ddl).write.parquet(pairs_path)
    pairs = spark.read.schema(ddl).parquet(pairs_path)
    shards = {r["of"]: r["shards"] for r in pairs.where("of IS NOT NULL").select("of", "shards").toLocalIterator()}
    model.pair_first = np.r_[0, np.cumsum([shards[b][-1] if b in shards else 0 for b in range(model.buckets)])].astype(np.int64)
    model.shard_first = np.array([model.pair_first[b] + x for b in sorted(shards) for x in shards[b][:-1]] + [model.pair_first[-1]], np.int64)
    release(spark)

    def save_before(key: tuple, rows: pa.Table) -> pa.Table:
        b = key[0].as_py()
        keys, counts = _gather(rows)
        out = np.zeros(int(sizes[b]), np.uint32)
        out[keys.astype(np.int64) - model.first[b]] = counts
        _save(f"{folder}/before-{b}", out)
        return pa.table({"kinds": pa.array([_counts_of_counts(counts)], pa.list_(pa.int64()))})

    kinds = _summed(pairs.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(save_before, "kinds array<bigint>"))
    model.discounts[1] = _discounts(kinds[:4])
    model.lower_back = float(model.discounts[1][1] * kinds[0] + model.discounts[1][2] * kinds[1] + model.discounts[1][3] * kinds[4]) / model.pairs
    remove(spark, pairs_path)
    release(spark)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in pieces(batches, "text", STEP):
            hashes, offsets = words_and_ends(batch.column("text"))
            before, word = _pairs(hashes, offsets, model)
            context = np.r_[-1, model.pair_numbers(before, word)[:-1]]
            context[offsets[:-1]] = -1
            own = context >= 0
            shard = np.searchsorted(model.shard_first, context[own], side="right") - 1
            waiting.append((shard, (context[own] - model.shard_first[shard]).astype(np.uint64) << np.uint64(32) | word[own].astype(np.uint64)))
            if sum(len(x) for x, _ in waiting) > MERGE:
                yield from triples(waiting)
                waiting = []
        if waiting:
            yield from triples(waiting)

    def triples(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shard, keys = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(shard, kind="stable")
        own, first = np.unique(shard[order], return_index=True)
        for t, lo, hi in zip(own.tolist(), first, np.r_[first[1:], len(order)]):
            mine, counts = np.unique(keys[order[lo:hi]], return_counts=True)
            yield _row(t, mine, counts)

    def save_triples(key: tuple, rows: pa.Table) -> pa.Table:
        t = key[0].as_py()
        keys, counts = _gather(rows)
        at, word = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        n = int(model.shard_first[t + 1] - model.shard_first[t])
        _save(f"{folder}/triple_start-{t}", np.searchsorted(at, np.arange(n + 1)).astype(np.uint32))
        _save(f"{folder}/triple_word-{t}", word.astype(np.uint32))
        _save(f"{folder}/triple_count-{t}", np.minimum(counts, 255).astype(np.uint8))
        many = np.flatnonzero(counts >= 255)
        _save(f"{folder}/triple_many-{t}", many)
        _save(f"{folder}/triple_many_count-{t}", counts[many])
        b = int(np.searchsorted(model.pair_first, model.shard_first[t], side="right")) - 1
        second = model.map("pair", b, np.uint64)[at + (model.shard_first[t] - model.pair_first[b])] & np.uint64(0xFFFFFFFF)
        after, before = np.unique(second << np.uint64(32) | word, return_counts=True)
        dealt = pa.Table.from_batches(_deal(after, before, model.pair_bounds()), _PAIR)
        return dealt.append_column("kinds", pa.array([_counts_of_counts(counts)] + [None] * (dealt.num_rows - 1), pa.list_(pa.int64())))

    triples_path = new_path(spark, "lm-triples")
    ddl = _DDL + ", kinds array<bigint>"
    texts.mapInArrow(count_triples, _DDL).groupBy("bucket").applyInArrow(save_triples, ddl).write.parquet(triples_path)
    found = spark.read.schema(ddl).parquet(triples_path)
    model.discounts[3] = _discounts(_summed(found)[:4])
    release(spark)

    def save_adjusted(key: tuple, rows: pa.Table) -> pa.Table:
        """What counts for the bigrams of a bucket, the sums over what follows a word, and the weight of the lower order after each bigram."""
        b = key[0].as_py()
        pair, raw = model.map("pair", b, np.uint64), model.pair_counts(np.arange(model.pair_first[b], model.pair_first[b + 1]))
        keys, counts = _gather(rows.filter(pyarrow.compute.is_valid(rows.column("keys"))))
        of = (pair >> np.uint64(32)).astype(np.int64)
        adjusted = np.where(of == model.end, raw, 0)
        at = np.searchsorted(pair, keys)
        adjusted[at] = np.where(of[at] == model.end, raw[at], counts)
        _save(f"{folder}/adjusted-{b}", adjusted.astype(np.uint32))
        of, n = of - model.first[b], int(sizes[b])
        _save(f"{folder}/follow-{b}", np.bincount(of, adjusted, minlength=n).astype(np.uint64))
        for k in (1, 2, 3):
            _save(f"{folder}/follow{k}-{b}", np.bincount(of[np.minimum(adjusted, 3) == k], minlength=n).astype(np.uint32))
        back, lo = np.zeros(len(pair), np.float32), int(np.searchsorted(model.shard_first, model.pair_first[b]))
        for t in range(lo, int(np.searchsorted(model.shard_first, model.pair_first[b + 1]))):
            start = model.map("triple_start", t, np.uint32).astype(np.int64)
            if not len(start):
                continue
            kind = np.minimum(model.map("triple_count", t, np.uint8), 3)
            sums = np.r_[0, np.cumsum(model.discounts[3][kind])]
            mine = slice(int(model.shard_first[t] - model.pair_first[b]), int(model.shard_first[t] - model.pair_first[b]) + len(start) - 1)
            back[mine] = (sums[start[1:]] - sums[start[:-1]]) / np.maximum(raw[mine], 1)
        _save(f"{folder}/back-{b}", back)
        return pa.table({"kinds": pa.array([_counts_of_counts(adjusted)], pa.list_(pa.int64()))})

    every = spark.range(model.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    saved = found.select("bucket", "keys", "counts").unionByName(every).groupBy("bucket").applyInArrow(save_adjusted, "kinds array<bigint>")
    model.discounts[2] = _discounts(_summed(saved)[:4])
    remove(spark, triples_path)
    release(spark)
    return model


_DDL = "bucket int, keys binary, counts binary"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of docs; scores are log10 of whole texts.

    base_score adds 0.1 to every word's count; score is the model's. An empty or null text is one end.
    """
    bounded_batches(docs.sparkSession)
    norm = model.tokens + 0.1 * (model.words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", STEP):
            hashes, offsets = words_and_ends(batch.column("text"))
            before, word = _pairs(hashes, offsets, model)
            count = model.values("count", word, np.uint64)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            sums = [np.bincount(of, np.log10(x), minlength=batch.num_rows) for x in ((count + 0.1) / norm, model.prob(before, word, offsets[:-1]))]
            known = np.bincount(of, count > 0, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(known), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by a model of those outside the held-out fold.

    Null and empty texts are one end token; repeated rows count and are scored each; a null doc_id
    counts as the text '' for the fold. Without training texts every score is that of one class.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_mod("doc_id", FOLDS)
    model = train(docs.where(f"{fold} <> 0"))
    scored = score(docs, model)
    return scored.select("doc_id", F.expr(f"{fold} = 0").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
