"""Exact removal of repeated strings by a distributed difference-cover suffix array.

A byte goes if a string that covers it starts anywhere else too. Strings are of WIDTH bytes; with
`words`, those of so many words, from the start of one to the end of another, are looked for in the
same run. Sorting the suffixes at every byte would move each byte many times over, so suffixes are
sorted where the content itself says: texts are cut into phrases at local minima of a hash of the
next bytes. Equal strings hold the same cuts but for a margin at each end, and so the same phrases.

1. Phrases that occur once can't lie inside a repeated string; what stays are runs of repeated ones.
2. Difference cover modulo 3: at positions 1 and 2 of each run the triples of phrases are sorted
   and named by their rank; the names' own triples are sorted and named again, so that a name ranks
   a suffix by DEPTH phrases. Any two suffixes reach such a position together within two steps:
   three sorted orders, by name alone, by phrase and name, by two phrases and name, merge the
   remaining suffixes with the sampled ones.
3. In each order neighbours' prefixes are compared: the longest prefix, in phrases, that a suffix
   shares with any other, up to DEPTH. The orders are cut into ranges of all their keys, so that a
   phrase with which many suffixes begin lies in many tasks; the rows at the borders are compared
   once more.
4. Those lengths settle nearly all strings: repeated for sure where shared phrases span them, unique
   where a phrase inside is not shared. Strings between, at the ends of repeats, are open and are
   compared by a 64-bit and a 32-bit hash; of the sure strings one of each kind takes part.

For the comparison texts are dealt to parts of PART_BYTES. A part sends each hash once, however many
of its texts hold the string, and gets back those that occur elsewhere: a passage that a third of
all texts share costs a row per part, not per text.

Equal texts are one text; one that occurs twice loses all its strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, cut_at, pieces, release, remove
from deltaloom.llm.tokens import mix

#: Bytes of a string that must not start at two places, and words of a passage that counts as one.
WIDTH = 400
PASSAGE_WORDS = 51
#: A cut is the least of the hashes this far to either side; the hash reads CONTEXT bytes.
RADIUS = 32
CONTEXT = 8
#: Phrases that names rank: triples of triples.
DEPTH = 9
#: Bits of the filter of candidate texts, at least and at most.
BLOOM_BITS = (1 << 20, 1 << 27)
#: Bytes of text in a part, about, and of the texts whose open strings a bucket compares.
PART_BYTES = 1 << 20
BUCKET_BYTES = 2 << 20
#: Strings of a text that are looked at together.
CHUNK = 1 << 18
#: Open strings that a task holds before it sends them.
HELD = 1 << 20
#: Bytes of text that a worker turns into arrays at a time.
STEP = 2 << 20

_A = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
#: Powers of each multiplier and of its inverse.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cuts(data: bytes) -> np.ndarray:
    """Positions whose hash of the next CONTEXT bytes is less than all others within the radius."""
    n = len(data) - CONTEXT + 1
    found = [_cuts_of(data, k, min(n, k + STEP), n) for k in range(0, n, STEP)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _cuts_of(data: bytes, start: int, end: int, n: int) -> np.ndarray:
    """The cuts from `start` to `end`, of n places in all."""
    lo, hi = max(0, start - RADIUS), min(n, end + RADIUS)
    b = np.frombuffer(data, np.uint8)[lo : hi + CONTEXT - 1]
    v = mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, CONTEXT)).view("<u8").ravel())
    top = np.full(RADIUS, np.iinfo(np.uint64).max)
    low, span = np.r_[top, v, top], 1
    while span < RADIUS:
        step = min(span, RADIUS - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = np.flatnonzero((v < low[: len(v)]) & (v < low[RADIUS + 1 : RADIUS + 1 + len(v)])) + lo
    return at[(at >= start) & (at < end)]


def word_strings(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all strings of so many words; words are runs of bytes other than ASCII white space."""
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, (b != 32) & ((b < 9) | (b > 13)), False]))
    start, end = edge[0::2], edge[1::2]
    n = max(0, len(start) - words + 1)
    return start[:n], end[words - 1 :][:n]


def _before(bounds: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
    """How many bounds lie before each of the places, which go up; with side "left" those at the place count too."""
    return np.cumsum(np.bincount(np.searchsorted(at, bounds, side=side), minlength=len(at) + 1))[: len(at)]


def settled(bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, phrases) of each string, in order: its first cut that an equal string has too, and the phrases from there to the last such cut."""
    first = _before(bounds, start + RADIUS, "right")
    last = _before(bounds, end - RADIUS - CONTEXT, "left") - 1
    return first, np.maximum(last - first, 0)


def least_phrases(n: int, bounds: np.ndarray, width: int, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each first cut, and for none, the least phrases that a string with it holds; DEPTH + 1 if there is no string or more."""
    out = np.full(len(bounds) + 1, DEPTH + 1, np.int64)
    # as a string moves on, its end does: the first of those with a cut holds the fewest phrases
    after = np.r_[0, bounds - RADIUS + 1]
    if n >= width:
        start = np.maximum(after, 0)
        start = start[start <= n - width]
        np.minimum.at(out, *settled(bounds, start, start + width))
    start, end = spans
    if len(start):
        k = np.unique(np.searchsorted(start, after))
        k = k[k < len(start)]
        np.minimum.at(out, *settled(bounds, start[k], end[k]))
    return out


def phrase_table(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """(digest, n, bounds, names, least) per row of docs that has any string: cuts of the text, a hash of each phrase between them, least_phrases()."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", STEP):
            keep, bounds, names, least = [], [], [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                data = t.encode("utf-8", "replace")
                spans = word_strings(data, words) if words else _NONE
                if len(data) < width and not len(spans[0]):
                    continue
                at = cuts(data)
                ends = at.tolist()
                keep.append(k)
                bounds.append(at.astype(np.int32).tobytes())
                names.append(np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])], np.uint64).view(np.int64))
                least.append(least_phrases(len(data), at, width, spans).astype(np.int8).tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("digest"), own.column("n"), pa.array(bounds, pa.binary()), pa.array(names, pa.list_(pa.int64())), pa.array(least, pa.binary())], ["digest", "n", "bounds", "names", "least"])

    return _texts(docs).select("digest", "n", "text").mapInArrow(run, "digest string, n int, bounds binary, names array<bigint>, least binary")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("n"), text.alias("text"))


class _Cuts:
    """Written intermediate tables; what is dropped frees its files, and its shuffles' files soon after."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, self.paths[name] = cut_at(df, name)
        release(self.spark)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))


def repeated_runs(texts: DataFrame, cut: _Cuts) -> tuple[DataFrame, DataFrame]:
    """((tid, ks): phrases of each text that occur elsewhere; (tid, k, names): runs of two or more of them)."""
    flat = texts.select("tid", F.posexplode("names").alias("k", "name"))
    often = cut(flat.groupBy("name").count().where("count > 1").select("name"), "often")
    kept = flat.join(often, "name", "left_semi").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("p"))
    kept = cut(kept.select("tid", F.col("p.k").alias("ks"), F.col("p.name").alias("names")), "kept")
    cut.drop("often")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for tid, ks, names in zip(batch.column("tid").to_pylist(), batch.column("ks"), batch.column("names"), strict=True):
                k, v = ks.values.to_numpy(), names.values.to_numpy()
                edge = np.r_[0, np.flatnonzero(np.diff(k) != 1) + 1, len(k)]
                for a, b in zip(edge, edge[1:]):
                    if b - a > 1:
                        out[0].append(tid)
                        out[1].append(int(k[a]))
                        out[2].append(v[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64()))], ["tid", "k", "names"])

    return kept.select("tid", "ks"), cut(kept.mapInArrow(run, "tid bigint, k int, names array<bigint>"), "runs")


def _named(triples: DataFrame, cut: _Cuts, name: str) -> DataFrame:
    """(tid, k, names): the triples (tid, k, i, t0, t1, t2) of each run in order, named by their rank."""
    ranks = triples.select("t0", "t1", "t2").distinct().orderBy("t0", "t1", "t2")
    ranks = cut(ranks.withColumn("rank", F.monotonically_increasing_id() + 1), f"{name}-ranks")
    joined = triples.join(ranks, ["t0", "t1", "t2"]).groupBy("tid", "k").agg(F.sort_array(F.collect_list(F.struct("i", "rank"))).alias("p"))
    out = cut(joined.select("tid", "k", F.col("p.rank").alias("r")), name)
    cut.drop(f"{name}-ranks")
    return out


def _or_end(array: str, index: str) -> str:
    return f"coalesce(get({array}, {index}), 0L)"


def _common(rows: pa.RecordBatch) -> np.ndarray:
    """The phrases that each row's prefix has in common with the next row's, if both are of one order."""
    prefix, kind = rows.column("prefix"), rows.column("kind").to_numpy()
    size = prefix.value_lengths().to_numpy()
    of = np.repeat(np.arange(len(size)), size)
    names = np.zeros((len(size), DEPTH), np.int64)
    names[of, np.arange(len(of)) - (np.cumsum(size) - size)[of]] = prefix.flatten().to_numpy()
    same = names[1:] == names[:-1]
    length = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
    return np.where(kind[1:] == kind[:-1], np.minimum(length, np.minimum(size[1:], size[:-1])), 0)


def neighbours(classes: DataFrame) -> DataFrame:
    """(kind, k0, k1, k2, n, first, shared, edge) of the classes (kind, k0, k1, k2, n, first, prefix) of equal suffixes.

    All orders are sorted as one, in ranges of about the same size, however many suffixes begin with
    one phrase. Each row is compared with those beside it in its task; the first and the last row of
    a task keep their prefix as `edge`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the one after it; `left` is what it shares with the one before
        last, left, top = None, 0, True
        for batch in batches:
            rows = batch if last is None else pa.concat_batches([last, batch])
            if not rows.num_rows:
                continue
            near = np.r_[left, _common(rows), 0]
            last, left = rows.slice(rows.num_rows - 1), int(near[-2])
            if rows.num_rows > 1:
                done = rows.slice(0, rows.num_rows - 1)
                yield settled_rows(done, np.maximum(near[:-2], near[1:-1]), np.arange(done.num_rows) < top)
                top = False
        if last is not None:
            yield settled_rows(last, np.array([left]), np.array([True]))

    def settled_rows(rows: pa.RecordBatch, near: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        prefix = rows.column("prefix")
        shared = np.where(rows.column("n").to_numpy() > 1, prefix.value_lengths().to_numpy(), near)
        edges = pa.array([p if e else None for p, e in zip(prefix, edge.tolist())] if edge.any() else [None] * len(edge), prefix.type)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("kind", "k0", "k1", "k2", "n", "first")), pa.array(shared.astype(np.int32)), edges], ["kind", "k0", "k1", "k2", "n", "first", "shared", "edge"])

    in_order = classes.repartitionByRange("kind", "k0", "k1", "k2").sortWithinPartitions("kind", "k0", "k1", "k2")
    return in_order.mapInArrow(run, "kind int, k0 bigint, k1 bigint, k2 bigint, n bigint, first struct<tid: bigint, k: int>, shared int, edge array<bigint>")


def over_borders(lengths: DataFrame) -> DataFrame:
    """Rows of neighbours() anew, without edge, for those that share more with a row of the next or last task.

    The driver gets two rows of each task, of DEPTH phrases at most.
    """
    spark, columns = lengths.sparkSession, ["kind", "k0", "k1", "k2", "n", "first", "shared"]
    rows = lengths.where("edge IS NOT NULL").withColumnRenamed("edge", "prefix").orderBy("kind", "k0", "k1", "k2").toArrow()
    if not rows.num_rows:
        return lengths.select(columns).limit(0)
    near = np.r_[0, _common(rows.combine_chunks().to_batches()[0]), 0]
    more = np.maximum(near[:-1], near[1:])
    own = rows.column("shared").to_numpy()
    gained = rows.set_column(rows.column_names.index("shared"), "shared", pa.array(np.maximum(more, own).astype(np.int32))).filter(pa.array(more > own))
    return spark.createDataFrame(gained.select(columns).to_pylist(), lengths.select(columns).schema)


def shared_prefixes(runs: DataFrame, cut: _Cuts) -> DataFrame:
    """(tid, k, shared, echo) per position of the runs (tid, k, names).

    shared: the phrases that the suffix there has in common with the nearest other one, up to DEPTH.
    echo: true if an equal suffix (to that depth) at a smaller position stands for this one.
    """
    sampled = "filter(sequence(0, size(names) - 1), i -> i % 3 <> 0)"
    first = runs.select("tid", "k", "names", F.explode(F.expr(sampled)).alias("i")).select("tid", "k", "i", *(F.expr(_or_end("names", f"i + {d}")).alias(f"t{d}") for d in range(3)))
    once = _named(first, cut, "names-3")
    second = once.select("tid", "k", "r", F.explode(F.expr("sequence(0, size(r) - 1)")).alias("i")).select("tid", "k", "i", *(F.expr(_or_end("r", f"i + {2 * d}")).alias(f"t{d}") for d in range(3)))
    twice = _named(second, cut, "names-9")
    cut.drop("names-3")
    # a sampled position i holds entry i div 3 * 2 + i % 3 - 1 of r
    spots = runs.join(twice, ["tid", "k"]).select("tid", "k", "names", "r", F.explode(F.expr("sequence(0, size(names) - 1)")).alias("i"))

    def rank(d: int) -> str:
        return _or_end("r", f"(i + {d}) div 3 * 2 + (i + {d}) % 3 - 1")

    orders = [f"struct(0 AS kind, 0L AS k1, {rank(0)} AS k2)", f"struct(1 AS kind, 0L AS k1, {rank(1)} AS k2)", f"struct(2 AS kind, {_or_end('names', 'i + 1')} AS k1, {rank(2)} AS k2)"]
    of = [f"array({orders[1]}, {orders[2]})", f"array({orders[0]}, {orders[1]})", f"array({orders[0]}, {orders[2]})"]
    keyed = spots.select("tid", (F.col("k") + F.col("i")).alias("k"), F.expr("names[i]").alias("k0"), F.expr(f"slice(names, i + 1, {DEPTH})").alias("prefix"), F.explode(F.expr(f"CASE i % 3 WHEN 0 THEN {of[0]} WHEN 1 THEN {of[1]} ELSE {of[2]} END")).alias("o"))
    keyed = keyed.select("tid", "k", "prefix", "k0", "o.kind", "o.k1", "o.k2")
    classes = keyed.groupBy("kind", "k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "k")).alias("first"), F.first("prefix").alias("prefix"))
    lengths = cut(neighbours(classes), "lengths")
    lengths = lengths.drop("edge").unionByName(over_borders(lengths))
    found = keyed.drop("prefix").join(lengths, ["kind", "k0", "k1", "k2"])
    echo = (F.col("n") > 1) & ((F.col("first.tid") != F.col("tid")) | (F.col("first.k") != F.col("k")))
    return found.groupBy("tid", "k").agg(F.max("shared").alias("shared"), F.max(echo).alias("echo"))


@dataclass
class Phrases:
    """A text's cuts, and for each the phrases that the suffix there shares with another, and whether an equal suffix speaks for it."""

    bounds: np.ndarray
    shared: np.ndarray
    echo: np.ndarray

    def state(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sure, open, told) of each string, as booleans.

        sure: repeated by shared phrases. open: perhaps repeated. told: sure, and this text speaks for it.
        """
        m = len(self.bounds)
        first, phrases = settled(self.bounds, start, end)
        common = np.r_[self.shared, DEPTH][first]
        maybe = (phrases <= common) | (common >= DEPTH)
        if not m:
            return np.zeros(len(start), bool), maybe, np.zeros(len(start), bool)
        reach = np.where(self.shared > 0, self.bounds[np.minimum(np.arange(m) + self.shared, m - 1)], -1)
        at = _before(self.bounds, start, "left") - 1
        inside = at >= 0
        sure = inside & (np.maximum.accumulate(reach)[at] >= end)
        return sure, maybe & ~sure, inside & (reach[at] >= end) & ~self.echo[at]


def strings(data: bytes, width: int, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, starts, ends), a bounded number at a time: kind 0 of `width` bytes, kind 1 of `words` words."""
    last = len(data) - width + 1
    for k in range(0, last, CHUNK):
        start = np.arange(k, min(last, k + CHUNK))
        yield 0, start, start + width
    if words:
        start, end = word_strings(data, words)
        for k in range(0, len(start), CHUNK // 8):
            yield 1, start[k : k + CHUNK // 8], end[k : k + CHUNK // 8]


def _runs_of(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the true stretches, one after the other."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False])).astype(np.int32)


def string_hashes(data: bytes, kind: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of each string, whose starts and ends go up."""
    lo, hi = int(start[0]), int(end[-1])
    b, out = np.frombuffer(data, np.uint8)[lo:hi], []
    for table, mul in zip((_A, _B), _MULS):
        if mul not in _powers or len(_powers[mul][0]) <= len(b):
            size = max(1 << 16, 2 * len(b))
            _powers[mul] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (np.uint64(mul), np.uint64(pow(mul, -1, 1 << 64))))
        power, inverse = _powers[mul]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(table[b] * power[: len(b)], out=sums[1:])
        out.append(mix((sums[end - lo] - sums[start - lo]) * inverse[start - lo] + np.uint64(kind)))
    return out[0], out[1].astype(np.uint32)


def decisions(texts: DataFrame, kept: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tid, shared, echo): Phrases of the texts that have any string which isn't unique, packed."""
    per_text = lengths.groupBy("tid").agg(F.collect_list(F.struct("k", "shared", "echo")).alias("l"))
    joined = texts.select("tid", "least").join(kept, "tid", "left").join(per_text, "tid", "left")
    rows = joined.select("tid", "least", "ks", F.col("l.k").alias("k"), F.col("l.shared").alias("shared"), F.col("l.echo").alias("echo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for r in zip(*(batch.column(c) for c in ("tid", "least", "ks", "k", "shared", "echo")), strict=True):
                least = np.frombuffer(r[1].as_py(), np.int8)
                shared, echo = np.zeros(len(least) - 1, np.int8), np.zeros(len(least) - 1, bool)
                if r[2].is_valid:
                    shared[r[2].values.to_numpy()] = 1
                if r[3].is_valid:
                    k = r[3].values.to_numpy()
                    shared[k] = np.maximum(shared[k], r[4].values.to_numpy())
                    echo[k] = r[5].values.to_numpy(zero_copy_only=False)
                if ((least <= np.r_[shared, DEPTH]) | (np.r_[shared, 0] >= DEPTH)).any():
                    for o, x in zip(out, (r[0].as_py(), shared.tobytes(), echo.tobytes())):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["tid", "shared", "echo"])

    return rows.mapInArrow(run, "tid bigint, shared binary, echo binary")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, text) of the wanted digests, once each. A bounded Bloom filter keeps most other texts out of the shuffle."""
    spark = docs.sparkSession
    n = wanted.count()
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (16 * n).bit_length()))
    places = [f"cast(conv(substring(digest, {1 + 8 * k}, 8), 16, 10) AS bigint) % {bits}" for k in range(2)]
    words = wanted.select(F.explode(F.expr(f"array({', '.join(places)})")).alias("bit")).select(F.expr("bit div 62").alias("word"), F.expr("shiftleft(1L, cast(bit % 62 AS int))").alias("bit"))
    flat = np.zeros(bits // 62 + 1, np.int64)
    for r in words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bit")).toLocalIterator():
        flat[r["word"]] = r["bit"]
    table = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for p in ("p0", "p1"):
                at = batch.column(p).to_numpy()
                ok &= table.value[at // 62] >> (at % 62) & 1 > 0
            yield batch.filter(pa.array(ok)).select(["digest", "text"])

    rows = _texts(docs).where("n > 0").select("digest", "text", *(F.expr(p).alias(f"p{k}") for k, p in enumerate(places)))
    return rows.mapInArrow(run, "digest string, text string").groupBy("digest").agg(F.first("text").alias("text")).join(wanted.select("digest"), "digest", "left_semi")


def _phrases(row: dict) -> Phrases:
    return Phrases(np.frombuffer(row["bounds"], np.int32).astype(np.int64), np.frombuffer(row["shared"], np.int8).astype(np.int64), np.frombuffer(row["echo"], bool))


def _packed(columns: dict[str, np.ndarray], owner: np.ndarray, name: str) -> pa.RecordBatch:
    """One row per owner with its entries of each column, as bytes."""
    order = np.argsort(owner, kind="stable")
    own, first = np.unique(owner[order], return_index=True)
    ends = np.r_[first[1:], len(owner)]
    held = {c: x[order] for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in held.values())], [name, *held])


def _joined(rows: pa.Table, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in kinds.items()]


def settle(held: DataFrame, buckets: int, width: int, words: int) -> DataFrame:
    """(part, a, b): hashes of the open strings of each part of `held` that occur twice, packed in rows of one part."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        for batch in pieces(batches, "text", STEP):
            for row in batch.to_pylist():
                data, phrases = row["text"].encode("utf-8", "replace"), _phrases(row)
                for kind, start, end in strings(data, width, words):
                    _, maybe, told = phrases.state(start, end)
                    use = maybe | told
                    if use.any():
                        a, b = string_hashes(data, kind, start[use], end[use])
                        waiting.append((np.full(len(a), row["part"], np.int32), a, b, maybe[use].astype(np.uint8)))
                        if sum(len(x[0]) for x in waiting) > HELD:
                            yield once(waiting)
                            waiting = []
        if waiting:
            yield once(waiting)

    def once(waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Each hash of a part once; state is 1 if it is open, and 2 more if it occurs twice."""
        part, a, b, open_ = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((b, a, part))
        part, a, b, open_ = part[order], a[order], b[order], open_[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1])])
        many = np.diff(np.r_[first, len(a)]) > 1
        state = np.maximum.reduceat(open_, first) + 2 * many.astype(np.uint8)
        a, b, part = a[first], b[first], part[first]
        return _packed({"part": part, "a": a, "b": b, "state": state.astype(np.uint8)}, (a >> np.uint64(32)).astype(np.int64) % buckets, "bucket")

    def twice(key: tuple, rows: pa.Table) -> pa.Table:
        part, a, b, state = _joined(rows, part=np.int32, a=np.uint64, b=np.uint32, state=np.uint8)
        order = np.lexsort((b, a))
        part, a, b, state = part[order], a[order], b[order], state[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = (np.r_[same, False] | np.r_[False, same] | (state >= 2)) & (state % 2 == 1)
        return pa.Table.from_batches([_packed({"a": a[hit], "b": b[hit]}, part[hit], "part")])

    sent = held.select("part", "text", "bounds", "shared", "echo").mapInArrow(emit, "bucket int, part binary, a binary, b binary, state binary")
    return sent.groupBy("bucket").applyInArrow(twice, "part int, a binary, b binary")


def repeats(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """(digest, spans, n_removed, n_spans, kept, passages, kept_text): for each text that holds repeated strings, once per distinct text.

    spans are starts and ends of the stretches that repeated strings of `width` bytes cover, kept the
    other bytes; passages are the same for strings of `words` words, empty without. kept_text are the
    characters outside of both, without those that a stretch took a part of. Null texts are empty
    and, like all texts that are too short for a string, lose nothing.
    """
    if width < 2 * RADIUS + CONTEXT:
        raise ValueError(f"width has to be {2 * RADIUS + CONTEXT} at least, not {width}")
    spark = docs.sparkSession
    cut = _Cuts(spark)
    table = phrase_table(docs.select("text"), width, words).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "bounds", "names", "least")))
    texts = cut(table.withColumn("tid", F.monotonically_increasing_id()), "phrases")
    kept, runs = repeated_runs(texts, cut)
    lengths = cut(shared_prefixes(runs, cut), "shared")
    cut.drop("runs", "names-9", "lengths")
    found = decisions(texts, kept, lengths)
    none = F.expr("cast('' AS binary)")
    whole = texts.select("tid", "digest", "copies", "n", "bounds", F.expr("octet_length(bounds) div 4").alias("m"))
    marked = whole.join(found, "tid", "left").where("shared IS NOT NULL OR copies > 1")
    # a text that isn't marked by its phrases has none that is shared
    zeros = F.expr("unhex(repeat('00', cast(m AS int)))")
    marked = cut(marked.select("tid", "digest", "copies", "n", "bounds", F.coalesce("shared", zeros, none).alias("shared"), F.coalesce("echo", zeros, none).alias("echo")), "decided")
    cut.drop("phrases", "kept", "shared")
    total = marked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts, buckets = max(1, -(-total // PART_BYTES)), max(1, -(-total // BUCKET_BYTES))
    part = F.expr(f"cast(pmod(xxhash64(tid), {parts}) AS int)").alias("part")
    held = cut(_texts_of(docs.select("text"), marked.select("digest")).join(marked, "digest").select(part, "digest", "copies", "text", "bounds", "shared", "echo"), "candidates")
    cut.drop("decided")
    hits = cut(settle(held, buckets, width, words), "hits")

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        a, b = _joined(hits, a=np.uint64, b=np.uint32)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        out: list[tuple] = []
        for row in texts.to_pylist():
            data, phrases = row["text"].encode("utf-8", "replace"), _phrases(row)
            gone = [np.zeros(len(data) + 1, np.int32) for _ in range(2)]
            for kind, start, end in strings(data, width, words):
                sure, maybe, _ = phrases.state(start, end)
                if row["copies"] > 1:
                    sure[:] = True
                elif maybe.any() and len(a):
                    at = np.flatnonzero(maybe)
                    x, y = string_hashes(data, kind, start[at], end[at])
                    near = np.searchsorted(a, x)
                    hit = np.zeros(len(at), bool)
                    while (live := (near < len(a)) & ~hit).any():
                        same = live.copy()
                        same[live] = a[near[live]] == x[live]
                        hit[same] = b[near[same]] == y[same]
                        near = np.where(same, near + 1, len(a))
                    sure[at[hit]] = True
                edge = _runs_of(sure)
                np.add.at(gone[kind], start[edge[0::2]], 1)
                np.add.at(gone[kind], end[edge[1::2] - 1], -1)
            spans, passages = (_runs_of(np.cumsum(x)[:-1] > 0) for x in gone)
            if len(spans) or len(passages):
                lost = np.cumsum(gone[0] + gone[1])[:-1] > 0
                left = b"".join(data[i:j] for i, j in _between(spans, len(data)))
                text = b"".join(_whole_characters(data, _runs_of(lost))).decode()
                out.append((row["digest"], spans, len(data) - len(left), len(spans) // 2, left, passages, text))
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kinds = [pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.string()]
    names = ["digest", "spans", "n_removed", "n_spans", "kept", "passages", "kept_text"]
    grouped = held.groupBy("part").cogroup(hits.groupBy("part"))
    return grouped.applyInArrow(run, "digest string, spans array<int>, n_removed bigint, n_spans bigint, kept binary, passages array<int>, kept_text string")


def _between(spans: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """The stretches between the spans."""
    yield from zip([0, *spans[1::2].tolist()], [*spans[0::2].tolist(), n])


def _whole_characters(data: bytes, spans: np.ndarray) -> Iterator[bytes]:
    """The stretches between the spans, each without bytes of characters that it only holds a part of."""
    for a, b in _between(spans, len(data)):
        yield data[a:b].decode("utf-8", "ignore").encode()


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 400-byte strings; passage_bytes are those that repeated strings of PASSAGE_WORDS words cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    covered = F.expr("aggregate(sequence(1, size(passages) div 2), 0L, (s, i) -> s + passages[2 * i - 1] - passages[2 * i - 2])")
    lost = repeats(docs, words=PASSAGE_WORDS).select("digest", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.when(F.size("passages") > 0, covered).otherwise(0).alias("passage_bytes"))
    heads = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    joined = heads.join(lost, "digest", "left")
    return joined.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), F.coalesce("passage_bytes", F.lit(0)).cast("bigint").alias("passage_bytes"))
