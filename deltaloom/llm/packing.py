"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents become token ids; those longer than a row are split without loss into full rows and a
rest. Every piece is a segment, and segments are packed, longest first, each into the fullest row
that still takes it. The row is found by descending a segment tree over capacities, whose nodes say
whether a row with that capacity is open.

Packing is done in bins of the corpus: segments are dealt to bins of bounded size by a hash, each
bin is packed on its own, and its rows are written as one id matrix, with cumulative segment
lengths and positions that restart at each segment. More bins than one cost at most one unfilled
tail a bin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe
from deltaloom.llm.common import bounded_batches, new_path, pieces

#: Tokens of a row, the id that fills its end, and the id that ends a document.
ROW_TOKENS = 2048
PAD = 50256
END = 50256
#: Bytes of an id in the output: two, as long as the vocabulary has at most 65,536 ids.
ID_BYTES = 2
#: Bytes of text in a bin, about: what is packed at a time.
BIN_BYTES = 4 << 20


class Capacities:
    """A segment tree over capacities 0..n: which of them some open row has left."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, at_least: int) -> int | None:
        """The smallest capacity of `at_least` or more that a row has, or None."""
        k, count = at_least + self.size, self.count
        if count[k]:
            return at_least
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Rows of indices into lengths, none over row_tokens; longest first, each into the fullest row that takes it."""
    tree, open_, rows = Capacities(row_tokens), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        capacity = tree.least(n)
        if capacity is None:
            row = len(rows)
            rows.append([])
            capacity = row_tokens
        else:
            row = open_[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(i)
        left = capacity - n
        if left:
            open_.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def segments(docs: DataFrame, row_tokens: int = ROW_TOKENS, end: int | None = END, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(at, doc_id, part, ids): the token ids of each row of docs with `end` after them, cut at row_tokens.

    ids are binary, little-endian, ID_BYTES each; the parts of a row in order give all its ids. A null
    text is empty and holds `end` alone, or no segment without `end`. `at` numbers the rows.
    """
    bounded_batches(docs.sparkSession)
    path, split = ranks_path or public_tokenizers.path(bpe.RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = _tokenizer(path, split), ID_BYTES * row_tokens
        tail = b"" if end is None else end.to_bytes(ID_BYTES, "little")
        for batch in pieces(batches, "text", 4 << 20):
            owner, part, ids = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                whole = encode(text) + tail
                for k in range(0, len(whole), step):
                    owner.append(i)
                    part.append(k // step)
                    ids.append(whole[k : k + step])
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("at").take(take), batch.column("doc_id").take(take), pa.array(part, pa.int32()), pa.array(ids, pa.binary())], ["at", "doc_id", "part", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "at bigint, doc_id bigint, part int, ids binary")


@lru_cache(maxsize=2)
def _tokenizer(ranks_path: str, pattern: str):
    """text -> ids as little-endian bytes; one per worker process."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if max(ranks.values(), default=0) >= 1 << 8 * ID_BYTES:
        raise ValueError(f"ids of {ranks_path} don't fit into {ID_BYTES} bytes")
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kind = f"<u{ID_BYTES}"

    def encode(text: str) -> bytes:
        if _LONG_SPACE.search(text):
            return np.frombuffer(bpe.codec(ranks_path, pattern).encode(text), "<u4").astype(kind).tobytes()
        return own.encode_to_numpy(text, disallowed_special=()).astype(kind).tobytes()

    return encode


#: The library's pattern matcher gives up in longer runs of white space; operator 10 takes those texts.
_LONG_SPACE = re.compile(r"\s{100000}")

_ROW = "bin int, row int, doc_ids array<bigint>, parts array<int>, cu_seqlens array<int>, n_tokens int, input_ids binary, position_ids binary"


def pack(found: DataFrame, bins: int, row_tokens: int = ROW_TOKENS, pad: int = PAD) -> DataFrame:
    """One row per packed row: segments of `found` (at, doc_id, part, ids), dealt to `bins` bins.

    cu_seqlens are the segments' cumulative lengths from 0; input_ids are row_tokens ids, `pad` after
    the last segment; position_ids restart at 0 with each segment and with the padding. Both are
    binary, little-endian, ID_BYTES each. Equal files give equal rows, whatever order tasks end in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"bin": [], "at": [], "doc_id": [], "part": [], "ids": []}
        for batch in batches:
            for k in held:
                held[k] += batch.column(k).to_pylist()
            while held["bin"] and held["bin"][0] != held["bin"][-1]:
                n = next(i for i, b in enumerate(held["bin"]) if b != held["bin"][0])
                yield from rows({k: v[:n] for k, v in held.items()})
                held = {k: v[n:] for k, v in held.items()}
        if held["bin"]:
            yield from rows(held)

    def rows(own: dict[str, list]) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(own["bin"])), key=lambda i: (own["at"][i], own["part"][i]))
        lengths = [len(own["ids"][i]) // ID_BYTES for i in order]
        out, kind = [], f"<u{ID_BYTES}"
        for row, members in enumerate(best_fit(lengths, row_tokens)):
            at = [order[i] for i in members]
            sizes = [lengths[i] for i in members]
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            gap = row_tokens - int(ends[-1])
            ids = b"".join(own["ids"][i] for i in at) + np.full(gap, pad, kind).tobytes()
            positions = np.concatenate([np.arange(n, dtype=kind) for n in [*sizes, gap]])
            out.append((own["bin"][0], row, [own["doc_id"][i] for i in at], [own["part"][i] for i in at], ends.tolist(), int(ends[-1]), ids, positions.tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        names = ["bin", "row", "doc_ids", "parts", "cu_seqlens", "n_tokens", "input_ids", "position_ids"]
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), kinds, strict=True)], names)

    dealt = found.withColumn("bin", F.pmod(F.xxhash64("at", "part"), F.lit(bins)).cast("int"))
    sorted_ = dealt.select("bin", "at", "doc_id", "part", "ids").repartition("bin").sortWithinPartitions("bin")
    return sorted_.mapInArrow(run, _ROW)


def write_packed(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS, bin_bytes: int = BIN_BYTES, **tokenizer: str) -> DataFrame:
    """Tokenises docs, packs them, writes the rows to path as Parquet and returns what was written.

    Rows of docs are told apart by their place, so repeated rows are packed as often as they occur.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = segments(docs, row_tokens, **tokenizer)
    pack(found, max(1, -(-total // bin_bytes)), row_tokens).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) of every packed document, its segments joined in order; ids that repeat must be told apart beforehand."""
    at = F.posexplode(F.arrays_zip("doc_ids", "parts"))
    flat = packed.select("input_ids", "cu_seqlens", at.alias("k", "s"))
    piece = F.expr(f"substring(input_ids, {ID_BYTES} * cu_seqlens[k] + 1, {ID_BYTES} * (cu_seqlens[k + 1] - cu_seqlens[k]))")
    parts = flat.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.parts").alias("part"), piece.alias("ids"))
    joined = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"))
    return joined.select("doc_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in packed rows, written and read back.

    A null or empty text is its end token alone; texts of any length, and runs of white space of any length, are encoded whole; repeated rows are packed as often as they occur.
    Padding and end are the same id: n_tokens and cu_seqlens tell them apart.
    """
    return write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "packed"))
