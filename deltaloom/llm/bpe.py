"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their seam.

A text is encoded by a tree. A leaf is a short range of the text; a node is the join of two
neighbouring ranges. Two levels use the same idea:

* Pieces. The split pattern decides a match from left to right and looks at most two characters
  beyond its end, so the pieces of the left half that end MARGIN characters before the seam are
  final. From there the pattern runs again, piece by piece, into the right half until one of its
  ends is also an end of the right half's own pieces. A match depends only on the text that follows
  its start, so all later pieces of the right half are final as well.
* Tokens of a piece over LEAF_BYTES. Tokens are the encoding of their bytes if and only if every two
  neighbours are the encoding of their own joined bytes. A window around the seam is encoded again
  and grows until the pair at each of its borders has that property. Leaves and windows are encoded
  by merging the neighbours whose joined bytes have the least rank, until no pair has one.

Decoding concatenates token bytes up the same tree.
"""

from __future__ import annotations

import itertools
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, pieces

#: Characters of a leaf of the text tree, and bytes of a leaf of a piece's tree.
LEAF_CHARS = 4096
LEAF_BYTES = 8
#: Bytes up to which all pairs are looked through for each merge.
SHORT_BYTES = 48
#: No alternative of the split pattern looks further than this past the end of its match.
MARGIN = 4
#: Encoded pieces that a worker keeps, and encoded leaves and windows.
CACHE = 400_000
SMALL_CACHE = 200_000
RANKS = "byte_bpe_multi_50k.tiktoken"


_NO_RANK = 1 << 62
#: The end of each piece of a range, and each piece's tokens.
Node = tuple[list[int], list[tuple[int, ...]]]


class _Cache(dict):
    """Tokens by key; those of short keys are kept, and all are dropped when there are too many."""

    def __init__(self, encode: Callable, size: int):
        self.encode, self.size = encode, size

    def __missing__(self, key: str | bytes) -> tuple[int, ...]:
        found = self.encode(key)
        if len(key) <= 32:
            if len(self) >= self.size:
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encodes and decodes by one rank file and one split pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.small = _Cache(self.merge, SMALL_CACHE)
        self.cache = _Cache(lambda piece: self.of_bytes(piece.encode("utf-8", "replace")), CACHE)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The tokens of a few bytes: neighbours with the least rank become one, the first of equals, until no pair has a rank."""
        rank = self.ranks.get
        if (whole := rank(data)) is not None:
            return (whole,)
        if len(data) > SHORT_BYTES:
            return self._merge_long(data)
        ends = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], _NO_RANK) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != _NO_RANK:
            i = pairs.index(least)
            del ends[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(data[ends[i - 1] : ends[i + 1]], _NO_RANK)
            if i < len(pairs):
                pairs[i] = rank(data[ends[i] : ends[i + 2]], _NO_RANK)
        return tuple([self.ranks[data[a:b]] for a, b in zip(ends, ends[1:])])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs, in n log n steps; end and before lead from the start of a token to its neighbours'."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if mid >= n or mid == 0 or end[mid] != stop:
                continue
            end[i], end[mid], before[stop] = stop, 0, i
            if stop < n and (r := rank(data[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
            if i and (r := rank(data[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def of_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece, by halves."""
        if len(piece) <= LEAF_BYTES:
            return self.small[piece]
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        half = len(piece) // 2
        return self.join_tokens(self.of_bytes(piece[:half]), self.of_bytes(piece[half:]))

    def _fits(self, a: int, b: int) -> bool:
        return self.small[self.bytes_of[a] + self.bytes_of[b]] == (a, b)

    def join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        k, take = 1, self.bytes_of.__getitem__
        while True:
            m, n = min(k, len(left)), min(k, len(right))
            window = self.small[b"".join(map(take, left[len(left) - m :] + right[:n]))]
            before = m == len(left) or self._fits(left[-m - 1], window[0])
            after = n == len(right) or self._fits(window[-1], right[n])
            if before and after:
                return left[: len(left) - m] + window + right[n:]
            k *= 2

    def _leaf(self, text: str, lo: int, hi: int) -> Node:
        found = self.pattern.findall(text, lo, hi)
        return list(itertools.accumulate(map(len, found), initial=lo))[1:], list(map(self.cache.__getitem__, found))

    def join(self, text: str, left: Node, right: Node, lo: int, mid: int, hi: int) -> Node:
        """Joins the pieces of two neighbouring ranges that meet at `mid`; ends and tokens of each."""
        (ends, ids), (ends_r, ids_r) = left, right
        keep = bisect_right(ends, mid - MARGIN)
        at = ends[keep - 1] if keep else lo
        new_ends, new_ids, match = [], [], self.pattern.match
        while True:
            if at == mid:
                skip = 0
                break
            if at > mid and (k := bisect_left(ends_r, at)) < len(ends_r) and ends_r[k] == at:
                skip = k + 1
                break
            end = match(text, at, hi).end()
            new_ends.append(end)
            new_ids.append(self.cache[text[at:end]])
            at = end
        return ends[:keep] + new_ends + ends_r[skip:], ids[:keep] + new_ids + ids_r[skip:]

    def _tree(self, text: str, lo: int, hi: int) -> Node:
        if hi - lo <= LEAF_CHARS:
            return self._leaf(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join(text, self._tree(text, lo, mid), self._tree(text, mid, hi), lo, mid, hi)

    def encode(self, text: str) -> bytes:
        """The text's tokens as little-endian 32-bit integers."""
        return array("I", itertools.chain.from_iterable(self._tree(text, 0, len(text))[1])).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, joined by halves."""
        tokens = np.frombuffer(ids, "<u4").tolist()

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= LEAF_CHARS:
                return b"".join(map(self.bytes_of.__getitem__, tokens[lo:hi]))
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(tokens))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks_path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(id, ids) per row of docs: ids is binary, little-endian unsigned 32-bit; with `decoded`, also its bytes.

    Another `pattern` must not look further than MARGIN characters past the end of a match.
    A null text is the empty text and gives no tokens. Rows are independent: no shuffle, repeated ids
    and rows stay, other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    path, split = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, split)
        for batch in pieces(batches, "text"):
            ids = [c.encode(t) for t in batch.column("text").to_pylist()]
            out = [batch.column("id"), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([c.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["id", "ids", "decoded"][: len(out)])

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "id bigint, ids binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_column)


def decode(tokens: DataFrame, id_column: str = "doc_id", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded) per row of (id, ids); null ids decode to nothing."""
    bounded_batches(tokens.sparkSession)
    path, split = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, split)
        for batch in pieces(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], ["id", "decoded"])

    rows = tokens.select(F.col(id_column).alias("id"), F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "id bigint, decoded binary").withColumnRenamed("id", id_column)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: token count and digests of ids and of the decoded bytes."""
    return encode(docs, decoded=True).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digest of no bytes; repeated rows and ids stay.
    """
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
