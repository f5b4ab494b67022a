"""Lists of whole numbers as bytes, for joins that move a list of values with each row, and what is made of them where they arrive.

A list has some columns of equal length, nulls among them. Column by column each value is the zigzag
difference to the one before it (a null counts as 0 there) plus 1, or 0 for a null, seven bits to a
byte: sorted neighbours take a byte or two where a row for each takes tens.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values that are unpacked at a time.
CHUNK = 500_000
#: An end that never comes.
NEVER = np.int64((1 << 63) - 1)


def encoded(columns: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each list in them) of lists of so many values: columns of values and whether there is one."""
    width, total = len(columns), int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(total) - first[of]
    codes, wraps = np.zeros(width * total, np.uint64), np.zeros(width * total, bool)
    for k, (values, there) in enumerate(columns):
        values = np.where(there, values, 0).astype(np.int64)
        before = np.concatenate([values[:0], np.zeros(min(total, 1), np.int64), values[:-1]])
        before[at == 0] = 0
        delta = (values.view(np.uint64) - before.view(np.uint64)).view(np.int64)
        zigzag = (delta.view(np.uint64) << np.uint64(1)) ^ (delta >> np.int64(63)).view(np.uint64)
        place = width * first[of] + k * sizes[of] + at
        codes[place] = np.where(there, zigzag + np.uint64(1), np.uint64(0))
        wraps[place] = there & (zigzag == np.uint64((1 << 64) - 1))
    length = np.ones(len(codes), np.int64)
    for k in range(1, 10):
        length += codes >= np.uint64(1 << 7 * k)
    length[wraps] = 10
    ends = np.cumsum(length)
    found = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(10):
        long = length > k
        if not long.any():
            break
        more = (length[long] > k + 1).astype(np.uint8) << 7
        found[ends[long] - length[long] + k] = ((codes[long] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return found, np.concatenate([[0], ends])[width * np.cumsum(sizes)]


def decoded(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The columns and sizes that encoded() took."""
    last = (data & 128) == 0
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])[: len(stop)]
    shift = (np.arange(len(data)) - np.repeat(start, stop - start)).astype(np.uint64) * np.uint64(7)
    codes = np.add.reduceat((data & 127).astype(np.uint64) << shift, start) if len(stop) else np.zeros(0, np.uint64)
    upto = np.searchsorted(stop, ends, "right")
    sizes = np.diff(upto, prepend=0) // width
    null = (codes == 0) & (stop - start == 1)
    zigzag = codes - np.uint64(1)
    delta = (zigzag >> np.uint64(1)) ^ (np.uint64(0) - (zigzag & np.uint64(1)))
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) - first[of]
    columns = []
    for k in range(width):
        place = width * first[of] + k * sizes[of] + at
        there = ~null[place]
        own = np.where(there, delta[place], np.uint64(0))
        # After a null the difference is to 0, so sums begin anew there as they do at a list's start.
        fresh = (at == 0) | ~there | np.concatenate([[True], ~there[:-1]])[: len(there)]
        sums = np.cumsum(own)
        base = sums - own
        columns.append(((sums - base[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))] if len(own) else sums).view(np.int64), there))
    return columns, sizes


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    there = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK values each."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        yield at, stop
        at = stop


def packed(rows: DataFrame, names: list[str], to: str) -> DataFrame:
    """rows with the columns of those names, arrays of bigint of equal length, as the bytes `to`."""
    kept = [f for f in rows.schema.fields if f.name not in names]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(np.asarray(batch.column(names[0]).value_lengths())):
                part = batch.slice(lo, hi - lo)
                lists = [part.column(n) for n in names]
                data, ends = encoded([_values(c.flatten()) for c in lists], np.asarray(lists[0].value_lengths()).astype(np.int64))
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), found], [*(f.name for f in kept), to])

    return rows.mapInArrow(run, ", ".join([*fields, f"{to} binary"]))


def _unpacked(column: pa.Array, width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return decoded(data, offsets[1:] - offsets[0], width)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1])


def united(rows: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): the distinct values of all lists of one `by`, as an array or several, from rows in the order of `by` in each partition.

    `name` are bytes of packed() of one column. Of a `by` that goes on only distinct values are kept.
    """

    def told(there: np.ndarray, key: np.ndarray, has: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(key), CHUNK):
            hi = slice(lo, lo + CHUNK)
            begin = np.flatnonzero(_begins([there[hi], key[hi]]))
            offsets = np.append(begin, len(key[hi])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[hi], mask=has[hi] == 0))
            yield pa.RecordBatch.from_arrays([pa.array(key[hi][begin], mask=there[hi][begin] == 0), lists], [by, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo, hi in _slices(_bytes(batch.column(name))):
                part = batch.slice(lo, hi - lo)
                ((value, has),), sizes = _unpacked(part.column(name), 1)
                of = np.repeat(np.arange(len(part)), sizes)
                key, there = _values(part.column(by))
                keys = [there[of].astype(np.int64), key[of], has.astype(np.int64), np.where(has, value, 0)]
                if held is not None:
                    keys = [np.concatenate([a, b]) for a, b in zip(held, keys)]
                order = _in_order(keys)
                keys = [k[order] for k in keys]
                new = _begins(keys)
                keys = [k[new] for k in keys]
                goes_on = (keys[0] == int(there[-1])) & (keys[1] == key[-1])
                yield from told(*(k[~goes_on] for k in keys))
                held = [k[goes_on] for k in keys]
        if held is not None:
            yield from told(*held)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(F.col(by).cast("bigint").alias(by), name)
    return rows.mapInArrow(run, f"{by} bigint, {name} array<bigint>").withColumn(by, F.col(by).cast(types[by]))


# merging lives


def _ranked(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 in the order of the values, and how many they may be."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    if high - low < 1 << 31:
        return values - np.int64(low), high - low + 1
    found, at = np.unique(values, return_inverse=True)
    return at.astype(np.int64), len(found)


def _in_order(columns: list[np.ndarray]) -> np.ndarray:
    """The places of rows in the order of their columns."""
    ranks = [_ranked(v) for v in columns]
    total = 1
    for _, n in ranks:
        total *= n
    if total >= 1 << 62:
        return np.lexsort([own for own, _ in reversed(ranks)])
    line = ranks[0][0]
    for own, n in ranks[1:]:
        line = line * n + own
    return np.argsort(line)


def _begins(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    found = np.zeros(len(columns[0]), bool)
    found[:1] = True
    for c in columns:
        found[1:] |= c[1:] != c[:-1]
    return found


def islands(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Overlapping and touching lives of equal keys as one, in the order of the keys; an end is NEVER where there is none."""
    live = start < end
    keys, start, end = [k[live] for k in keys], start[live], end[live]
    if not len(start):
        return keys, start, end
    order = _in_order([*keys, start])
    keys, start, end = [k[order] for k in keys], start[order], end[order]
    first = _begins(keys)
    # The greatest end so far, by its rank, as ranks of later keys lie above all of earlier ones.
    known, at = np.unique(end, return_inverse=True)
    base = (np.cumsum(first) - 1) * np.int64(len(known))
    reached = np.maximum.accumulate(base + at) - base
    new = first.copy()
    new[1:] |= known[reached[:-1]] < start[1:]
    begin = np.flatnonzero(new)
    return [k[begin] for k in keys], start[begin], known[reached[np.append(begin[1:], len(start)) - 1]]


def logged(rows: DataFrame, by: str, own: str, name: str, out: tuple[str, str]) -> DataFrame:
    """(op, seq, out): the merged lives of pairs of `by` and a value `own`, from rows (by, _start, _end, name) in the order of `by` in each partition.

    `name` are bytes of lists of own, _start and _end; a pair lives where both a row and an element of
    its list do. Of a `by` that goes on only merged lives are kept.
    """

    def said(op: bytes, seq: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        offsets = np.arange(len(seq) + 1, dtype=np.int32)
        ops = pa.Array.from_buffers(pa.string(), len(seq), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(op * len(seq))])
        return pa.RecordBatch.from_arrays([ops, pa.array(seq), *(pa.array(v, mask=~there.astype(bool)) for v, there in (columns[c] for c in out))], ["op", "seq", *out])

    def told(found: tuple[list[np.ndarray], np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        (there, key, has, value), start, end = found
        for lo in range(0, len(start), CHUNK):
            hi = slice(lo, lo + CHUNK)
            yield said(b"+", start[hi], {by: (key[hi], there[hi]), own: (value[hi], has[hi])})
            gone = np.flatnonzero(end[hi] != NEVER) + lo
            if len(gone):
                yield said(b"-", end[gone], {by: (key[gone], there[gone]), own: (value[gone], has[gone])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for lo, hi in _slices(_bytes(batch.column(name))):
                part = batch.slice(lo, hi - lo)
                ((value, has), (s, _), (e, ends)), sizes = _unpacked(part.column(name), 3)
                of = np.repeat(np.arange(len(part)), sizes)
                key, there = _values(part.column(by))
                start, _ = _values(part.column("_start"))
                end, closed = _values(part.column("_end"))
                keys = [there[of].astype(np.int64), key[of], has.astype(np.int64), np.where(has, value, 0)]
                start, end = np.maximum(start[of], s), np.minimum(np.where(closed, end, NEVER)[of], np.where(ends, e, NEVER))
                if held is not None:
                    keys, start, end = [np.concatenate([a, b]) for a, b in zip(held[0], keys)], np.concatenate([held[1], start]), np.concatenate([held[2], end])
                found = islands(keys, start, end)
                goes_on = (found[0][0] == int(there[-1])) & (found[0][1] == key[-1])
                yield from told(([k[~goes_on] for k in found[0]], found[1][~goes_on], found[2][~goes_on]))
                held = [k[goes_on] for k in found[0]], found[1][goes_on], found[2][goes_on]
        if held is not None:
            yield from told(held)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(F.col(by).cast("bigint").alias(by), "_start", "_end", name)
    return rows.mapInArrow(run, ", ".join(["op string", "seq bigint", *(f"{c} bigint" for c in out)])).withColumn(by, F.col(by).cast(types[by]))
