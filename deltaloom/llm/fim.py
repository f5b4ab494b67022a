"""Fill-in-the-middle: every text is cut into prefix, middle and suffix at unit boundaries, and put in another order.

All rows of a batch are cut together, on the bytes of their Arrow buffer. A table gives each byte a
class; a rule on the classes of two adjacent bytes marks the bytes that begin a unit (the first byte
of each text always does); cumulative sums of the marks, reset at each text, number the units; a
binary search in the sums finds the byte of every cut. Prefixes, middles and suffixes are then
slices of the same buffer, which Arrow joins with the sentinels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import bounded_batches, pieces

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
RATE, SPM = 100, 50
SEED = 7
#: Bytes of text that one kernel call takes; its arrays have about eight bytes for each.
KERNEL_BYTES = 4 << 20
#: Classes of bytes: line end, other white space, later byte of a character, any other.
LINE_END, BLANK, LATER, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
CLASS[0x0A] = LINE_END
CLASS[0x80:0xC0] = LATER
#: True where a byte of the second class, after one of the first, begins a unit: a line with its line end, a word with the space after it, a character.
_BEFORE, _AT = np.divmod(np.arange(16), 4)
_SPACE = [LINE_END, BLANK]
STARTS = {"line": _BEFORE == LINE_END, "word": np.isin(_BEFORE, _SPACE) & ~np.isin(_AT, _SPACE), "char": _AT != LATER}


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array, nulls empty, and where each text begins, with the end last."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between each bound and the next, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def _hits(data: np.ndarray, at: np.ndarray, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where sentinels stand inside one text each: places in order, which sentinel, which text."""
    places, kinds = [], []
    for k, s in enumerate(sentinels):
        found = np.flatnonzero(data[: max(0, len(data) - len(s) + 1)] == s[0])
        for i, b in enumerate(s[1:], 1):
            found = found[data[found + i] == b]
        places.append(found)
        kinds.append(np.full(len(found), k))
    place, kind = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(place, kind="stable")
    place, kind = place[order], kind[order]
    row = np.searchsorted(at, place, side="right") - 1
    inside = place + np.array([len(s) for s in sentinels])[kind] <= at[row + 1]
    return place[inside], kind[inside], row[inside]


def rearranged(texts: pa.Array, h: list[np.ndarray], unit: str, rate: int, spm: int, sentinels: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Units of each text, its form (0 plain, 1 psm, 2 spm), characters of prefix and middle, and the output."""
    data, at = _bytes_of(texts)
    rows = len(texts)
    kind = CLASS[data]
    mark = np.zeros(len(data), bool)
    mark[1:] = STARTS[unit][kind[:-1] * 4 + kind[1:]]
    mark[at[:-1][at[:-1] < at[1:]]] = True
    total = np.cumsum(mark, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.concatenate([[0], total])[at]
    before, n = upto[:-1], np.diff(upto)
    plain = (n == 0) | (h[2] % 100 >= rate)
    plain[_hits(data, at, sentinels)[2]] = True
    turned = ~plain & (h[3] % 100 < spm)
    ends = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    ends[:, plain] = 0
    #: The unit after the cut is number ends + 1 of its text; a cut after the last unit is the text's end.
    cuts = np.where(ends < n, np.searchsorted(total, before + ends + 1), at[1:])
    cuts[:, plain] = at[:-1][plain]
    bounds = np.concatenate([np.stack([at[:-1], *cuts], axis=1).ravel(), at[-1:]])
    part = _slices(data, bounds)
    chars = np.add.reduceat(np.append(kind != LATER, False), bounds[:-1], dtype=np.int64) if rows else np.zeros(0, np.int64)
    chars[np.diff(bounds) == 0] = 0
    tags = pa.array([*sentinels, b""], pa.large_binary())
    #: Parts and sentinels are numbered prefix, suffix, middle in the output's terms; 3 is none.
    first = np.where(plain, 3, np.where(turned, 1, 0))
    second = np.where(plain, 3, np.where(turned, 0, 1))
    third = np.where(plain, 3, 2)
    base = 3 * np.arange(rows)
    pieces_ = [x for tag, own in ((first, np.where(turned, 2, 0)), (second, np.where(turned, 0, 2)), (third, 1)) for x in (tags.take(pa.array(tag)), part.take(pa.array(base + own)))]
    out = pc.binary_join_element_wise(*pieces_, pa.scalar(b"", pa.large_binary()))
    return n, np.where(plain, 0, np.where(turned, 2, 1)), chars.reshape(rows, 3), out


def rebuilt(outputs: pa.Array, form: np.ndarray, sentinels: tuple[bytes, ...]) -> pa.Array:
    """The texts behind outputs of the given forms; an output that lacks a sentinel raises."""
    data, at = _bytes_of(outputs)
    plain = form == 0
    place, kind, row = _hits(data, at, sentinels)
    mine = ~plain[row]
    place, kind, row = place[mine], kind[mine], row[mine]
    whole = np.flatnonzero(~plain)
    if not np.array_equal(row, np.repeat(whole, 3)) or not np.array_equal(kind.reshape(-1, 3), np.where(form[whole, None] == 2, [1, 0, 2], [0, 1, 2])):
        raise ValueError("an output doesn't hold each sentinel once, in the order of its form")
    begins = np.repeat(at[:-1], 6).reshape(-1, 6)
    begins[whole, ::2] = place.reshape(-1, 3)
    begins[whole, 1::2] = (place + np.array([len(s) for s in sentinels])[kind]).reshape(-1, 3)
    part = _slices(data, np.concatenate([begins.ravel(), at[-1:]]))
    turned, base = form == 2, 6 * np.arange(len(form))
    order = [np.where(turned, 3, 1), np.full(len(form), 5), np.where(turned, 1, 3)]
    return pc.binary_join_element_wise(*(part.take(pa.array(base + k)) for k in order), pa.scalar(b"", pa.large_binary()))


FORMS = np.array(["plain", "psm", "spm"])


def _encoded(sentinels: tuple[str, ...]) -> tuple[bytes, ...]:
    if len(set(sentinels)) != 3 or any(not s or any(s[k:] == t[: len(s) - k] for t in sentinels for k in range(1, len(s))) for s in sentinels) or any(s in t for s in sentinels for t in sentinels if s != t):
        raise ValueError("three different sentinels are needed, none of which holds another or ends as one begins")
    return tuple(s.encode() for s in sentinels)


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of `docs`; further columns are left out.

    Units are lines with their line ends, words with the white space after them (at a text's
    begin it is a unit of its own), or characters. Cuts and forms follow from doc_id and seed alone, so
    a row that is computed again comes out the same. Null and empty texts, and those that hold a
    sentinel, stay as they are: form plain, no counts. A null doc_id counts as the empty one;
    repeated rows are rows of their own. Texts of any length are cut whole.
    """
    tags = _encoded(sentinels)
    spark = docs.sparkSession
    bounded_batches(spark)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), digest.alias("_digest")).select("doc_id", "text", *h)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", KERNEL_BYTES):
            n, form, chars, out = rearranged(b.column("text"), [b.column(f"h{k}").to_numpy(zero_copy_only=False) for k in range(4)], unit, rate, spm, tags)
            hide = form == 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(FORMS[form]), pa.array(chars[:, 0], mask=hide), pa.array(chars[:, 1], mask=hide), out.cast(pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(kernel, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """`rows` (form, output and any others) with `restored`, the text that output and form give back; it replaces a column of that name."""
    tags = _encoded(sentinels)
    bounded_batches(rows.sparkSession)
    rows = rows.drop("restored")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "output", KERNEL_BYTES):
            form = np.searchsorted(FORMS, b.column("form").to_numpy(zero_copy_only=False).astype(str))
            yield pa.RecordBatch.from_arrays([*b.columns, rebuilt(b.column("output"), form, tags).cast(pa.binary()).cast(pa.string())], names=[*b.schema.names, "restored"])

    return rows.mapInArrow(kernel, f"{own}, restored string")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all of `documents` for filling in the middle, with digests of the outputs and of what they give back."""
    found = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def _cut(k: int) -> str:
    return f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT)"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {_cut(0)} % (len(units) + 1) AS x, {_cut(1)} % (len(units) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_cut(2)} % 100 >= {RATE} THEN 'plain' WHEN {_cut(3)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:least(x, y)], '') AS pre, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(units[greatest(x, y) + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
