"""Packed fields: several values in one string, split into one row per value with its position.

The splitter works on the Arrow string buffer of a whole batch: quote parity and delimiter
masks are computed over all bytes at once, child offsets are derived from them, the values
become a list array on the parents' offsets, and that is flattened with parent ordinals.
Every delimiter is ASCII, so byte masks are safe in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes that separate values, opening and closing brackets, words that separate values.
SEPARATORS = ",;|/&:+\n\r\t"
OPENING = "[{("
CLOSING = "]})"
JOINING_WORDS = (" et ", " and ", " ou ", " or ")

DQ, SQ, SPACE = 34, 39, 32


def _mask(data: np.ndarray, chars: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in chars]] = True
    return flags[data]


def _parity(marks: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """1 from an opening mark up to before its closing one, counted anew in each row."""
    total = np.cumsum(marks, dtype=np.int64)
    before = total - marks
    return (total - before[row_start]) & 1


def _scan_row(text: str) -> list[str]:
    """One row by a plain state machine, for rows that mix both quote signs or leave one open."""
    parts, buf, quote, i, n = [], [], "", 0, len(text)
    closes = {"'": text.count("'"), '"': text.count('"')}
    while i < n:
        c = text[i]
        if quote:
            if c == quote and i + 1 < n and text[i + 1] == quote:
                buf.append(c + c)
                i += 2
                continue
            if c == quote:
                quote = ""
            buf.append(c)
        elif c in "'\"" and not "".join(buf).strip() and text.find(c, i + 1) > 0 and closes[c] > 1:
            quote = c
            buf.append(c)
        elif c in SEPARATORS or (c in OPENING and not "".join(buf).strip()):
            parts.append("".join(buf))
            buf = []
        elif c in CLOSING and text[i + 1 :].lstrip()[:1] in ("", *SEPARATORS, *OPENING, *CLOSING):
            parts.append("".join(buf))
            buf = []
        else:
            word = next((w for w in JOINING_WORDS if text.startswith(w, i)), None)
            if word:
                parts.append("".join(buf))
                buf = []
                i += len(word) - 1
                continue
            buf.append(c)
        i += 1
    parts.append("".join(buf))
    return parts


def _clean(values: pa.Array) -> pa.Array:
    """Without surrounding spaces and quotes; a doubled quote inside a quoted value made single."""
    values = pc.utf8_trim_whitespace(values)
    for quote in ('"', "'"):
        quoted = pc.and_(
            pc.and_(pc.starts_with(values, quote), pc.ends_with(values, quote)), pc.greater(pc.utf8_length(values), 1)
        )
        inner = pc.replace_substring(pc.utf8_slice_codeunits(values, 1, -1), quote * 2, quote)
        values = pc.utf8_trim_whitespace(pc.if_else(quoted, inner, values))
    return values


def split_packed(array: pa.Array) -> pa.ListArray:
    """The values of each string as a list array; null and blank strings give empty lists."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return pa.array([], pa.list_(pa.string()))
    ends = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    base = int(ends[0])
    size = int(ends[-1]) - base
    if size == 0:
        return pa.array([[]] * n, pa.list_(pa.string()))
    data = np.frombuffer(array.buffers()[2], np.uint8)[base : base + size]
    offsets = ends - base
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    start = offsets[row]
    first = np.zeros(size, bool)
    first[offsets[:-1][lengths > 0]] = True
    last = np.zeros(size, bool)
    last[(offsets[1:] - 1)[lengths > 0]] = True

    wordish = ((data >= 48) & (data <= 57)) | (((data | 32) >= 97) & ((data | 32) <= 122)) | (data >= 128)
    before = np.concatenate(([False], wordish[:-1])) & ~first
    after = np.concatenate((wordish[1:], [False])) & ~last
    double = data == DQ
    single = (data == SQ) & ~(before & after)  # an apostrophe within a word is no quote
    inside_double = _parity(double, start).astype(bool)
    single &= ~inside_double
    inside_single = _parity(single, start).astype(bool)
    odd = np.zeros(n, bool)
    odd[row[double & inside_single]] = True  # double quotes within single ones
    odd[row[last & (inside_double & ~double | inside_single & ~single)]] = True  # a quote left open
    odd[row[last & ((double & inside_double) | (single & inside_single))]] = True
    outside = ~(inside_double | inside_single | double | single)

    # neighbours that aren't spaces, for brackets that surround values
    solid = data != SPACE
    at = np.arange(size)
    previous = np.maximum.accumulate(np.where(solid, at, -1))
    previous = np.concatenate(([-1], previous[:-1]))
    following = np.minimum.accumulate(np.where(solid, at, size)[::-1])[::-1]
    following = np.concatenate((following[1:], [size]))
    edge = _mask(data, SEPARATORS + OPENING + CLOSING) & outside
    opens_value = (previous < start) | edge[np.maximum(previous, 0)]
    closes_value = (following >= offsets[1:][row]) | edge[np.minimum(following, size - 1)]
    cut = outside & (
        _mask(data, SEPARATORS) | (_mask(data, OPENING) & opens_value) | (_mask(data, CLOSING) & closes_value)
    )
    for word in JOINING_WORDS:
        code = np.frombuffer(word.encode(), np.uint8)
        width = len(code)
        if size < width:
            continue
        hit = np.ones(size - width + 1, bool)
        for k, byte in enumerate(code):
            hit &= data[k : size - width + 1 + k] == byte
        where = np.flatnonzero(hit & outside[: size - width + 1])
        where = where[row[where] == row[where + width - 1]]
        for k in range(width):
            cut[where + k] = True

    keep = ~cut
    begins = keep & (first | np.concatenate(([True], cut[:-1])))
    child = np.flatnonzero(begins)
    parent = row[child]
    number = np.cumsum(begins) - 1
    widths = np.bincount(number[keep], minlength=len(child))
    child_offsets = np.concatenate(([0], np.cumsum(widths))).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(child), pa.py_buffer(child_offsets), pa.py_buffer(data[keep].tobytes()))
    values = _clean(values)
    good = pc.greater(pc.utf8_length(values), 0).to_numpy(zero_copy_only=False) & ~odd[parent]
    values, parent = values.filter(pa.array(good)), parent[good]

    if odd.any():
        extra = [(i, v) for i in np.flatnonzero(odd) for v in _clean(pa.array(_scan_row(array[int(i)].as_py()))).to_pylist() if v]
        parent = np.concatenate((parent, np.array([i for i, _ in extra], parent.dtype)))
        values = pa.concat_arrays([values, pa.array([v for _, v in extra], pa.large_string())])
        order = np.argsort(parent, kind="stable")
        values, parent = values.take(pa.array(order)), parent[order]
    counts = np.bincount(parent, minlength=n)
    list_offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets), values.cast(pa.string()))


def explode_packed(df: DataFrame, key_col: str, packed_col: str, min_values: int = 2) -> DataFrame:
    """Rows ``(key, pos, item)`` for every value of fields that hold at least ``min_values``.

    A null or blank field, or one value with stray delimiters, gives no rows at the default
    ``min_values``; empty values are dropped and not counted; repeated input rows give one set
    of rows; very long fields stay in one row of one batch; other columns are ignored.
    """
    key_type = df.schema[key_col].dataType
    schema = T.StructType(
        [T.StructField("key", key_type), T.StructField("pos", T.LongType()), T.StructField("item", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_packed(batch.column(1))
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            counts = np.asarray(counts, np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            parent = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(parent)) - offsets[parent]
            keep = counts[parent] >= min_values
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(parent[keep])),
                    pa.array(pos[keep], pa.int64()),
                    lists.flatten().filter(pa.array(keep)),
                ],
                names=["key", "pos", "item"],
            )

    source = df.select(F.col(key_col).alias("key"), F.col(packed_col).cast("string").alias("packed"))
    if min_values > 1:  # two values need a delimiter; this test is pushed below the Python stage
        source = source.where(F.col("packed").rlike(r"[,;|/&:+\n\r\t\[\](){}]| (?:et|and|ou|or) "))
    return source.mapInArrow(run, schema).distinct()
