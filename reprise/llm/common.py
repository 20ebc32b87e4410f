"""What the operators of this subpackage share: reading tables, cutting lineage, hashing inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage, unstage  # noqa: F401  for the operators

U = np.uint64
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, *without: str) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in without]


def whole_row(df: DataFrame, *without: str) -> Column:
    """A struct `row` of df's columns, so that columns of our own beside it clash with none of them."""
    return F.struct(*named(df, *without)).alias("row")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
#: A 64-bit code for each byte value.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: The same with A-Z folded to a-z.
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For word features: letters, digits and every byte of a longer UTF-8 sequence belong to words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = False
APART[128:] = False

_pows: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if "n" not in _pows or len(_pows["n"]) <= n:
        size = 1 << max(20, int(n + 1).bit_length())
        for name, base in (("n", BASE), ("i", _INV)):
            step = np.full(size, base, U)
            step[0] = 1
            _pows[name] = np.multiply.accumulate(step)
    return _pows["n"], _pows["i"]


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of code(data[x])*BASE**x for i <= x < j."""
    return running(codes[data])


def running(codes: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of codes[x]*BASE**x for i <= x < j."""
    out = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal substrings, wherever they start."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, at - at[0]


def chunks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes together; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(data: np.ndarray, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: maximal runs of bytes that don't set words apart, within a row."""
    inside = ~apart[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    # rows that meet without a separator are cut as well
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]
    marks = np.flatnonzero(edge)
    if len(cut):
        marks = np.sort(np.concatenate([marks, cut, cut]))
    start, end = marks[0::2], marks[1::2]
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z folded) and its row."""
    start, end, row = words_of(data, at, apart)
    return substring_hash(prefix_sums(data, LOWER_BYTE), start, end), row
