"""Strings of a fixed length that occur more than once, by a depth-limited most-significant-digit sort.

Suffixes are told apart only through `width` symbols, which are bytes or words. To sort few of them, every window of
`width` symbols is filed under its anchor, the smallest hashed gram among its first `reach` ones: equal windows have
their anchor at the same offset, so windows of one anchor are a stretch of offsets. Passes go from coarse digits to fine
ones. In each, a stretch is compared by two digits: the symbols all its windows share (windows of stretches that differ
there are all different) and the symbols its windows cover together (stretches equal there have equal windows
throughout). Stretches alone in their first digit are done, stretches with an equal second digit are repeated as a
whole, and the rest is cut finer, down to single windows; so equal groups at the end are exactly the repeated windows.
The digits are 64-bit hashes of two unlike kinds (a polynomial and XXH3), and strings count as equal where both agree.
Groups are counts with partial aggregation, never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, SPACE, U, chunks, mix, powers, prefix_sums, running, stage, substring_hash, text_bytes, unstage, words_of

CHUNK = 1 << 18
ROWS = "did long, th long, anchor int, lo int, hi int, core long, whole long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


@dataclass(frozen=True)
class Unit:
    """What windows are made of: words or bytes, how many, the gram and reach of anchors, and the block sizes of the passes after the first."""

    words: bool
    width: int
    gram: int
    reach: int
    cuts: tuple[int, ...]

    def symbols(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of these rows, where each row's begin, and running sums of their codes."""
        if not self.words:
            return data, at, prefix_sums(data, BYTE)
        start, end, row = words_of(data, at, SPACE)
        words = substring_hash(prefix_sums(data, BYTE), start, end)
        return words, np.searchsorted(row, np.arange(len(at))), running(words)


def bytes_of(width: int) -> Unit:
    reach, gram = 256, 32
    if width < reach + gram - 1:
        raise ValueError(f"width must be at least {reach + gram - 1} bytes")
    return Unit(False, width, gram, reach, (16, 1))


def words_in(width: int) -> Unit:
    if width < 8:
        raise ValueError("width must be at least 8 words")
    return Unit(True, width, 4, width - 4, (4, 1))


def _stretches(n: int, at: np.ndarray, sums: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last offset of each stretch: a window starts `offset` symbols before its anchor."""
    if n < unit.width:
        return (np.zeros(0, np.int64),) * 3
    low = U((1 << 32) - 1)  # places; a text has at most 2**31 bytes
    gram = mix((sums[unit.gram :] - sums[: -unit.gram]) * powers(n)[1][: n - unit.gram + 1])
    least = (gram & ~low) | np.arange(len(gram), dtype=U)  # ties to the leftmost
    span = 1
    while span < unit.reach:
        step = min(span, unit.reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    end = np.repeat(at[1:], np.diff(at))
    p = np.flatnonzero(np.arange(len(least)) + unit.width <= end[: len(least)])
    a = (least[p] & low).astype(np.int64)
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    s = np.flatnonzero(first)
    e = np.concatenate([s[1:], [len(p)]]) - 1 if len(s) else s
    return a[s], a[s] - p[e], a[s] - p[s]


def _digits(symbols: np.ndarray, sums: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    core = substring_hash(sums, a - block * size, a - block * size - (size - 1) + width)
    view, wide = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
    whole = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(((a - hi) * wide).tolist(), ((a - lo + width) * wide).tolist())), U, len(a))
    salt = U(0x9FB21C651E98DF25)
    return mix(core + block.astype(U) * salt).view(np.int64), mix(whole + (lo * 4096 + hi).astype(U) * salt).view(np.int64)


def _first(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat, starts = text_bytes(batch.column(2))
            for i, j in chunks(starts, CHUNK):
                symbols, at, sums = unit.symbols(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                a, lo, hi = _stretches(len(symbols), at, sums, unit)
                if len(a):
                    row = np.searchsorted(at, a, "right") - 1
                    core, whole = _digits(symbols, sums, a, lo, hi, np.zeros(len(a), np.int64), unit.reach, unit.width)
                    cols = (did[i + row], th[i + row], (a - at[row]).astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), core, whole)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)

    return run


def _finer(size: int, unit: Unit):
    """Cut the listed stretches of each text into blocks of `size` offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            flat, starts = text_bytes(batch.column(2))
            for r, parts in enumerate(batch.column(3).to_pylist()):
                data = flat[starts[r] : starts[r + 1]]
                symbols, _, sums = unit.symbols(data, np.array([0, len(data)]))
                a, lo, hi = (np.array([x[k] for x in parts], np.int64) for k in ("anchor", "lo", "hi"))
                many = hi // size - lo // size + 1
                own = np.repeat(np.arange(len(a)), many)
                block = lo[own] // size + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
                a, lo, hi = a[own], np.maximum(lo[own], block * size), np.minimum(hi[own], block * size + size - 1)
                core, whole = _digits(symbols, sums, a, lo, hi, block, size, unit.width)
                cols = (np.full(len(a), did[r]), np.full(len(a), th[r]), a.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), core, whole)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)

    return run


def _kept(width: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column(2))
            removed, spans, sha = [], [], []
            for r, parts in enumerate(batch.column(3).to_pylist()):
                data = flat[starts[r] : starts[r + 1]]
                edge = np.zeros(len(data) + 1, np.int64)
                for x in parts:
                    edge[x["anchor"] - x["hi"]] += 1
                    edge[x["anchor"] - x["lo"] + width] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                sha.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["did", "th", "n_removed", "n_spans", "kept_sha256"])

    return run


def _sorted(rows: DataFrame, apart: bool) -> DataFrame:
    """One pass: rows that are repeated as a whole (`all`; with `apart` in another text), and rows to be cut `finer`.

    Finer are the rows that share their first digit with a different row; of rows with an equal second digit one goes on
    for the others, as part of it may stand in a row that isn't repeated as a whole.
    """
    one, text = F.struct("did", "th", "anchor"), F.struct("did", "th")
    pair = stage(rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(one).alias("one"), *([F.max(text).alias("last")] if apart else [])))
    many = pair.groupBy("core").agg(F.sum("n").alias("m")).where("m > 1")
    told = pair.join(many, "core")
    finer = (F.col("n") < F.col("m")) & ((F.col("n") == 1) | (F.col("one") == one))
    repeated = (F.col("one.did") != F.col("last.did")) | (F.col("one.th") != F.col("last.th")) if apart else F.col("n") > 1
    out = stage(rows.join(told, ["core", "whole"]).select("did", "th", "anchor", "lo", "hi", repeated.alias("all"), finer.alias("finer")))
    unstage(pair)
    return out


def _stretches_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("parts"))  # of one document


def _passes(keyed: DataFrame, unit: Unit, apart: bool) -> tuple[DataFrame, DataFrame]:
    """The repeated stretches of keyed(did, th, text), and the texts that have any that may be."""
    rows = stage(keyed.mapInArrow(_first(unit), ROWS))
    told = [_sorted(rows, apart)]
    unstage(rows)
    texts = stage(keyed.join(told[0].select("did", "th").distinct(), ["did", "th"], "left_semi").dropDuplicates(["did", "th"]))
    for size in unit.cuts:
        rest = texts.join(_stretches_of(told[-1].where("finer")), ["did", "th"]).select("did", "th", "text", "parts")
        rows = stage(rest.mapInArrow(_finer(size, unit), ROWS))
        told.append(_sorted(rows, apart))
        unstage(rows)
    found = told[0].where("all")
    for t in told[1:]:
        found = found.unionByName(t.where("all"))
    found = stage(found.select("did", "th", "anchor", "lo", "hi"))
    unstage(*told)
    return found, texts


def repeated_bytes(docs: DataFrame, width: int = 400, passage_words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text).

    Each byte under a `width`-byte string that starts anywhere else as well, in the same text included, is removed;
    strings are judged on the input. Null and short texts lose nothing. A repeated row is another document with the
    same text, so both lose what they share; null doc_ids are allowed. Other columns are ignored, an empty table gives
    an empty result.

    With passage_words there is also `repeats`: whether so many words in a row stand in another text as well, however
    short they are. Such words are told, not removed. Rows with the same id and text are one text here.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("did"), F.xxhash64("text").alias("th"), "text", "doc_id")
    plain = keyed.select("did", "th", "text")
    base = keyed.select("doc_id", "did", "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_whole"))
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256")]
    if passage_words:
        passages, texts = _passes(plain, words_in(passage_words), apart=True)
        unstage(texts)
        base = base.join(passages.select("did", "th", F.lit(True).alias("_told")).distinct(), ["did", "th"], "left")
        columns.append(F.coalesce("_told", F.lit(False)).alias("repeats"))
    found, texts = _passes(plain, bytes_of(width), apart=False)
    cut = stage(texts.join(_stretches_of(found), ["did", "th"]).select("did", "th", "text", "parts").mapInArrow(_kept(width), "did long, th long, n_removed long, n_spans long, kept_sha256 string"))
    unstage(found, texts)
    return base.join(cut, ["did", "th"], "left").select(*columns)
