"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

Pieces above a third of the capacity go at most two to a sequence and are paired greedily, longest first with the
longest partner that still fits; smaller pieces then best-fit the gaps, longest first. The plan is made on the
histogram of piece lengths, which has at most `capacity` rows at any corpus size: pieces of one length are
interchangeable, so the plan says "pieces number lo..hi of length L go to sequences s.. at offset o". Its steps are
bounded by the capacity alone, and each piece finds its step by its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stage, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE_BYTES = 1 << 25
#: What an entry takes beside its characters and ids: two objects and a place in the table.
ENTRY_BYTES = 220
CHUNK = 1 << 23
BUCKETS = 1024

#: Classes of bytes, for the places where a text can be cut without changing its tokens.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), *range(28, 33)]] = True
#: ASCII marks and digits; the apostrophe is left out, as it begins contractions.
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK[39] = False
MARK &= ~LETTER


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pre-tokens surely begin, row starts included: byte places that cut the rows into stretches to tokenise apart.

    A letter run is a pre-token's end, so what follows an ASCII letter and isn't one begins the next, and so does a
    letter after an ASCII mark or digit. White space after something else begins one too. A letter after a line feed
    begins one, and the stretch before keeps its tokens if the line feed stands alone.
    """
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        letter, white, ascii_ = LETTER[data], WHITE[data], data < 128
        solid = ascii_ & ~white  # before white space; some white space is longer in UTF-8, so other characters need a look
        last = data >= 128
        if last.any():
            third = np.zeros(len(data), bool)
            third[2:] = (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
            second = np.zeros(len(data), bool)
            second[1:] = (data[:-1] == 0xC2) | (data[:-1] >= 0xE1)
            solid |= last & ~third & ~second
        begins[1:-1] = (solid[:-1] & white[1:]) | (letter[:-1] & ascii_[1:] & ~letter[1:]) | (MARK[data[:-1]] & letter[1:])
        begins[2:-1] |= (ascii_[:-2] & ~white[:-2]) & (data[1:-1] == 10) & letter[2:]
    begins[at] = True
    return np.flatnonzero(begins)


_tokenizers: dict = {}


def tokenizer(path: str):
    """One for each worker process."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


class Encoder:
    """The ids of many stretches of text, each distinct one tokenised once while it is kept.

    It belongs to one task and goes with it. Beyond CACHE_BYTES of memory only the stretches of the latest batch stay,
    and the frequent ones are among them; if these alone are more, none.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def __call__(self, parts: list[str]) -> list[bytes]:
        known = self.known
        new = [p for p in parts if p not in known]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            for p, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                known[p] = np.array(e.ids, "<u4").tobytes()
        cost = lambda of: sum(2 * len(p) + len(known[p]) + ENTRY_BYTES for p in of)
        self.size += cost(new)
        out = [known[p] for p in parts]
        if self.size > CACHE_BYTES:
            self.size = cost(parts)
            self.known = dict(zip(parts, out)) if self.size <= CACHE_BYTES else {}
            self.size *= bool(self.known)
        return out


def token_ids(column: pa.Array, encode: Encoder) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, flat ids and row edges for runs of rows of about CHUNK bytes."""
    flat, starts = text_bytes(column)
    for i, j in chunks(starts, CHUNK):
        data, at = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        where = cuts(data, at)
        stretches = pa.LargeStringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))) if len(data) else pa.array([], pa.large_string())
        told = stretches.dictionary_encode()
        ids = encode(told.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(ids), "<u4")
        many = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = told.indices.to_numpy()
        first, n = (np.cumsum(many) - many)[code], many[code]
        place = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.repeat(first - place[:-1], n) + np.arange(place[-1])]
        yield i, out, place[np.searchsorted(where, at)]


def _tokenised(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, flat, edge in token_ids(batch.column(1), encode):
                out: tuple[list, ...] = ([], [], [], [], [])
                view = memoryview(flat).cast("B")
                for doc, lo, hi in zip(ids[i:], edge[:-1].tolist(), edge[1:].tolist()):
                    n = hi - lo + 1
                    first = n % capacity or capacity
                    marks = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(marks[:-1], marks[1:])):
                        crc = zlib.crc32(view[4 * (lo + a) : 4 * (lo + min(b, n - 1))])
                        for col, v in zip(out, (doc, piece, a, b - a, zlib.crc32(end, crc) if b == n else crc)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document's ids (a closing end_id included); only longer documents are cut, the first piece then takes the remainder."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenised(tokenizer_path, capacity, end_id), PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, offset) that place every piece of the histogram."""
    steps: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
    total = 0

    def put(n: int, count: int, seq: int, offset: int) -> None:
        steps.append((n, used[n], count, seq, offset))
        used[n] += count
        left[n] -= count

    def free(gap: int, seq: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((seq, count))

    order: list[int] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if left[m] and n + m <= capacity and (m < n or left[n] > 1)), None)
            count = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, count, total, 0)
            if partner is not None:
                put(partner, count, total, n)
            free(capacity - n - (partner or 0), total, count)
            total += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k < len(order):
                gap = order[k]
                seq, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
                now = min(count, left[n])
                put(n, now, seq, capacity - gap)
                free(gap - n, seq, now)
                free(gap, seq + now, count - now)
                continue
            each = capacity // n
            full = left[n] // each
            if full:
                for x in range(each):
                    put(n, full, total, x * n)
                free(capacity - each * n, total, full)
                total += full
            rest = left[n]
            if rest:
                for x in range(rest):
                    put(n, 1, total, x * n)
                free(capacity - rest * n, total, 1)
                total += 1
    return steps


def pack(told: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length, ...); each sequence is gapless from 0.

    The ranks come from counts per (length, bucket of documents), so a length that a third of all pieces share is
    numbered by many tasks. Repeated rows are packed as often as they occur; an empty table gives an empty result.
    """
    spark = told.sparkSession
    keyed = told.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    per = stage(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    steps = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("_at", F.row_number().over(within) - 1).join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_at") + F.col("_base"))
    schema = "length long, _lo long, _count long, _seq long, offset long"
    table = F.broadcast(spark.createDataFrame(steps, schema))  # bounded by the capacity alone
    inside = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_count"))
    placed = ranked.join(table.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside)
    out = placed.withColumn("sequence_id", F.col("_seq") + F.col("_rank") - F.col("_lo"))
    return out.select(*told.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack whole documents(doc_id, text): a row per piece with its place.

    Null and empty texts are the lone end id. Null doc_ids are kept as they are. Other columns are ignored.
    """
    return pack(stage(pieces(docs, tokenizer_path, capacity, end_id)), capacity)
