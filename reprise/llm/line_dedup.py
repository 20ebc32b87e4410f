"""Lines that many documents have, told by bitmaps instead of text.

Each line becomes a row (128-bit hash of its key, document, position, whether the key is new in its document). The rows
are range-partitioned by (hash, document, position) and sorted within their range, so that a line that a third of all
documents have is spread over as many ranges as its rows fill. A stream over each range counts first occurrences; a run
of one hash within a range is decided there. Only the runs at the two ends of a range can go on in another one: their
partial counts, two to a range, are summed in a table of their own and decide the few rows left open. Dropped positions
are ORed into 64-bit words before and after their shuffle, and come back as one compressed bitmap a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LOWER_BYTE, MASK, SPACE, U, chunks, mix, prefix_sums, stage, substring_hash, text_bytes, unstage

CHUNK = 1 << 20
#: A second, independent code for each byte value, A-Z folded.
LOWER_2 = mix(LOWER_BYTE ^ U(0xC2B2AE3D27D4EB4F))
ROWS = "h1 long, h2 long, did long, th long, pos int, fresh int"
TOLD = "kind int, h1 long, h2 long, did long, th long, pos int, df long"
DROPPED, EDGE, OPEN = 0, 1, 2


def line_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line: every row has one more than it has newlines."""
    nl = np.flatnonzero(data == 10)
    many = 1 + np.searchsorted(nl, at[1:]) - np.searchsorted(nl, at[:-1])
    row = np.repeat(np.arange(len(at) - 1), many)
    start = np.sort(np.concatenate([at[:-1], nl + 1]), kind="stable")
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[last] = at[1:]
    return start, end, row


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's key lies: the line without the blanks at both ends."""
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        return start, start
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    full = b >= a
    lo = np.where(full, solid[np.minimum(a, len(solid) - 1)], start)
    return lo, np.where(full, solid[np.maximum(b, 0)] + 1, lo)


def _hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key, CHUNK bytes at a time whatever the length of a line."""
    out = np.zeros((2, len(lo)), U)
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + CHUNK, "right")))
        if hi[j - 1] - lo[i] <= CHUNK:
            part = data[lo[i] : hi[j - 1]]
            for k, codes in enumerate((LOWER_BYTE, LOWER_2)):
                out[k, i:j] = substring_hash(prefix_sums(part, codes), lo[i:j] - lo[i], hi[i:j] - lo[i])
        else:  # one long line
            for k, codes in enumerate((LOWER_BYTE, LOWER_2)):
                total = sum(int(prefix_sums(data[p : min(p + CHUNK, hi[i])], codes)[-1]) * pow(BASE, int(p - lo[i]), 1 << 64) for p in range(int(lo[i]), int(hi[i]), CHUNK))
                out[k, i] = mix(np.array([total & MASK], U))[0]
        i = j
    return out[0].view(np.int64), out[1].view(np.int64)


def _lines(least_chars: int):
    """A row for each line whose key is long enough, and one for each document (h1 null) with its number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            flat, starts = text_bytes(batch.column(2))
            for i, j in chunks(starts, CHUNK):
                data, at = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                start, end, row = line_places(data, at)
                many = np.bincount(row, minlength=j - i)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                lo, hi = _keys(data, start, end)
                if least_chars > 1:  # code points: bytes that don't continue one
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    held = np.flatnonzero(points[hi] - points[lo] >= least_chars)
                else:
                    held = np.flatnonzero(hi - lo >= least_chars)
                row, pos = row[held], pos[held]
                h1, h2 = _hashes(data, lo[held], hi[held])
                order = np.lexsort((pos, h2, h1, row))
                r, a, b = row[order], h1[order], h2[order]
                fresh = np.ones(len(order), np.int32)
                fresh[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                cols = (a, b, did[i + r], th[i + r], pos[order].astype(np.int32), fresh)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "did", "th", "pos", "fresh"])
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(did[i:j]), pa.array(th[i:j]), pa.array(many.astype(np.int32)), pa.array(np.zeros(j - i, np.int32))], names=["h1", "h2", "did", "th", "pos", "fresh"])

    return run


def _streamed(least_docs: int, keep_first: bool):
    """Over rows in order: what is dropped, the partial counts of the range's end runs, and their rows that are still open."""

    def told(kind, cols, df=None):
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(c) for c in cols[:5]], pa.array(np.zeros(n, np.int64) if df is None else df)], names=[x.split()[0] for x in TOLD.split(", ")])

    class Run:
        """The unfinished run: its count so far, its first row, its rows until they are decided."""

        def __init__(self, rows, edge):
            self.key, self.first, self.edge, self.df, self.rows = (rows[0][0], rows[1][0]), [c[:1] for c in rows[:5]], edge, 0, []

        def add(self, rows, df):
            self.df += int(df)
            if self.rows is None:  # dropped already, and the first row isn't among these
                yield told(DROPPED, rows)
                return
            self.rows.append(rows)
            if self.df >= least_docs:
                every = [np.concatenate(x) for x in zip(*self.rows)]
                self.rows = None
                yield told(DROPPED, [c[int(keep_first) :] for c in every])

        def over(self, last):
            """At an end of the range a run stays open for what other ranges have."""
            if self.edge or last:
                yield told(EDGE, self.first, np.array([self.df], np.int64))
                if self.rows is not None:
                    yield told(OPEN, [np.concatenate(x) for x in zip(*self.rows)])
                elif keep_first:
                    yield told(OPEN, self.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if not len(rows[0]):
                continue
            cut = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows[0])]])
            df = np.add.reduceat(rows[5], lo)
            if now is None or now.key != (rows[0][0], rows[1][0]):
                if now is not None:
                    yield from now.over(False)
                now = Run(rows, edge=now is None)
            yield from now.add([c[: hi[0]] for c in rows], df[0])
            if len(lo) == 1:
                continue
            yield from now.over(False)
            drop = np.repeat(df[1:-1] >= least_docs, (hi - lo)[1:-1])  # runs that lie within this batch
            if keep_first:
                drop[lo[1:-1] - lo[1]] = False
            if drop.any():
                yield told(DROPPED, [c[lo[1] : lo[-1]][drop] for c in rows])
            rest = [c[lo[-1] :] for c in rows]
            now = Run(rest, edge=False)
            yield from now.add(rest, df[-1])
        if now is not None:
            yield from now.over(True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(2).to_numpy(zero_copy_only=False)
        dropped, keep = [], []
        for n, words in zip(lines.tolist(), batch.column(3)):
            bits = np.ones(n, np.uint8)
            if words.is_valid:
                for w in words.as_py():
                    low = w["word"] * 64
                    gone = np.unpackbits(np.array([w["bits"]], np.int64).view(np.uint8), bitorder="little")
                    bits[low : low + 64] &= 1 - gone[: max(0, n - low)]
            dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines.astype(np.int64)), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["did", "th", "n_lines", "n_dropped", "keep"])


def _known(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(did, th, n_lines, n_dropped, keep) for every document, told by its id (hash of the text where null) and its text's hash.

    Bit i of keep (zlib, lowest bit first) says whether line i stays. A line's key is the line without blanks at both
    ends, A-Z folded; keys of at least least_chars code points that at least least_docs documents have lose all their
    lines, or with keep_first all but the first by document and position. Every row of docs(doc_id, text) is a document,
    repeated rows too, though they share one bitmap (so with keep_first each of them keeps the first line). Null and
    empty texts have one empty line, which is never dropped. Other columns are ignored; an empty table gives no rows.
    """
    rows = stage(_known(docs).select("did", "th", "text").mapInArrow(_lines(least_chars), ROWS))
    order = ["h1", "h2", "did", "th", "pos"]
    in_order = rows.where("h1 is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    told = stage(in_order.mapInArrow(_streamed(least_docs, keep_first), TOLD))
    first = F.min(F.struct("did", "th", "pos")).alias("first")
    edges = told.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("df").alias("all"), first).where(F.col("all") >= least_docs)
    opened = told.where(F.col("kind") == OPEN).join(edges.select("h1", "h2", "first"), ["h1", "h2"])  # two runs to a range
    if keep_first:
        opened = opened.where(F.struct("did", "th", "pos") != F.col("first"))
    gone = told.where(F.col("kind") == DROPPED).select("did", "th", "pos").unionByName(opened.select("did", "th", "pos"))
    words = gone.groupBy("did", "th", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    words = words.groupBy("did", "th").agg(F.collect_list(F.struct("word", "bits")).alias("words"))  # of one document
    heads = rows.where("h1 is null").groupBy("did", "th").agg(F.max("pos").alias("n_lines"))
    out = stage(heads.join(words, ["did", "th"], "left").select("did", "th", "n_lines", "words").mapInArrow(_bitmaps, "did long, th long, n_lines long, n_dropped long, keep binary"))
    unstage(rows, told)
    return out


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column("text"))
            keep = batch.column("keep").to_pylist()
            out = []
            for r, packed in enumerate(keep):
                data = flat[starts[r] : starts[r + 1]]
                start, end, _ = line_places(data, np.array([0, len(data)]))
                stays = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(start), bitorder="little").astype(bool)
                if not stays.all():
                    data = _joined(data, start[stays], end[stays])
                out.append(data.tobytes().decode() if with_text else hashlib.sha256(data.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """These lines with a newline between each two, as bytes."""
    if not len(start):
        return data[:0]
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(len(at), np.uint8)
    out[first + size - 1] = 10
    return out[:-1]


def _applied(docs: DataFrame, bitmaps: DataFrame, with_text: bool) -> DataFrame:
    both = _known(docs).join(bitmaps, ["did", "th"]).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    return stage(both.mapInArrow(_kept(with_text), "doc_id long, n_lines long, n_dropped long, kept string"))


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row of docs: the text without the lines that its bitmap drops; null texts become empty."""
    return _applied(docs, bitmaps, True).withColumnRenamed("kept", "text")


def line_digests(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of docs(doc_id, text), by keep_bitmaps (which see)."""
    bitmaps = keep_bitmaps(docs, least_docs, least_chars)
    out = _applied(docs, bitmaps, False).withColumnRenamed("kept", "kept_sha256")
    unstage(bitmaps)
    return out
