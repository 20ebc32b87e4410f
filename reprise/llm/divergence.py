"""How far the sources of a language differ in their terms: sort-based streaming over runs.

Within a task, blocks of whole documents are sorted by (lang, source, term, document), and a run-length scan turns each
run into one row (count, documents); runs of later blocks are added until the task holds MOST_RUNS. What tasks send is
sorted by (lang, term, source) in two passes: the first, dealt by all three, adds the runs of one term in one source,
however many tasks have it; the second, dealt by (lang, term), has a row per source of a term and keeps the terms of
enough documents. A last scan over the kept runs, joined with the totals of their groups, folds the pairs of sources
that share a term into partial sums, a row per pair and task. A source without a term has the same small share of it
for every such term, so those parts follow from how many terms of a source have each share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTE, U, chunks, mix, prefix_sums, stage, substring_hash, text_bytes, unstage, words_of

BLOCK = 4 << 20
PIECE = 1 << 20
MOST_RUNS = 1 << 20
MOST_PAIRS = 1 << 20
SCALE = 1_000_000_000
#: Bytes that set terms apart: everything but A-Z, a-z and the bytes of longer UTF-8 sequences.
APART = np.ones(256, bool)
APART[65:91] = APART[97:123] = APART[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
RUNS = "lang string, term string, source string, many long, docs long"
NAMES = ["lang", "term", "source", "many", "docs"]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """These stretches of the bytes, A-Z lower-cased."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(LOWER[data[at]])))


def _scan(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> list:
    """Runs of (group, term): [key, group, count, documents, terms], by a sort on (group and term, document)."""
    start, end, row = words_of(data, at, APART)
    h = substring_hash(prefix_sums(data, LOWER_BYTE), start, end)
    key = mix(h + group[row].astype(U) * U(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")  # documents stay in order
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    fresh = new.copy()
    fresh[1:] |= r[1:] != r[:-1]
    i = np.flatnonzero(new)
    one = order[i]
    return [k[i], group[row[one]], np.diff(np.append(i, len(k))), np.add.reduceat(fresh, i, dtype=np.int64) if len(i) else np.zeros(0, np.int64), _strings(data, start[one], end[one])]


def _merged(parts: list) -> list:
    """Runs of several scans as runs, sorted by key."""
    key = np.concatenate([p[0] for p in parts])
    order = np.argsort(key, kind="stable")
    i = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    adds = [np.add.reduceat(np.concatenate([p[k] for p in parts])[order], i) if len(i) else np.zeros(0, np.int64) for k in (2, 3)]
    one = order[i]
    return [key[one], np.concatenate([p[1] for p in parts])[one], *adds, pa.concat_arrays([p[4] for p in parts]).take(pa.array(one))]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about PIECE bytes, cut before a byte that sets terms apart."""
    at = 0
    while at < len(data):
        to = at + PIECE
        while to < len(data) and not len(gap := np.flatnonzero(APART[data[to : to + PIECE]])):
            to += PIECE
        to = len(data) if to >= len(data) else to + int(gap[0])
        yield data[at:to]
        at = to


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, groups = [], {}
    held, size = [], 0

    def sent():
        _, g, many, docs, terms = _merged(held)
        lang, source = (pa.array([n[k] for n in names], pa.string()).take(pa.array(g)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, terms.cast(pa.string()), source, pa.array(many.astype(np.int64)), pa.array(docs)], names=NAMES)

    for batch in batches:
        flat, starts = text_bytes(batch.column(0))
        own = []
        for name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if name not in groups:
                groups[name] = len(names)
                names.append(name)
            own.append(groups[name])
        own = np.array(own, np.int64)
        for i, j in chunks(starts, BLOCK):
            data, at, group = flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], own[i:j]
            if len(data) > BLOCK:  # one long text: its pieces are one document
                run = _merged([_scan(p, np.array([0, len(p)]), group) for p in _pieces(data)])
                run[3] = np.ones(len(run[0]), np.int64)
            else:
                run = _scan(data, at, group)
            held.append(run)
            size += len(run[0])
            if size >= 2 * MOST_RUNS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size >= MOST_RUNS:
                    yield sent()
                    held, size = [], 0
    if held:
        yield sent()


def _edges(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in these columns; the first row counts as differing."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        new[1:] = False
        for c in columns:
            x = batch.column(c)
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return new


def _joined(held: list[pa.RecordBatch], batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term, source) with their counts added; only the last, unfinished run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            both = _joined(held, batch)
            i = np.flatnonzero(_edges(both, ["lang", "term", "source"]))
            sums = [np.add.reduceat(both.column(c).to_numpy(), i) for c in ("many", "docs")]
            out = pa.RecordBatch.from_arrays([*[both.column(c).take(pa.array(i)) for c in NAMES[:3]], *map(pa.array, sums)], names=NAMES)
            held = [out.slice(len(i) - 1)]
            yield out.slice(0, len(i) - 1)
    yield from held


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs of (lang, term), each with where its runs begin; a run has a row per source."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            both = _joined(held, batch)
            i = np.flatnonzero(_edges(both, ["lang", "term"]))
            held = [both.slice(int(i[-1]))]
            if len(i) > 1:
                yield both.slice(0, int(i[-1])), i[:-1]
    for x in held:
        yield x, np.zeros(1, np.int64)


def _frequent(least_docs: int):
    """The rows of terms that enough documents of the language have, with the language's count; `head` marks a term's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i in _whole(batches):
            size = np.diff(np.append(i, b.num_rows))
            keep = np.repeat(np.add.reduceat(b.column("docs").to_numpy(), i) >= least_docs, size)
            every = np.repeat(np.add.reduceat(b.column("many").to_numpy(), i), size)
            head = np.zeros(b.num_rows, bool)
            head[i] = True
            out = pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(every), pa.array(head)], names=["lang", "term", "source", "many", "lang_many", "head"])
            yield out.filter(pa.array(keep))

    return run


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums, for each pair of sources that share terms, of what those terms say beyond the shares of absent ones."""
    codes: dict = {}
    names: list = []
    total: Counter = Counter()

    def sent():
        keys = list(total)
        told = [[names[a][0] for a, _ in keys], [names[a][1] for a, _ in keys], [names[b][1] for _, b in keys]]
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in told], pa.array([total[k] for k in keys], pa.int64())], names=["lang", "source", "other", "beyond"])

    for b, i in _whole(batches):
        own = np.empty(b.num_rows, np.int64)
        for at, name in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
            if name not in codes:
                codes[name] = len(names)
                names.append(name)
            own[at] = codes[name]
        p, p0 = b.column("p").to_numpy(), b.column("p0").to_numpy()
        end = np.repeat(np.append(i[1:], b.num_rows), np.diff(np.append(i, b.num_rows)))
        later = end - np.arange(b.num_rows) - 1  # sources after this one in its run
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(np.cumsum(later[at:]), MOST_PAIRS, "right")) + at)
            many = later[at:to]
            x = np.repeat(np.arange(at, to), many)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            beyond = _gap(p[x], p[y]) - _gap(p[x], p0[y]) - _gap(p0[x], p[y]) + _gap(p0[x], p0[y])
            pair, which = np.unique(own[x] * len(names) + own[y], return_inverse=True)
            sums = np.zeros(len(pair), np.int64)
            np.add.at(sums, which, beyond)
            for k, v in zip(pair.tolist(), sums.tolist()):
                total[divmod(k, len(names))] += v
            at = to
            if len(total) >= MOST_PAIRS:
                yield sent()
                total.clear()
    if total:
        yield sent()


def _share(many: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (many + 2) / (total + 2 * terms)), in whole numbers of any size."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (many + 2).cast("decimal(20,0)")
    return F.call_function("div", part, (total + 2 * terms).cast("decimal(20,0)")).cast("long") + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source stands from each other source of its language, and by which terms.

    Terms are maximal runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased; a language keeps those that at least
    least_docs of its documents have. Null text, lang and source are ''. Part `pair`: every other source of the language,
    ranked by distance summed over all kept terms; part `term`: the `top` terms a source has more often than its language.
    Every row of docs(text, lang, source) is a document, repeated rows as well. Sources of documents without terms take
    part with counts of zero; without kept terms distances are 0 and there are no terms. Ties go to the smaller item.
    Other columns are ignored; an empty table gives no rows.
    """
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    runs = filled.mapInArrow(_runs, RUNS)
    runs = runs.repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source").mapInArrow(_added, RUNS)
    kept = stage(
        runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
        .mapInArrow(_frequent(least_docs), "lang string, term string, source string, many long, lang_many long, head boolean")
    )
    langs = kept.groupBy("lang").agg(F.sum("many").alias("lang_total"), F.count_if("head").alias("terms"))
    groups = filled.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("many").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total")
    groups = stage(groups.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))))
    shared = kept.join(groups, ["lang", "source"])
    shares = stage(
        shared.select("lang", "term", "source", "p0", _share(F.col("many"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_many"), F.col("lang_total"), F.col("terms")).alias("q"))
    )
    ordered = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    beyond = ordered.mapInArrow(_pairs, "lang string, source string, other string, beyond long")
    beyond = beyond.unionByName(beyond.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "beyond")).groupBy("lang", "source", "other").agg(F.sum("beyond").alias("beyond"))
    # how many of a source's terms have each share, against the share that another source has of a term it lacks
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    alone = levels.join(other, "lang").where("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.col("n") * (_apart(F.col("p"), F.col("other_p0")) - _apart(F.col("p0"), F.col("other_p0")))).alias("alone"))
    pairs = groups.join(other, "lang").where("source <> other").select("lang", "source", "other", F.coalesce(F.col("terms") * _apart(F.col("p0"), F.col("other_p0")), F.lit(0)).alias("base"))
    key = ["lang", "source", "other"]
    back = alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("alone").alias("back"))
    for part in (alone, back, beyond):
        pairs = pairs.join(part, key, "left")
    value = F.col("base") + F.coalesce("alone", F.lit(0)) + F.coalesce("back", F.lit(0)) + F.coalesce("beyond", F.lit(0))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value")).withColumn("rank", place)
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top)  # cut to `top` a group before the shuffle as well
    out = stage(pairs.unionByName(terms))
    unstage(kept, groups, shares)
    return out
