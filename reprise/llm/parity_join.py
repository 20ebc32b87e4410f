"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct k-word shingles. In each size band the hash space is cut into as many cells, and the
XOR of the shingles in a cell is a word of the document's parity sketch; its lowest bits, folded, are the bit sketch.
Two sets whose symmetric difference is D differ in at most D words and in at most D bits. For Jaccard >= J,
D <= (a+b)(1-J)/(1+J); so in any order that both documents agree on, the smallest word they share is among the first
t+1 of either, t being the bound (pigeonhole). Words are ordered by how many documents have them, rarest first, counted
exactly; a word of one document only joins nothing and never leaves the count. Candidates are cut by the Hamming
distance of bit sketches and the rest is verified on the whole shingle sets. No link is lost: the order of words
changes the work, never the result. The cells of a band are as wide as every document in it allows (t+1 words at
least); where even narrow ones don't do, as for sets of a few shingles, each shingle is a word.

Groups: exact copies of a set are one class. In each group of documents that share a sketch word every document is
verified against the group's most central member. The members of groups that are then in several components are
grouped anew, by the shingles of their whole sets: rarest first, and a shingle within one component counts as shared with
nobody. Of two sets that link, the first shingle they share has few enough before it in either, how few depends on both
sizes; so a set is filed under a shingle only for those classes of partner sizes that its place there allows. In these
groups further members go in turn, against the members of other components only, with sizes and bit sketches tested
inside the join. So a group of g near copies costs about g checks, and documents that share a passage but not enough of
it don't meet: what sets them apart stands before the passage in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import SPACE, U, chunks, mix, stage, text_bytes, unstage, word_hashes

CHUNK = 1 << 19
#: Cells of a band, as a power of two on top of its largest size; the last means that each shingle is a cell of its own.
WIDTHS = (-1, 1, 99)
BANDS = 16
COUNTED = 1 << 20
HUBS = 64
LISTED = 128
FOLD = 4
#: Classes of sizes for each doubling, for the partners that a shingle's place allows.
SIZES = 16
_MUL = mix(np.arange(11, 75, dtype=U))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and where each row starts."""
    rows = len(at) - 1
    wh, row = word_hashes(data, at, SPACE)
    many = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(many)])
    parts_h, parts_r = [], []
    if len(wh) >= k:
        i = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        h = np.zeros(len(i), U)
        for j in range(k):
            h += wh[i + j] * _MUL[j % 64]
        parts_h.append(mix(h))
        parts_r.append(row[i])
    short = np.flatnonzero((many > 0) & (many < k))
    if len(short):
        h = np.zeros(len(short), U)
        for j in range(k - 1):
            on = many[short] > j
            h[on] += wh[first[short[on]] + j] * _MUL[j % 64]
        parts_h.append(mix(h + many[short].astype(U) * U(0xA0761D6478BD642F)))
        parts_r.append(short)
    if not parts_h:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.argsort(r, kind="stable")
    h, r = h[order], r[order]
    edge = np.searchsorted(r, np.arange(rows + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(rows + 1))


def band_of(n: np.ndarray) -> np.ndarray:
    """Size band: 4**band <= n < 4**(band+1)."""
    return np.maximum(0, np.searchsorted(4 ** np.arange(1, 16, dtype=np.int64), n, "right"))


def roles(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, band, t): each row in its own band against partners there, and if those of the next band can be similar, there as well."""
    rows = np.flatnonzero(n >= 3)  # smaller sets are similar to equal ones only
    s, band = n[rows].astype(np.int64), band_of(n)[rows]
    top = 4 ** (band + 1).astype(np.int64)
    most = 4 * s // 3
    up = most >= top
    return [(rows, band, (s + np.minimum(most, top - 1)) // 7), (rows[up], band[up] + 1, (s[up] + most[up]) // 7)]


def _cells(h, edge, rows, band, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of these rows, flat, where each cell that isn't empty begins, and its row, with 2**(2*(band+1)+width) cells to a row."""
    many = edge[rows + 1] - edge[rows]
    first = np.concatenate([[0], np.cumsum(many)])
    own = np.repeat(np.arange(len(rows)), many)
    hh = h[edge[rows][own] + np.arange(len(own)) - first[own]]
    cell = hh >> np.maximum(0, 64 - (2 * (band + 1) + width))[own].astype(U)  # ascending, as hashes are sorted within a row
    new = np.ones(len(hh), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return hh, at, own[at]


def _words(h, edge, rows, band, width) -> tuple[np.ndarray, np.ndarray]:
    """The parity words of these rows, flat, and where each row's begin."""
    hh, at, own = _cells(h, edge, rows, band, width)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(rows) + 1, np.int64)
    word = mix(np.bitwise_xor.reduceat(hh, at) + (band[own].astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
    return word, np.searchsorted(own, np.arange(len(rows) + 1))


def _set_hash(h: np.ndarray, edge: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(salt)), dtype=U)])
    return (sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)


SALTS = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _profile(k: int):
    """Size, 128-bit set hash and bit sketch of each document; then, by band and width, this task's least number of words beyond t+1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((BANDS + 1, len(WIDTHS)), 1 << 30)
        for batch in batches:
            ids, (flat, starts) = batch.column(0), text_bytes(batch.column(1))
            for i, j in chunks(starts, CHUNK):
                at = starts[i : j + 1] - starts[i]
                h, edge = shingle_sets(flat[starts[i] : starts[j]], at, k)
                n = np.diff(edge)
                for rows, band, t in roles(n):
                    for w, width in enumerate(WIDTHS[:-1]):
                        np.minimum.at(least[:, w], band, np.bincount(_cells(h, edge, rows, band, width)[2], minlength=len(rows)) - t - 1)
                h1, h2 = (_set_hash(h, edge, x) for x in SALTS)
                bits = 4 ** (band_of(n) + 1)
                bits = np.maximum(64, bits)
                base = np.concatenate([[0], np.cumsum(bits)])
                row = np.repeat(np.arange(j - i), n)
                flips = np.bincount(base[row] + (h & (bits[row] - 1).astype(U)).astype(np.int64), minlength=base[-1]) & 1
                words = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)
                sketch = pa.ListArray.from_arrays(pa.array((base // 64).astype(np.int32)), pa.array(words))
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(h1), pa.array(h2), sketch, none, pa.nulls(j - i, pa.int64())], names=["doc_id", "n", "h1", "h2", "sketch", "width", "least"])
        band, w = (x.astype(np.int32) for x in np.nonzero(least < 1 << 30))
        none = pa.nulls(len(w), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(band), none, none, pa.nulls(len(w), pa.list_(pa.int64())), pa.array(w), pa.array(least[band, w])], names=["doc_id", "n", "h1", "h2", "sketch", "width", "least"])

    return run


def _keys(k: int, widths: np.ndarray):
    """(h1, band, t, words, edge) of each chunk and role; of exact copies within the task one stands for all."""

    def each(batches: Iterator[pa.RecordBatch]):
        seen: set = set()
        for batch in batches:
            flat, starts = text_bytes(batch.column("text"))
            for i, j in chunks(starts, CHUNK):
                h, edge = shingle_sets(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], k)
                n = np.diff(edge)
                own = _set_hash(h, edge, SALTS[0])
                fresh = np.zeros(j - i, bool)
                for r in np.flatnonzero(n >= 3).tolist():
                    # past the bound a copy is sent again, which is only more work
                    if (x := int(own[r])) not in seen:
                        fresh[r] = True
                        if len(seen) < 200_000:
                            seen.add(x)
                for rows, band, t in roles(np.where(fresh, n, 0)):
                    if len(rows):
                        word, at = _words(h, edge, rows, band, widths[band])
                        yield own[rows], band, t, word.view(np.int64), at

    return each


def _counted(k: int, widths: np.ndarray):
    """Each parity word with how many documents of this task have it, summed over COUNTED words at a time."""
    each = _keys(k, widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed():
            key, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(many.astype(np.int32))], names=["key", "many"])

        for *_, word, _ in each(batches):
            held.append(word)
            size += len(word)
            if size >= COUNTED:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    return run


def _postings(k: int, widths: np.ndarray):
    """Each parity word with the hash of its set, and how many words its band's list has beyond the t+1 that must stay."""
    each = _keys(k, widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, band, t, word, at in each(batches):
            many = np.diff(at)
            spare = ((band << 24) + (many - t - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.repeat(own, many)), pa.array(np.repeat(spare, many))], names=["key", "h1", "spare"])

    return run


def _sets(k: int):
    """The set of each document and its hash, which tells apart the texts of a repeated id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (flat, starts) = batch.column(0), text_bytes(batch.column(1))
            for i, j in chunks(starts, CHUNK):
                h, edge = shingle_sets(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], k)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(_set_hash(h, edge, SALTS[0])), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))], names=["rep", "h1", "grams"])

    return run


def similar():
    """Whether sizes na, nb and sketches sa, sb (whole or folded) allow the similarity; sketches of other bands say nothing."""
    apart = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & ((F.size("sa") != F.size("sb")) | (7 * apart <= F.col("na") + F.col("nb")))


def folded(sketch: str):
    """The sketch XORed down to FOLD words, after its length: flips still bound the symmetric difference from below."""
    part = lambda i: F.aggregate(F.filter(sketch, lambda x, at: at % FOLD == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    return F.when(F.size(sketch) <= FOLD, F.col(sketch)).otherwise(F.array(*[part(i) for i in range(FOLD)]))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bit sketches allow the similarity."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").where(similar()).select("a", "b", "na", "nb")


def _whole(need: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Classes (node, rep, h1 and more), each with its whole shingle set."""
    texts = docs.join(need.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return texts.mapInArrow(_sets(k), "rep long, h1 long, grams array<long>").join(need, ["rep", "h1"]).drop("rep", "h1").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes that link, by their whole shingle sets(node, grams)."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    shared = F.size(F.array_intersect("ga", "gb"))
    return stage(both.select("a", "b", "na", "nb", shared.alias("i")).where("100 * i >= 75 * (na + nb - i)").select("a", "b"))


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text), linking at Jaccard >= 0.75.

    Null or wordless text: no shingles, linked with nothing. Fewer than k words: the whole sequence is one shingle.
    Repeated rows come back as often as they came in; rows with one id and other texts are one document in the graph of
    links, so what links with any of them is in their component. Rows without a doc_id join no links of near copies and have the
    component of their exact copies. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stage(docs.mapInArrow(_profile(k), "doc_id long, n int, h1 long, h2 long, sketch array<long>, width int, least long"))
    rows = told.where("width is null")
    # the widest cells that leave t+1 words to every document of the band; at most BANDS * len(WIDTHS) rows
    fits = {(r["n"], r["width"]) for r in told.where("width is not null").groupBy("n", "width").agg(F.min("least").alias("least")).where("least >= 0").collect()}
    widths = np.array([next((w for i, w in enumerate(WIDTHS) if (b, i) in fits), WIDTHS[-1]) for b in range(BANDS + 1)])
    # a class of equal sets is a node, under a number of its own: an id can have several texts
    same = ["n", "h1", "h2"]
    classes = stage(rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    texts = docs.where("doc_id is not null")
    # summed within tasks before the shuffle
    counts = stage(texts.mapInArrow(_counted(k, widths), "key long, many int").repartition("key").groupBy("key").agg(F.sum("many").alias("df")).where("df > 1"))
    # AQE splits a word that many documents share
    shared = texts.mapInArrow(_postings(k, widths), "key long, h1 long, spare int").join(counts, "key")
    rarest = F.row_number().over(Window.partitionBy("h1", "spare").orderBy(F.desc("df"), "key"))  # the words of one document
    # copies in other tasks have sent the same words; dealt as the window deals, so that there is no shuffle for it
    shared = shared.repartition("h1", "spare").dropDuplicates(["h1", "spare", "key"])
    kept = stage(shared.withColumn("at", rarest).where(F.col("at") > F.col("spare").bitwiseAND(F.lit((1 << 24) - 1))).select("key", "h1"))
    unstage(counts)
    nodes = stage(rows.join(classes, same).where("doc_id = rep").select("node", "rep", "h1", "n", "sketch").dropDuplicates(["node"]))
    sized = kept.join(classes.where("rep is not null").select("h1", "node"), "h1").select("key", "node").distinct()
    many = stage(sized.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"))
    sized = stage(sized.join(many, "key"))
    unstage(kept, many)
    # a group's hub is its most central member: the one whose words most others share
    central = sized.groupBy("node").agg(F.sum("g").alias("pop"))
    sized = stage(sized.join(central, "node").select("key", "node", "pop"))
    hub = sized.groupBy("key").agg(F.max(F.struct("pop", F.negative("node").alias("x"))).alias("m")).select("key", F.negative("m.x").alias("hub"))
    posts = stage(sized.join(hub, "key"))
    unstage(sized)

    first = posts.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    first = stage(_plausible(first, nodes))
    need = nodes.select("node", "rep", "h1").join(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    sets = stage(_whole(need, docs, k))
    links = _verified(first, sets)
    unstage(first, sets)
    links, comp = _finish(links, posts, nodes, docs, k)
    # the texts of one id are one document
    named = stage(rows.select("doc_id", *same).join(classes, same, "left"))
    several = named.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most")
    if not (several := stage(several)).isEmpty():
        comp = components(links.unionByName(named.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()))
    least = classes.join(comp, "node").groupBy("component").agg(F.min("rep").alias("first"))
    label = comp.join(least, "component").select("node", "first")
    unstage(posts, nodes, links, several)
    out = named.join(label, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("first", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _regrouped(sets: DataFrame) -> DataFrame:
    """(key, meet, side, node, component): classes sets(node, n, component, grams) that link across components meet, the key of one being the other's meet.

    Shingles are ordered by how many of these classes have them, those within one component first. Sets a and b that link
    share 3(a+b)/7 or more; before the first one they share, a set of size n has `at` others, so 7(n-at) >= 3(a+b): the
    other's size is at most (4n-7at)/3, and at least 3n/4.
    """
    grams = sets.select("node", "n", "component", F.explode("grams").alias("gram"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    held = grams.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df"), *same).where("lo <> hi")
    # an order of shingles in which those with the same members stand together; the first stands for them all
    word = F.shiftleft(F.least("df", F.lit((1 << 23) - 1)), 40) + F.col("x1").bitwiseAND(F.lit((1 << 40) - 1))
    last = Window.partitionBy("node").orderBy(F.desc("word"), F.desc("x2"), F.desc("gram"))
    placed = grams.join(held.select("gram", word.alias("word"), "x2"), "gram")
    placed = placed.withColumn("at", F.col("n") - F.row_number().over(last)).withColumns({f"_{c}": F.lead(c).over(last) for c in ("word", "x2")})
    placed = placed.where("_word is null or _word <> word or _x2 <> x2").select("*", F.expr("(3 * n + 3) div 4").alias("least"), F.expr("(4 * n - 7 * at) div 3").alias("most"))
    kind = lambda n: F.floor(F.log2(n) * SIZES).cast("int")
    filed = placed.where("least <= most").withColumn("own", kind("n")).withColumn("other", F.explode(F.sequence(kind("least"), kind("most"))))
    return stage(filed.select(F.xxhash64("word", "x2", "own", "other").alias("key"), F.xxhash64("word", "x2", "other", "own").alias("meet"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "node", "component"))


def _finish(links, posts, nodes, docs, k):
    """Go on with the groups whose members the first checks left in several components."""
    comp = components(links)

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))

    told = stage(labelled(posts.select("key", "node")))
    # the first checks have tested groups of two
    split = told.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("g")).where("lo <> hi and g > 2")
    left = stage(told.join(split.select("key"), "key", "left_semi").select("node", "component").distinct())
    unstage(told)
    if left.isEmpty():
        return links, comp
    # read once: what is verified later is among them
    sets = stage(_whole(left.join(nodes.select("node", "rep", "h1", "n"), "node"), docs, k))
    every = _regrouped(sets)
    unstage(left)
    told = every.withColumn("group", F.least("key", "meet"))
    # groups with the same members are one: it is told by a 128-bit hash of its members
    same = [F.bit_xor(F.xxhash64("node", "side", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    split = told.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("side").alias("under"), F.max("side").alias("over"), F.count("*").alias("g"), *same)
    split = split.where("lo <> hi and under <= 0 and over >= 0").groupBy("g", "x1", "x2").agg(F.min("group").alias("group")).select("group")
    told = stage(told.join(split, "group", "left_semi"))
    unstage(every)
    # hubs to come: all but the members of the group's largest component
    size = told.groupBy("group", "component").agg(F.count("*").alias("size"))
    main = size.groupBy("group").agg(F.max(F.struct("size", F.negative("component").alias("x"))).alias("m")).select("group", F.negative("m.x").alias("main"))
    later = told.join(main, "group").where("component <> main").select("group", "key", F.col("node").alias("hub"))
    # their turns are drawn by hash from as many as the group has, so that no group has to be sorted in one task
    draw = F.pmod(F.xxhash64("group", "hub"), F.col("many")).alias("rank")
    hubs = stage(later.join(later.groupBy("group").agg(F.count("*").alias("many")), "group").select("key", "hub", draw))
    # a pair that shares many words comes out of the join under its first one only; documents with long lists go without, and distinct() has their pairs
    words = lambda c: F.when(F.count("*") <= LISTED, F.collect_list(c))  # noqa: E731  at most as many as the document's own shingles, for each class of sizes
    listed = told.groupBy("node").agg(words("meet").alias("words"))
    members = stage(told.select("key", "meet", "node").join(nodes.withColumn("sketch", folded("sketch")), "node").join(listed, "node"))
    most = hubs.agg(F.max("rank")).first()[0]
    at, step, tested = 0, HUBS, None
    one = [F.col("meet").alias("kb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("component").alias("cb"), F.col("words").alias("wb")]
    fits = (F.col("ca") != F.col("cb")) & similar()
    once = F.expr("coalesce(array_min(array_intersect(wa, wb)) = key, true)")
    while most is not None and at <= most:
        now = labelled(members)
        h = hubs.where(F.col("rank").between(at, at + step - 1)).select("key", F.col("hub").alias("node"))
        h = h.join(h.groupBy("node").agg(words("key").alias("wa")), "node").join(now, ["key", "node"])
        h = h.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("component").alias("ca"), "wa")
        pairs = h.join(now.select(*one), (F.col("key") == F.col("kb")) & fits & once)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(_plausible(pairs, nodes))
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        new = _verified(pairs, sets.select("node", "grams")) if pairs.limit(1).count() else None
        if new is not None and new.limit(1).count():
            links = stage(links.unionByName(new))
            comp = components(links)
        at, step = at + step, step * 4
    unstage(sets)
    return links, comp
