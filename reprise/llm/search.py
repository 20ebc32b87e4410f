"""Nearest neighbours by stable projections and a kd-tree, and exact top-k by the threshold algorithm.

Both answer a stated query set against all rows. Rows are dealt into blocks of bounded size, each row into one; the
queries go to every block. A block's rows come first and make its index once, the queries then stream past it in Arrow
batches; each block answers with its own k best, and a window per query merges them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.queues import numbered
from .common import stage

RESULT = "query_id long, vec_id long, score {score}, place binary"
#: Of ids and vectors, ascending by id, makes what answers queries (ids, vectors) with query numbers, places and scores.
Index = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list]]]


def usable(rows: DataFrame, zero_too: bool) -> DataFrame:
    """Rows with an id, a vector, and only finite components; zero_too keeps the zero vector."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if zero_too else rows.where(F.exists("v", lambda x: x != 0))


def _answered(index: Index, score: pa.DataType):
    """Answers the queries of each block in turn; rows of a block come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, [], {}
        for batch in batches:
            block, asks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("block", "asks"))
            edge = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edge], [*edge, len(block)]):
                if lo == hi:
                    continue
                if block[lo] != now:
                    now, held, made = block[lo], [], {}
                part = batch.slice(lo, hi - lo)
                ids, flat = part.column("vec_id").to_numpy(), part.column("v")
                at = flat.offsets.to_numpy()
                values, width = flat.flatten().to_numpy(), np.diff(at)
                # vectors of other lengths have no inner product
                some = {int(w): (ids[on], values[(at[:-1][on] - at[0])[:, None] + np.arange(w)]) for w in np.unique(width) for on in [width == w]}
                if not asks[lo]:
                    held.append(some)
                    continue
                for w, (qid, qv) in some.items():
                    if w not in made:
                        mine = [x[w] for x in held if w in x]
                        if mine:
                            ids, v = np.concatenate([x for x, _ in mine]), np.concatenate([x for _, x in mine])
                            order = np.argsort(ids, kind="stable")
                            made[w] = ids[order], index(ids[order], v[order])
                        else:
                            made[w] = None
                    if made[w]:
                        ids, answer = made[w]
                        who, places, scores = answer(qid, qv)
                        exact = score == pa.int64()
                        told = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores] if exact else scores
                        key = pa.array([sortable(int(x)) for x in scores] if exact else [None] * len(who), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(qid[who], pa.int64()), pa.array(ids[places], pa.int64()), pa.array(told, score), key], names=["query_id", "vec_id", "score", "place"])

    return run


def sortable(n: int) -> bytes:
    """Bytes in the order of the whole numbers they stand for, of any size."""
    size = (abs(n).bit_length() + 7) // 8
    raw = abs(n).to_bytes(size, "big")
    return (32768 + size).to_bytes(2, "big") + raw if n >= 0 else (32768 - size).to_bytes(2, "big") + bytes(255 - x for x in raw)


def blocked(rows: DataFrame, every: int, per_block: int, index: Index, k: int, exact: bool) -> DataFrame:
    """The k best answers of every query among all rows, ties to the smaller vec_id.

    Rows are known by their place in the order of vec_id, so that of rows with one id each is a query, and a candidate
    of the others.
    """
    rows = stage(numbered(rows.withColumn("row", F.monotonically_increasing_id()), "vec_id", "row", name="place").drop("row"))
    blocks = max(1, math.ceil(rows.count() / per_block))
    vector = [F.col("place").alias("vec_id"), "v"]
    asked = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), *vector)
    dealt = rows.select(F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), *vector)
    both = dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    score = ("long", pa.int64()) if exact else ("double", pa.float64())
    found = both.mapInArrow(_answered(index, score[1]), RESULT.format(score=score[0]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place" if exact else "score"), "vec_id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").alias("q"), "rank", F.col("vec_id").alias("c"), "score")
    name = lambda at, to: rows.select(F.col("place").alias(at), F.col("vec_id").alias(to))
    return top.join(name("q", "query_id"), "q").join(name("c", "vec_id"), "c").select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def inner(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors have equal scores."""
    return np.einsum("ij,j->i", rows, q, optimize=False)


# ---------------------------------------------------------------- stable projections and a kd-tree


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of dimensions, in closed form."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for j in range(1, dims // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def kd_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A balanced kd-tree as its leaves: the order of points, where each leaf starts, and each leaf's box."""
    parts, leaves = [np.arange(len(points))], []
    while parts:
        at = parts.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        box = points[at]
        dim = int(np.argmax(box.max(0) - box.min(0)))
        order = np.argsort(box[:, dim], kind="stable")
        parts += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
    order = np.concatenate(leaves)
    low, high = np.minimum.reduceat(points[order], starts[:-1]), np.maximum.reduceat(points[order], starts[:-1])
    return order, starts, low, high


def chi_square_limit(sure: float, dims: int) -> float:
    """Where the distribution reaches `sure`."""
    lo, hi = 0.0, 64.0 * dims
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square_cdf(np.array(mid), dims) >= sure else (mid, hi)
    return hi


def projected_index(k: int, dims: int, sure: float, leaf: int, seed: int) -> Index:
    """Verifies projected neighbours from the nearest on, until the chi-square test holds.

    The largest inner product is the smallest distance once candidates get one more component that makes their norms
    equal. A Gaussian projection to `dims` dimensions makes (projected distance / distance)**2 chi-square distributed,
    so once every row within projected distance r is verified, a row nearer than the kth, at distance d, is still
    unseen with probability at most 1 - cdf(r*r/d*d); a query is done when the cdf is `sure`. The tree gives its leaves
    in the order of their distance; in a leaf only rows within the r of the moment are verified. As d only falls, so
    does r, and what was left out stays out.
    """

    def make(ids: np.ndarray, v: np.ndarray):
        # by a power of two, so that no square overflows and no digit is lost
        scale = 2.0 ** -max(-900, math.frexp(np.abs(v).max())[1])
        v = v * scale
        norm = np.einsum("ij,ij->i", v, v)
        most = norm.max()
        space = np.random.default_rng(seed).standard_normal((v.shape[1] + 1, dims))
        flat = np.hstack([v, np.sqrt(np.maximum(0, most - norm))[:, None]]) @ space
        order, starts, low, high = kd_tree(flat, leaf)
        v, own, flat = v[order], ids[order], flat[order]
        length = np.einsum("ij,ij->i", flat, flat)
        limit = chi_square_limit(sure, dims)

        def answer(qid: np.ndarray, qv: np.ndarray):
            unit = 2.0 ** -np.maximum(-900, np.frexp(np.abs(qv).max(1))[1].astype(float))[:, None]
            full, qv = qv, qv * unit
            # the transform needs queries no longer than candidates; their length changes no order
            qn = np.einsum("ij,ij->i", qv, qv)
            at = qv @ space[:-1]
            gap = np.zeros((len(qv), len(low)))
            for d in range(dims):
                x = at[:, d : d + 1]
                gap += np.maximum(0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
            turn = np.argsort(gap, axis=1, kind="stable")
            gap = np.take_along_axis(gap, turn, 1)
            al = np.einsum("ij,ij->i", at, at)
            keep = min(k, len(v))
            top_s, top_i = np.full((len(qv), keep), -np.inf), np.full((len(qv), keep), -1)
            within = np.full(len(qv), np.inf)
            active, done, wave = np.arange(len(qv)), 0, max(1, math.ceil(4 * k / leaf))
            while len(active) and done < len(low):
                mine = turn[active, done : done + wave]
                who, which = np.repeat(active, mine.shape[1]), mine.ravel()
                by = np.argsort(which, kind="stable")
                who, which = who[by], which[by]
                edge = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
                for a, b in zip(edge[:-1], edge[1:]):
                    lo, hi, rows = starts[which[a]], starts[which[a] + 1], who[a:b]
                    far = al[rows][:, None] + length[lo:hi] - 2 * (at[rows] @ flat[lo:hi].T)
                    near = (far <= within[rows][:, None] * (1 + 1e-9) + 1e-9) & (qid[rows][:, None] != own[None, lo:hi])  # a query is no candidate of its own
                    x, y = np.nonzero(near)
                    score = np.einsum("ij,ij->i", qv[rows[x]], v[lo + y])
                    better = score >= top_s[rows[x], -1]
                    x, y, score = x[better], y[better], score[better]
                    cut = np.searchsorted(x, np.arange(len(rows) + 1))
                    for z in np.flatnonzero(np.diff(cut)):
                        r, new = rows[z], slice(cut[z], cut[z + 1])
                        old = top_i[r] >= 0
                        places = np.concatenate([top_i[r][old], lo + y[new]])
                        all_s = np.concatenate([top_s[r][old], score[new]])
                        pick = best(own[places], all_s, keep)
                        top_s[r, : len(pick)], top_i[r, : len(pick)] = all_s[pick], places[pick]
                done += mine.shape[1]
                kth = qn[active] + most - 2 * top_s[active, -1]
                within[active] = np.where(np.isfinite(kth), limit * np.maximum(kth, 1e-12), np.inf)
                if done < len(low):
                    active = active[gap[active, done] <= within[active]]
                wave = min(2 * wave, 16)
            who, col = np.nonzero(top_i >= 0)
            places = top_i[who, col]
            # each score as all scores are: components in order, on the vectors as they came
            return who, order[places], np.einsum("ij,ij->i", full[who], v[places] / scale)

        return answer

    return make


def nearest(rows: DataFrame, k: int = 20, every: int = 20, dims: int = 16, sure: float = 0.9, leaf: int = 64, seed: int = 11, per_block: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k rows of largest inner product found.

    Vectors that are null, zero, or hold null or non-finite components take no part; vectors of other lengths than the
    query's are no candidates. Ties go to the smaller vec_id; repeated ids are rows of their own. An empty table gives
    an empty result. Nothing is fitted: the projections are random with a fixed seed, and every row is indexed. `sure`
    is the chance that the kth neighbour isn't missed; nearer ones are missed less often.
    """
    rows = stage(usable(rows, zero_too=False))
    return blocked(rows, every, per_block, projected_index(k, dims, sure, leaf, seed), k, exact=False)


# ---------------------------------------------------------------- the threshold algorithm


def whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles, or as whole numbers of any size where doubles can't hold them all."""
    with np.errstate(over="ignore"):
        out = np.floor(v * scale)
    if np.abs(out).max(initial=0) < 1 << 53:
        return out
    return np.array([[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in v.tolist()], object)


def threshold_index(k: int, step: int, scale: int) -> Index:
    """Fagin's threshold algorithm over one block's sorted lists, one per dimension.

    The lists of a query are read from the end that raises its score, `step` entries deeper each round; every row met
    for the first time is scored in full. No unseen row can score more than the lists' current entries together, so
    the search stops when that bound is below the kth score (at equality it goes on: a tie might have a smaller id).
    """

    def make(ids: np.ndarray, raw: np.ndarray):
        v = whole(raw, scale)
        large = float(max(np.abs(v).max(), 1)) if v.dtype != object else np.inf
        lists = np.argsort(v, axis=0, kind="stable").T
        n, width = v.shape
        objects = v.astype(object) if v.dtype == object else None

        def answer(qid: np.ndarray, qraw: np.ndarray):
            nonlocal objects
            out_q, out_i, out_s = [], [], []
            for at, i in enumerate(qid):
                q, rows_v = whole(qraw[at : at + 1], scale)[0], v
                if q.dtype == object or large * max(np.abs(q).max(), 1) * width >= 1 << 53:  # sums might not be exact as doubles
                    if objects is None:
                        objects = np.array([[int(x) for x in row] for row in v.tolist()], object)
                    q, rows_v = np.array([int(x) for x in q.tolist()], object), objects
                dims = np.flatnonzero(q != 0)
                seen = ids == i
                top_i, top_s = np.zeros(0, np.int64), np.zeros(0, q.dtype)
                depth, grow = 0, step
                mine = [lists[d] if q[d] < 0 else lists[d][::-1] for d in dims]
                while True:
                    to = min(n, depth + grow)
                    if len(dims):
                        fresh = np.zeros(n, bool)
                        fresh[np.concatenate([m[depth:to] for m in mine])] = True
                        fresh &= ~seen
                    else:
                        fresh = ~seen
                    new = np.flatnonzero(fresh)
                    seen |= fresh
                    if len(new):
                        rows, scores = np.concatenate([top_i, new]), np.concatenate([top_s, rows_v[new] @ q])
                        pick = best(ids[rows], scores, k)
                        top_i, top_s = rows[pick], scores[pick]
                    depth, grow = to, 2 * grow
                    if depth >= n or not len(dims) or seen.all() or (len(top_s) == k and sum(q[d] * rows_v[m[depth - 1], d] for d, m in zip(dims, mine)) < top_s[-1]):
                        break
                out_q.append(np.full(len(top_i), at))
                out_i.append(top_i)
                out_s += top_s.tolist()
            return np.concatenate(out_q), np.concatenate(out_i), out_s

        return answer

    return make


def exact_top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256, step: int = 16, per_block: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k highest integer inner products.

    Components become floor(scale * x). Where sums could pass 2**53 they are added as whole numbers of any size, so the
    order is exact for every finite vector; a score beyond the range of a long is shown as that range's end. Vectors
    that are null or hold null or non-finite components take no part, the zero vector does; vectors of other lengths
    than the query's are no candidates. Ties go to the smaller vec_id; repeated ids
    are rows of their own. An empty table gives an empty result.
    """
    rows = stage(usable(rows, zero_too=True))
    return blocked(rows, every, per_block, threshold_index(k, step, scale), k, exact=True)
