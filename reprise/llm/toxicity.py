"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > j) = sigmoid(w.x - theta_j) with one weight vector for all ordered thresholds; x has log(1 + count) of each
selected word or word beginning. The output is the expected severity, the sum of P(grade > j). Words are runs of letters, digits and
non-ASCII bytes, A-Z folded, hashed to 2**20 features; the features kept are those whose share of toxic documents
differs clearly from the base rate. Texts are scored whole, in Arrow batches, against a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import APART, LOWER_BYTE, U, chunks, prefix_sums, stage, substring_hash, text_bytes, unstage, whole_row, words_of

BITS = 20
#: A longer word also counts as each of these beginnings, in bytes: stems carry meaning in inflected languages.
PREFIXES = (4, 5, 6)
CHUNK = 1 << 19
TRAINING_DOCUMENTS = 20_000
MOST_FEATURES = 4_096


def _counts(data: np.ndarray, at: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of each word feature, rows ascending; with kept, of those features only."""
    start, end, row = words_of(data, at, APART)
    sums = prefix_sums(data, LOWER_BYTE)
    ends = [end, *(start + n for n in PREFIXES)]
    on = [np.ones(len(end), bool), *(end > start + n for n in PREFIXES)]
    feature = np.concatenate([(substring_hash(sums, start[o], e[o]) >> U(64 - BITS)).astype(np.int64) for o, e in zip(on, ends)])
    row = np.concatenate([row[o] for o in on])
    if kept is not None:
        on = kept[feature]
        feature, row = feature[on], row[on]
    code, many = np.unique((row.astype(np.int64) << BITS) | feature, return_counts=True)
    return code >> BITS, code & ((1 << BITS) - 1), many


@dataclass
class Severity:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __call__(self, texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Expected severity, grade and verdict of each text."""
        table, kept = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        table[self.features], kept[self.features] = self.weights, True
        for column in texts:
            flat, starts = text_bytes(column)
            over = [np.zeros((0, len(self.thresholds)))]
            for i, j in chunks(starts, CHUNK):
                row, feature, many = _counts(flat[starts[i] : starts[j]], starts[i : j + 1] - starts[i], kept)
                x = np.bincount(row, table[feature] * np.log1p(many), minlength=j - i)
                over.append(1 / (1 + np.exp(-(x[:, None] - self.thresholds[None, :]))))
            over = np.concatenate(over)
            yield pa.StructArray.from_arrays([pa.array(over.sum(1)), pa.array((over >= 0.5).sum(1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)], names=["severity", "grade", "toxic"])


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, features: int, l2: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds, by Adam on the penalised likelihood of the cumulative-link model."""
    n, levels = len(grade), max(2, int(grade.max()) + 1)
    gaps = np.concatenate([[1.0], np.zeros(levels - 2)])  # theta_0, then log differences
    p = np.concatenate([np.zeros(features), gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, rounds + 1):
        w, g = p[:features], p[features:]
        theta = np.concatenate([g[:1], g[0] + np.cumsum(np.exp(g[1:]))])
        score = np.bincount(row, val * w[col], minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        up, lo = edge[grade + 1] - score, edge[grade] - score
        fu, fl = sig(up), sig(lo)
        du, dl = fu * (1 - fu), fl * (1 - fl)
        mass = np.maximum(fu - fl, 1e-12)
        by_score = (du - dl) / mass / n  # of the negative log likelihood
        grad_w = np.bincount(col, val * by_score[row], minlength=features) + l2 * w / n * 100
        by_theta = np.array([(-(du / mass)[grade == j].sum() + (dl / mass)[grade == j + 1].sum()) / n for j in range(levels - 1)])
        grad_g = np.concatenate([[by_theta.sum()], [by_theta[j:].sum() * np.exp(g[j]) for j in range(1, levels - 1)]])
        grad = np.concatenate([grad_w, grad_g])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    g = p[features:]
    return p[:features], np.concatenate([g[:1], g[0] + np.cumsum(np.exp(g[1:]))])


def _only(chosen: np.ndarray):
    """The lists cut down to the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(1 << BITS, bool)
        kept[chosen] = True
        for batch in batches:
            feature, tf = (batch.column(x).flatten().to_numpy() for x in ("feature", "tf"))
            at = batch.column("feature").offsets.to_numpy()
            on = kept[feature]
            edge = pa.array(np.concatenate([[0], np.cumsum(on)])[at - at[0]].astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[on])) for x in (feature, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *lists], names=["doc_id", "grade", "feature", "tf"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS, min_z: float = 4.5, min_lift: float = 2.0) -> Severity:
    """Fit on docs(doc_id, text) with labels(doc_id, toxic), on about `most` labelled documents at most, chosen by hash.

    toxic is an ordered grade from 0; where it only says 0 or 1, toxic documents with more telling words than the
    toxic median get grade 2. Labels or texts that are null, and ids without a document, are left out. Without a
    toxic and a clean document to learn from, the model finds nothing toxic.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade")).where("doc_id is not null and grade >= 0").dropDuplicates(["doc_id"])
    many = told.count()
    if many > most:
        told = told.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(most / many * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = text_bytes(batch.column(2))
            for i, j in chunks(starts, CHUNK):
                at = starts[i : j + 1] - starts[i]
                row, feature, count = _counts(flat[starts[i] : starts[j]], at)
                edge = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(edge, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(count.astype(np.int32)))], names=["doc_id", "grade", "feature", "tf"])

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(told), "doc_id").select("doc_id", "grade", "text").dropDuplicates(["doc_id"])  # about `most` ids
    words = stage(sample.mapInArrow(run, "doc_id long, grade int, feature array<int>, tf array<int>"))
    none = Severity(np.zeros(0, np.int64), np.zeros(0), np.array([20.0]))
    n, bad = words.agg(F.count("*"), F.coalesce(F.sum((F.col("grade") > 0).cast("int")), F.lit(0))).first()
    if not bad or bad == n:
        return none
    base = bad / n
    each = words.select((F.col("grade") > 0).cast("int").alias("bad"), F.explode("feature").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.col("df") * base) / F.sqrt(F.col("df") * base * (1 - base))
    lift = F.col("bad") / F.col("df") / base
    chosen = [r[0] for r in each.withColumn("z", F.abs(z)).where((F.col("df") >= max(4, n // 1000)) & (F.col("z") >= min_z) & ((lift >= min_lift) | (lift <= 1 / min_lift))).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()]
    if not chosen:
        return none
    chosen = np.array(sorted(chosen))
    rows = words.mapInArrow(_only(chosen), "doc_id long, grade int, feature array<int>, tf array<int>").orderBy("doc_id").collect()  # about `most` rows of a few features
    unstage(words)
    grade = np.array([r["grade"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["feature"]) for r in rows])
    col = np.searchsorted(chosen, np.array([x for r in rows for x in r["feature"]], np.int64))
    tf = np.array([x for r in rows for x in r["tf"]], float)
    if grade.max() == 1:
        telling = np.bincount(row, np.log1p(tf), minlength=len(rows))
        grade = np.where((grade == 1) & (telling > np.median(telling[grade == 1])), 2, grade)
    weights, thresholds = fit_ordinal(row, col, np.log1p(tf), grade, len(chosen))
    return Severity(chosen, weights, thresholds)


def judged(text: Column | str, model: Severity) -> Column:
    """struct(severity, grade, toxic) of a text column: expected grade, thresholds passed at even odds, whether the first is.

    Only the text goes to Python. Null and empty texts score as texts without telling words.
    """

    @F.arrow_udf("severity double, grade int, toxic boolean")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from model(texts)

    return run(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Severity) -> DataFrame:
    """docs with _severity, _grade and _toxic added, or replaced if docs has columns of these names.

    Every row comes back once, whatever its other columns; an empty table gives an empty result.
    """
    held = docs.select(whole_row(docs, "_severity", "_grade", "_toxic"), judged("text", model).alias("told"))
    return held.select("row.*", *[F.col(f"told.{x}").alias(f"_{x}") for x in ("severity", "grade", "toxic")])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row of docs, by a model fitted on their labels."""
    return docs.select("doc_id", judged("text", fit(docs, labels)).alias("told")).select("doc_id", "told.*")
