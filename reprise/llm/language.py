"""Language identification by rank-order profiles of character n-grams.

A profile is the n-grams (1 to 3 characters, words padded with a space) of a language's training texts, most frequent
first. A document is ranked the same way, and its distance to a profile is the sum over its n-grams of how far each is
out of place, an n-gram the profile lacks counting as the profile's length. The nearest profile gives the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

TRAINING_DOCUMENTS = 2_000
PROFILE = 400
OUT = "lang_pred string, score double"


@cache
def _fold() -> np.ndarray:
    """Code points to their lower-case letter, and everything else to 1, which separates words."""
    out = np.ones(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers, and their counts; none without a letter."""
    raw = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    x = _fold()[raw]
    x = x[np.concatenate([[True], (x[1:] != 1) | (x[:-1] != 1)])]  # one separator between words
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.unique(np.concatenate([x[x != 1], two, three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, first the most frequent; ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        on = counts >= least
        codes, counts = codes[on], counts[on]
    return codes[np.lexsort((codes, -counts))[:most]]


def profiles(texts: DataFrame, most: int = TRAINING_DOCUMENTS, length: int = PROFILE) -> dict[str, np.ndarray]:
    """A profile per language of texts(doc_id, text, lang), each from about `most` documents at most, chosen by hash.

    Rows with a null text or lang teach nothing. Counting is distributed; the driver gets `length` n-grams a language.
    """
    texts = texts.where("text is not null and lang is not null").select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    many = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    if not many:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, most / n))])
    texts = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in sorted(set(batch.column(1).to_pylist())):
                mine = [grams(t) for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if own == lang]
                codes, back = np.unique(np.concatenate([c for c, _ in mine]), return_inverse=True)
                total = np.bincount(back, np.concatenate([n for _, n in mine]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], names=["lang", "gram", "n"])

    counted = stage(texts.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counted.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "rank", "gram").collect()  # `length` rows a language
    unstage(counted)
    return {lang: np.array([g for _, g in sorted((r["rank"], r["gram"]) for r in rows if r["lang"] == lang)], np.int64) for lang in sorted({r["lang"] for r in rows})}


def _predictor(known: dict[str, np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = list(known), []
        for p in known.values():
            order = np.argsort(p)
            tables.append((p[order], order))
        for batch in batches:
            pred, score = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                codes = top(*grams(text or ""), length)
                if not len(codes) or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                place = np.arange(len(codes))
                far = []
                for p, rank in tables:
                    at = np.minimum(np.searchsorted(p, codes), len(p) - 1)
                    far.append(np.where(p[at] == codes, np.minimum(np.abs(rank[at] - place), length), length).sum())
                b = int(np.argmin(far))
                pred.append(langs[b])
                score.append(1 - far[b] / (length * len(codes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identified(docs: DataFrame, known: dict[str, np.ndarray], length: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text), from the text alone.

    `und` with score 0 for null texts and texts without a letter, or if no language is known; score is one less the
    share of the largest possible distance. Equal distances go to the first language by name. Other columns are ignored.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_predictor(known, length), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")


def with_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from four of five folds of doc_id, predicted for every document."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return identified(docs, profiles(docs.where(~fold))).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
