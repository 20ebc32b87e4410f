"""Model-backed detection: segments rendered into bounded chunks, answers grounded in segment indices.

A detector is a function (segments, covered) -> spans. The model itself is an adapter: model_detector() takes a
function from chunk text to a list of (start index, end index, reason); none is shipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions import scalars as S
from .intervals import covered_segments

Detector = Callable[[DataFrame, DataFrame], DataFrame]
SPANS = "episode_id long, start double, end double, source string, reason string"


@udtf
class ChunkLines:
    """Table function chunk_lines(TABLE(lines), budget): lines of each key packed in order to at most `budget` characters.

    lines has a key (`episode_id`, of any type), `seg_idx`, `line` and `skip`; other columns don't reach it. A run of
    skipped lines becomes one marker line; a line longer than the budget stands alone. Spark deals and sorts the rows by
    key and seg_idx; the function folds them as they come and hands out a chunk once it is full, so it never holds
    more than one chunk, however long an episode is. A null line is an empty one, a null skip isn't skipped.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument, budget: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("chunk_lines takes a table of lines first")
        if lacking := [c for c in ("episode_id", "seg_idx", "line", "skip") if c not in lines.dataType.fieldNames()]:
            raise ValueError(f"the lines lack {lacking}")
        if budget is not None and (not budget.isConstantExpression or budget.value is None or budget.value < 1):
            raise ValueError("the budget is a number of characters, 1 or more")
        made = StructType().add("episode_id", lines.dataType["episode_id"].dataType).add("chunk", IntegerType()).add("lines", IntegerType()).add("text", StringType())
        return AnalyzeResult(made, partitionBy=[PartitioningColumn("episode_id")], orderBy=[OrderingColumn("seg_idx")])

    def __init__(self) -> None:
        self.key, self.chunk, self.lines, self.size, self.skipped = None, 0, [], 0, 0

    def _full(self) -> tuple:
        out = self.key, self.chunk, len(self.lines), "\n".join(self.lines)
        self.chunk, self.lines, self.size = self.chunk + 1, [], 0
        return out

    def _add(self, line: str, budget: int) -> Iterator[tuple]:
        if self.lines and self.size + len(line) + 1 > budget:
            yield self._full()
        self.lines.append(line)
        self.size += len(line) + 1

    def _marker(self) -> str:
        told, self.skipped = f"({self.skipped} segment(s) already known)", 0
        return told

    def eval(self, row: Row, budget: int = S.CHUNK_CHARS) -> Iterator[tuple]:
        self.key, self.budget = row["episode_id"], budget
        if row["skip"]:
            self.skipped += 1
            return
        if self.skipped:
            yield from self._add(self._marker(), budget)
        yield from self._add(row["line"] or "", budget)

    def terminate(self) -> Iterator[tuple]:
        if self.skipped:
            yield from self._add(self._marker(), self.budget)
        if self.lines:
            yield self._full()


def register_functions(spark: SparkSession) -> None:
    """Makes chunk_lines callable from SQL: SELECT * FROM chunk_lines(TABLE(lines), 20000)."""
    spark.udtf.register("chunk_lines", ChunkLines)


def rendered(segments: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """(episode_id, seg_idx, line, skip): segments as lines, those that are covered marked."""
    skip = segments.select("episode_id", "seg_idx").limit(0) if covered is None else covered.select("episode_id", "seg_idx").distinct()
    told = segments.join(skip.withColumn("skip", F.lit(True)), ["episode_id", "seg_idx"], "left")
    return told.select("episode_id", "seg_idx", S.render_segment("seg_idx", "start", "end", "text").alias("line"), F.col("skip").isNotNull().alias("skip"))


def chunks(segments: DataFrame, covered: DataFrame | None = None, budget: int = S.CHUNK_CHARS) -> DataFrame:
    """(episode_id, chunk, lines, text): rendered segments packed in order to at most `budget` characters, by ChunkLines.

    A run of covered segments becomes one marker line; a longer line stands alone. A segment's text is read only where
    it isn't covered.
    """
    lines = rendered(segments, covered).withColumn("line", F.when(~F.col("skip"), F.col("line")))
    return ChunkLines(lines.asTable(), F.lit(budget))


def grounded(answers: DataFrame, segments: DataFrame, source: str = "llm") -> DataFrame:
    """Spans of answers(episode_id, first, last, reason) whose indices exist and are in order."""
    s = segments.select("episode_id", F.col("seg_idx").alias("first"), "start")
    e = segments.select("episode_id", F.col("seg_idx").alias("last"), "end")
    fine = answers.where("first is not null and last is not null and first <= last")
    return fine.join(s, ["episode_id", "first"]).join(e, ["episode_id", "last"]).select("episode_id", "start", "end", F.lit(source).alias("source"), F.trim("reason").alias("reason"))


def null_detector(segments: DataFrame, covered: DataFrame) -> DataFrame:
    return segments.sparkSession.createDataFrame([], SPANS)


def model_detector(ask: Callable[[str], list[tuple[int, int, str]] | None], budget: int = S.CHUNK_CHARS) -> Detector:
    """A detector around a model client; None from it is a refusal and skips the chunk."""

    def detect(segments: DataFrame, covered: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                rows = [(e, a, b, why) for e, text in zip(pdf["episode_id"], pdf["text"]) for a, b, why in ask(text) or []]
                yield pd.DataFrame(rows, columns=["episode_id", "first", "last", "reason"])

        answers = chunks(segments, covered, budget).mapInPandas(run, "episode_id long, first int, last int, reason string")
        return grounded(answers, segments)

    return detect


def layered(*detectors: Detector) -> Detector:
    """Each detector is told what the ones before it cover; all spans are returned, repeats included."""

    def detect(segments: DataFrame, covered: DataFrame) -> DataFrame:
        out = null_detector(segments, covered)
        for one in detectors:
            new = one(segments, covered)
            out = out.unionByName(new, allowMissingColumns=True).select("episode_id", "start", "end", "source", "reason")
            covered = covered.unionByName(covered_segments(segments, new).select("episode_id", "seg_idx")).distinct()
        return out

    return detect
