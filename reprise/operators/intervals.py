"""Interval algebra: runs, merging, complement, snapping, overlap, coverage. Every plan is keyed by the timeline's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def group_runs(df: DataFrame, keys: list[str], pos: str, bridge: int, floor: int = 1) -> DataFrame:
    """Gaps and islands: (keys, first, last, members); a gap over bridge + 1 starts a new run, shorter runs than floor go."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = (F.col(pos) - F.lag(pos).over(w) > bridge + 1).cast("int")
    runs = df.select(*keys, pos).distinct().withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("members"))
    return out.where(F.col("last") - F.col("first") + 1 >= floor).drop("_run")


def runs_of_pieces(pieces: DataFrame, keys: list[str], bridge: int, floor: int = 1, first: str = "first", last: str = "last") -> DataFrame:
    """group_runs of all places that pieces (first to last, both included, overlapping or not) hold, without a row for each."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    marked = pieces.select(*keys, first, last).withColumn("_reach", F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    more = F.greatest(F.lit(0), F.col(last) - F.greatest(F.col(first) - 1, F.coalesce("_reach", F.col(first) - 1)))
    marked = marked.withColumns({"_new": F.coalesce((F.col(first) - F.col("_reach") > bridge + 1).cast("int"), F.lit(1)), "_more": more})
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "_run").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.sum("_more").cast("long").alias("members"))
    return out.where(F.col("last") - F.col("first") + 1 >= floor).drop("_run")


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans become one; the order of rows doesn't matter."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def keep_spans(spans: DataFrame, timelines: DataFrame, key: str, start: str = "start", end: str = "end", duration: str = "duration") -> DataFrame:
    """The complement of the spans within [0, duration] of every timeline; a timeline without spans is kept whole."""
    zero = F.col(duration) * 0
    cut = spans.select(key, start, end).join(timelines.select(key, duration), key).select(key, F.greatest(zero, F.least(start, duration)).alias(start), F.greatest(zero, F.least(end, duration)).alias(end)).where(F.col(end) > F.col(start))
    merged = merge_spans(cut, [key], start, end)
    w = Window.partitionBy(key).orderBy(start)
    edges = merged.unionByName(timelines.select(key, (zero - 1).alias(start), zero.alias(end)))
    gaps = edges.withColumn("_next", F.lead(start).over(w)).join(timelines.select(key, duration), key)
    return gaps.select(key, F.col(end).alias(start), F.coalesce("_next", duration).alias(end)).where(F.col(end) > F.col(start))


def gap_windows(gaps: DataFrame, key: str, want: float = S.EDITORIAL_SAMPLE_SECONDS, window: float = S.EDITORIAL_WINDOW, least: float = S.EDITORIAL_MIN_WINDOW) -> DataFrame:
    """Samples of the gaps(start, end): at most `window` of each, `want` in all, none under `least`."""
    size = F.least(F.lit(window), F.col("end") - F.col("start"))
    prior = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = gaps.where(F.col("end") - F.col("start") >= least).withColumn("_take", F.least(size, want - prior))
    return taken.where(F.col("_take") >= least).select(key, "start", (F.col("start") + F.col("_take")).alias("end"))


def snap_inward(spans: DataFrame, silences: DataFrame, key: str, window: float = S.SNAP_WINDOW, row: str = "span_id") -> DataFrame:
    """Both edges move inward to the nearest edge of a silence within the window; a span that would invert stays.

    `row` names the column that tells the spans apart.
    """
    at = lambda x: F.floor(x / S.TIME_BUCKET)
    edges = silences.select(key, F.explode(F.array("start", "end")).alias("edge")).withColumn("_b", at(F.col("edge")))
    first = F.col("edge").between(F.col("start"), F.col("start") + window)
    last = F.col("edge").between(F.col("end") - window, F.col("end"))
    # a span meets only the edges of the stretches that its two windows touch
    near = F.array_distinct(F.concat(F.sequence(at(F.col("start")), at(F.col("start") + window)), F.sequence(at(F.col("end") - window), at(F.col("end")))))
    filed = spans.select(row, key, "start", "end", F.explode(near).alias("_b"))
    moved = filed.join(edges, [key, "_b"]).where(first | last).groupBy(row).agg(F.min(F.when(first, F.col("edge"))).alias("_s"), F.max(F.when(last, F.col("edge"))).alias("_e"))
    out = spans.join(moved, row, "left").withColumns({"_s": F.coalesce("_s", "start"), "_e": F.coalesce("_e", "end")})
    fine = F.col("_e") > F.col("_s")
    return out.withColumns({"start": F.when(fine, F.col("_s")).otherwise(F.col("start")), "end": F.when(fine, F.col("_e")).otherwise(F.col("end"))}).drop("_s", "_e")


def _filed(df: DataFrame, start: str, end: str, bucket: float) -> DataFrame:
    """df with a row for each stretch of time (_b) that it touches; rows without a start or an end have none. Times are finite."""
    lo, hi = (F.floor(F.col(x) / bucket) for x in (start, end))
    return df.select("*", F.explode(F.sequence(F.least(lo, hi), F.greatest(lo, hi))).alias("_b")).where(F.col(start).isNotNull() & F.col(end).isNotNull())


def overlap_join(segments: DataFrame, spans: DataFrame, key: str, how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Segments with the spans they strictly overlap (s_start, s_end, ...), on equal keys.

    With a bucket (for timelines of many segments) both sides are filed under the stretches of time they touch, and a
    pair counts in the first stretch the two share.
    """
    s = spans.withColumnsRenamed({"start": "s_start", "end": "s_end"})
    inside = (F.col("end") > F.col("s_start")) & (F.col("start") < F.col("s_end"))
    if bucket is None:
        return segments.join(s, (segments[key] == s[key]) & inside, how).drop(s[key])
    first = F.col("_b") == F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("s_start") / bucket))
    return _filed(segments, "start", "end", bucket).join(_filed(s, "s_start", "s_end", bucket), [key, "_b"]).where(inside & first).drop("_b")


def covered_segments(segments: DataFrame, spans: DataFrame, key: str = "episode_id", bucket: float | None = S.TIME_BUCKET) -> DataFrame:
    """Segments inside any span, as often as they come; one without a start or an end is inside nothing.

    With a bucket, each place (start, end) meets the spans of the stretches it touches, and segments then meet places on
    equal values: no segment is held against all spans of a long timeline. Places of one stretch are told once.
    """
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    over = (F.col("end") > F.col("_s")) & (F.col("start") < F.col("_e"))
    if bucket is None:
        return segments.join(s, (F.col(key) == F.col("_k")) & over, "left_semi")
    places = _filed(segments.select(key, "start", "end").distinct(), "start", "end", bucket)
    filed = _filed(s.distinct(), "_s", "_e", bucket).withColumnRenamed("_b", "_c")
    met = places.join(filed, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & over, "left_semi").select(key, "start", "end").distinct()
    return segments.join(met, [key, "start", "end"], "left_semi").select(*segments.columns)


def point_in_run(points: DataFrame, runs: DataFrame, key: str, pos: str, bucket: int = S.POINT_BUCKET) -> DataFrame:
    """Points with the runs (first to last, both included) they lie in; runs are filed under the stretches they touch."""
    at = points.select("*", F.floor(F.col(pos) / bucket).alias("_b"))
    return at.join(_filed(runs.where("first <= last"), "first", "last", bucket), [key, "_b"]).where(F.col(pos).between(F.col("first"), F.col("last"))).drop("_b")


def speech_filter(spans: DataFrame, segments: DataFrame, key: str = "episode_id", least: int = S.SPEECH_MIN_WORDS) -> DataFrame:
    """Drops spans with fewer than `least` words spoken in overlapping segments; episodes without a transcript keep theirs."""
    spoken = segments.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")).alias("_w"))
    known = segments.select(key).distinct().withColumn("_known", F.lit(True))
    place = [key, "start", "end"]  # spans of one place have the same words
    said = overlap_join(spans.select(*place).distinct(), spoken.withColumnsRenamed({"_s": "start", "_e": "end"}), key, bucket=S.TIME_BUCKET)
    words = said.groupBy(*place).agg(F.sum("_w").alias("_words"))
    told = spans.join(words, place, "left").join(known, key, "left")
    return told.where(F.col("_known").isNull() | (F.coalesce("_words", F.lit(0)) >= least)).select(*spans.columns)


def ad_seconds(keeps: DataFrame, timelines: DataFrame, key: str, duration: str = "duration") -> DataFrame:
    kept = keeps.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("_kept"))
    return timelines.join(kept, key, "left").select(key, duration, (F.col(duration) - F.coalesce("_kept", F.col(duration) * 0)).alias("ad_seconds"))


def with_anomaly(totals: DataFrame, duration: str = "duration") -> DataFrame:
    return totals.withColumn("anomalous", S.is_anomalous_cut(F.col("ad_seconds"), F.col(duration)))

