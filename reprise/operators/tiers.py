"""Whole tiers: what a sweep finds, corroborated, and written over the tier's own spans; and the cut that follows from them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.staging import stage, unstage
from . import detect, intervals, queues, sequence, text


def frame_ranges(sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """spans(episode_id, start, end, ...) with the first and last frame that lie in each whole."""
    per = F.col("frames") / F.col("duration")
    placed = spans.join(sizes.select("episode_id", "frames", "duration"), "episode_id").where("duration > 0")
    return placed.withColumns({"first": F.ceil(F.col("start") * per), "last": F.floor(F.col("end") * per) - 1}).drop("frames", "duration")


def frames_within(frames: DataFrame, sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """frames with the columns of the spans (episode_id, start, end, ...) they lie in whole, numbered from the span's first.

    frames: (episode_id, frame, value), or (episode_id, fingerprint array), of which each span takes its slice.
    """
    if "fingerprint" not in frames.columns:
        inside = intervals.point_in_run(frames, frame_ranges(sizes, spans), "episode_id", "frame")
        return inside.withColumn("frame", (F.col("frame") - F.col("first")).cast("int")).drop("first", "last")
    lo, n = F.greatest(F.col("first"), F.lit(0)), F.size("fingerprint")
    length = F.greatest(F.lit(0), F.least("last", n - 1) - lo + 1)
    cut = frames.join(frame_ranges(sizes, spans), "episode_id").select(*[F.col(c) for c in spans.columns], (lo - F.col("first")).cast("int").alias("_at"), F.slice("fingerprint", F.least(lo, n).cast("int") + 1, length.cast("int")).alias("_x"))
    return cut.select(*spans.columns, "_at", F.posexplode("_x").alias("frame", "value")).withColumn("frame", F.col("frame") + F.col("_at")).drop("_at")


def _editorial(frames: DataFrame, sizes: DataFrame, spans: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    known = spans.where(F.col("source").isin(*sources)).select("episode_id", "start", "end")
    told = sizes.join(known.select("episode_id").distinct(), "episode_id", "left_semi")
    gaps = intervals.gap_windows(intervals.keep_spans(known, told, "episode_id"), "episode_id")
    return frames_within(frames, sizes, gaps).select("value")


def editorial_stoplist(frames: DataFrame, sizes: DataFrame, spans: DataFrame, sources: tuple[str, ...] = S.AUDIO_SOURCES) -> DataFrame:
    """(value): what samples of the gaps between confirmed spans hold, in the episodes that have any."""
    return _editorial(frames, sizes, spans, sources).distinct()


def audio_library(frames: DataFrame, sizes: DataFrame, spans: DataFrame, exclude: int | None = None, fraction: float = S.STOP_EPISODE_FRACTION, sources: tuple[str, ...] = S.AUDIO_SOURCES) -> tuple[DataFrame, DataFrame]:
    """Frames (ad_id, episode_id, frame, value; staged) of confirmed spans, without those of one episode if it is named, and the stop list.

    Stopped is what is frequent among the library's episodes and stands in editorial material as well.
    """
    library = library_frames(frames, sizes, spans, exclude, sources)
    return library, sequence.stop_values(sequence.frequent_values(library, fraction), _editorial(frames, sizes, spans, sources))


def library_frames(frames: DataFrame, sizes: DataFrame, spans: DataFrame, exclude: int | None = None, sources: tuple[str, ...] = S.AUDIO_SOURCES) -> DataFrame:
    """(ad_id, episode_id, frame, value), staged, of confirmed spans."""
    known = spans.where(F.col("source").isin(*sources))
    if exclude is not None:
        known = known.where(F.col("episode_id") != exclude)
    return stage(frames_within(frames, sizes, known.select("episode_id", "start", "end", F.col("id").alias("ad_id"))).select("ad_id", "episode_id", "frame", "value"))


def held_out_regions(frames: DataFrame, sizes: DataFrame, spans: DataFrame, match_frames: int = S.MATCH_FRAMES, floor: int = S.MIN_REGION_FRAMES, bridge: int = S.BRIDGE_FRAMES, fraction: float = S.STOP_EPISODE_FRACTION, sources: tuple[str, ...] = S.AUDIO_SOURCES) -> DataFrame:
    """(episode_id, first, last, members): each episode matched against the confirmed spans of all others, as if it had confirmed none.

    What another library would stop follows from counts: without an episode that owns a value the value has one owner
    fewer, and the library one episode fewer if the episode owns any. Values that are stopped for no episode or for
    every one are told by their counts alone; only the few between the two limits need to know their owners.
    """
    library, editorial = library_frames(frames, sizes, spans, sources=sources), stage(editorial_stoplist(frames, sizes, spans, sources))
    owned = stage(library.groupBy("value", "episode_id").agg(F.lit(True).alias("owns")))
    owner = owned.select("episode_id").distinct()
    n = F.broadcast(owner.agg(F.count("*").alias("n")))  # one row
    counts = owned.groupBy("value").agg(F.count("*").alias("episodes")).join(n)
    counts = counts.where(F.col("episodes") > fraction * (F.col("n") - 1))  # stopped for some episode, if at all
    if editorial.limit(1).count():
        counts = counts.join(editorial, "value", "left_semi")
    asked = sequence.frames(frames) if "fingerprint" in frames.columns else frames
    asked = asked.join(library.select("value").distinct(), "value", "left_semi")  # no other can match
    asked = asked.join(counts, "value", "left").join(owned, ["value", "episode_id"], "left").join(owner.withColumn("owner", F.lit(True)), "episode_id", "left")
    less = lambda x: F.when(x, 1).otherwise(0)
    stopped = F.col("episodes") - less(F.col("owns")) > fraction * (F.col("n") - less(F.col("owner")))
    asked = asked.where(~F.coalesce(stopped, F.lit(False))).select("episode_id", "frame", "value")
    out = stage(sequence.match_regions(asked, library, None, match_frames, floor, bridge))
    unstage(library, editorial, owned)
    return out


def audio_recall(frames: DataFrame, sizes: DataFrame, spans: DataFrame, match_frames: int = S.MATCH_FRAMES, floor: int = S.MIN_REGION_FRAMES, sources: tuple[str, ...] = S.AUDIO_SOURCES) -> DataFrame:
    """(episode_id, ads, found, ad_frames, found_frames) of every episode with confirmed spans of a frame at least: what the others' spans find again, by span and by length."""
    known = spans.where(F.col("source").isin(*sources)).select("episode_id", "start", "end", F.col("id").alias("ad_id"))
    ads = frame_ranges(sizes, known).where("last >= first").select("episode_id", "ad_id", "first", "last")
    region = held_out_regions(frames, sizes, spans, match_frames, floor, sources=sources).select("episode_id", F.col("first").alias("_f"), F.col("last").alias("_l"))
    # regions of an episode are apart; one without any has none to meet
    met = F.when(F.col("_f").isNotNull(), F.greatest(F.lit(0), F.least("last", "_l") - F.greatest("first", "_f") + 1))
    each = ads.join(region, "episode_id", "left").groupBy("episode_id", "ad_id", "first", "last").agg(F.coalesce(F.sum(met), F.lit(0)).alias("_met"))
    size = F.col("last") - F.col("first") + 1
    return each.groupBy("episode_id").agg(F.count("*").alias("ads"), F.count_if(F.col("_met") > 0).alias("found"), F.sum(size).cast("long").alias("ad_frames"), F.sum("_met").cast("long").alias("found_frames"))


def apply_fingerprints(episodes: DataFrame, spans: DataFrame, frames: DataFrame, sizes: DataFrame, segments: DataFrame, match_frames: int = S.MATCH_FRAMES, floor: int = S.MIN_REGION_FRAMES) -> DataFrame:
    """spans with the `fpmatch` tier written anew for every episode with audio that is indexed.

    Regions match confirmed spans of other episodes; where there is a transcript, a region without speech goes.
    Nothing changes while nothing is confirmed.
    """
    frames, sizes = stage(frames), stage(sizes)
    looked = sizes.join(episodes.where("audio_url is not null").select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    library, stop = audio_library(frames, sizes, spans)
    some = library.select(F.lit(1).alias("_some")).limit(1)
    looked = looked.join(F.broadcast(some)).drop("_some")  # one row or none
    mine = (sequence.frames(frames) if "fingerprint" in frames.columns else frames).join(looked.select("episode_id"), "episode_id", "left_semi")
    regions = sequence.match_regions(mine, library, stop, match_frames, floor)
    spoken = segments.join(episodes.where("transcript_path is not null").select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    found = intervals.speech_filter(sequence.spans_of_regions(regions, sizes), spoken)
    return queues.replace_tier(spans, found.drop("source"), "fpmatch", looked)


def apply_repeats(episodes: DataFrame, spans: DataFrame, segments: DataFrame) -> DataFrame:
    """spans with the `repeat` tier written anew for every episode with a transcript; nothing changes while nothing is confirmed."""
    looked = episodes.where("transcript_path is not null").select(F.col("id").alias("episode_id"))
    library = text.text_library(segments, spans)
    looked = looked.join(F.broadcast(library.select(F.lit(1).alias("_some")).limit(1))).drop("_some")  # one row or none
    found = text.repeat_detect(segments.join(looked, "episode_id", "left_semi"), library)
    return queues.replace_tier(spans, found.select("episode_id", "start", "end"), "repeat", looked)


def cut_plan(timelines: DataFrame, spans: DataFrame, silences: DataFrame, sources: tuple[str, ...] = S.CUT_SOURCES) -> tuple[DataFrame, DataFrame]:
    """What is kept (episode_id, start, end), and (episode_id, duration, ad_seconds, anomalous), of timelines(episode_id, duration).

    Only spans of sources that can be trusted with edges are cut, their edges moved inward to silences.
    """
    cut = spans.where(F.col("source").isin(*sources)).select("id", "episode_id", "start", "end")
    keeps = intervals.keep_spans(intervals.snap_inward(cut, silences, "episode_id", row="id"), timelines, "episode_id")
    return keeps, intervals.with_anomaly(intervals.ad_seconds(keeps, timelines, "episode_id"))


def detect_pending(episodes: DataFrame, spans: DataFrame, segments: DataFrame, ask: Callable[[str], list[tuple[int, int, str]] | None], now: Column, limit: int | None = None, streak: int = 5, budget: int = S.CHUNK_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A model run over the pending episodes: (spans with what it found, episodes with stamps, results(episode_id, found, error)).

    An episode whose call fails is told with its error, left unstamped and so asked again; it stops no other. After
    `streak` failures in a row, in order of id, the rest counts as not tried. An episode without spans is stamped too.
    """
    pending = queues.pending_detect(episodes, limit).select(F.col("id").alias("episode_id"))
    mine = segments.join(pending, "episode_id", "left_semi")
    chunks = detect.chunks(mine, intervals.covered_segments(mine, spans).select("episode_id", "seg_idx"), budget)

    def run(batches):
        for pdf in batches:
            rows = []
            for e, part in zip(pdf["episode_id"], pdf["text"]):
                try:
                    rows += [(e, a, b, why, None) for a, b, why in ask(part) or []]
                except Exception as x:  # one bad episode must not stop the others
                    rows.append((e, None, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["episode_id", "first", "last", "reason", "error"]).astype({"first": "Int32", "last": "Int32"})

    answers = stage(chunks.mapInPandas(run, "episode_id long, first int, last int, reason string, error string"))
    failed = answers.groupBy("episode_id").agg(F.min("error").alias("error"))
    told = stage(queues.numbered(pending.join(failed, "episode_id", "left"), F.col("episode_id"), name="place"))
    # a failure begins a streak if the one `streak` - 1 failures later lies as many places later
    errors = queues.numbered(told.where("error is not null").select("place"), F.col("place"), name="nth")
    later = errors.select(F.col("place").alias("end"), (F.col("nth") - (streak - 1)).alias("nth"))
    stop = errors.join(later, "nth").where(F.col("end") - F.col("place") == streak - 1).agg(F.min("end").alias("stop"))
    tried = told.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("place") <= F.col("stop"))).select("episode_id", "error")  # one row
    fine = tried.where("error is null").select("episode_id")
    new = detect.grounded(answers.where("error is null").join(fine, "episode_id", "left_semi"), segments)
    results = tried.join(new.groupBy("episode_id").agg(F.count("*").alias("found")), "episode_id", "left").select("episode_id", F.coalesce("found", F.lit(0)).alias("found"), "error")
    stamp = fine.select(F.col("episode_id").alias("id"), F.lit(True).alias("_done"))
    stamped = queues.stamped(episodes.join(stamp, "id", "left"), F.coalesce("_done", F.lit(False)), llm_detected_at=now).select(*episodes.columns)
    return spans.unionByName(new, allowMissingColumns=True), stamped, results
