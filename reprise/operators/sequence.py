"""The sequence tier: frames matched along diagonals against a library or the corpus itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.staging import stage, unstage
from . import diagonals
from .intervals import runs_of_pieces

try:
    from _md5 import md5  # half the cost of a call of the other
except ImportError:
    from hashlib import md5


def frames(fingerprints: DataFrame, key: str = "episode_id") -> DataFrame:
    """(key, frame, value) from (key, fingerprint array)."""
    return fingerprints.select(key, F.posexplode("fingerprint").alias("frame", "value"))


def _values(k: int):
    """Python: the 32-bit md5 prefix of every k words in a row, in order, of texts in lower-case letters, digits and blanks."""

    def listed(key, lists, kind):
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], ["episode_id", "fingerprint"])

    def run(batches):
        for batch in batches:
            key, lists, held = [], [], 0
            for e, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                if len(words) < k:
                    continue
                digests = b"".join([md5(x.encode()).digest() for x in map(" ".join, zip(*[words[i:] for i in range(k)]))])
                lists.append(np.frombuffer(digests, ">u4")[::4].astype(np.int64))
                key.append(e)
                held += len(words)
                if held > 500_000:
                    yield listed(key, lists, batch.column(0).type)
                    key, lists, held = [], [], 0
            if key:
                yield listed(key, lists, batch.column(0).type)

    return run


def text_fingerprints(texts: DataFrame, key: str, k: int = S.SHINGLE_K) -> DataFrame:
    """(episode_id, fingerprint array): word shingles in order; the value is the shingle's 32-bit md5 prefix. Texts of fewer words have no row."""
    plain = texts.select(F.col(key).alias("episode_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " ").alias("_t")).where("_t is not null")
    return plain.mapInArrow(_values(k), f"episode_id {texts.schema[key].dataType.simpleString()}, fingerprint array<long>")


def text_frames(texts: DataFrame, key: str, k: int = S.SHINGLE_K) -> DataFrame:
    """Word shingles in order as frames."""
    return frames(text_fingerprints(texts, key, k))


def frequent_values(frames: DataFrame, fraction: float = S.STOP_EPISODE_FRACTION) -> DataFrame:
    """Values in more than that share of the episodes that have frames."""
    n = frames.agg(F.count_distinct("episode_id").alias("_n"))
    each = frames.select("episode_id", "value").distinct().groupBy("value").agg(F.count("*").alias("episodes"))
    return each.join(F.broadcast(n), F.col("episodes") > fraction * F.col("_n")).select("value", "episodes")  # one row


def stop_values(frequent: DataFrame, editorial: DataFrame | None) -> DataFrame:
    """Frequent values that editorial material has as well; all frequent ones where there is no editorial material.

    Frequent values are few: a share of the episodes has each, so they are no more than the mean number of values of an
    episode, divided by that share. They go to every task, and editorial material is read once, where it lies.
    """
    if editorial is None:
        return frequent.select("value")
    frequent = stage(frequent.select("value"))
    told = editorial.select("value").join(F.broadcast(frequent.withColumn("_f", F.lit(True))), "value", "left")
    met = stage(told.select(F.col("_f").isNotNull().alias("_f"), F.when(F.col("_f"), F.col("value")).alias("value")).distinct())
    return frequent if met.isEmpty() else met.where("_f").select("value")


def value_pairs(query: DataFrame, library: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(episode_id, frame, other, other_frame) of equal values outside the stop list, never within an episode."""
    if stop is not None:
        query = query.join(stop.select("value"), "value", "left_anti")
    lib = library.select("value", F.col("episode_id").alias("other_episode"), F.col("ad_id").alias("other"), F.col("frame").alias("other_frame"))
    return query.join(lib, "value").where("episode_id <> other_episode").drop("value")


def diagonal_vote(pairs: DataFrame, least: int = S.MATCH_FRAMES) -> DataFrame:
    """(episode_id, other, offset, votes) of the diagonals with enough frames."""
    return pairs.groupBy("episode_id", "other", (F.col("frame") - F.col("other_frame")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)


def match_regions(query: DataFrame, library: DataFrame, stop: DataFrame | None = None, match_frames: int = S.MATCH_FRAMES, floor: int = S.MIN_REGION_FRAMES, bridge: int = S.BRIDGE_FRAMES) -> DataFrame:
    """(episode_id, first, last, members): frames on voted diagonals, grouped into runs. Computed when called; what is returned reads staged pieces."""
    if stop is not None:
        query = query.join(F.broadcast(stop.select("value")), "value", "left_anti")  # few, as stop_values says
    hit = diagonals.hits(diagonals.voted(query, library, match_frames))
    return runs_of_pieces(hit, ["episode_id"], bridge, max(floor, match_frames))


def spans_of_regions(regions: DataFrame, sizes: DataFrame, source: str = "fpmatch") -> DataFrame:
    """Seconds of each region, from (episode_id, frames, duration)."""
    start, end = S.frame_span(F.col("first"), F.col("last"), F.col("frames"), F.col("duration"))
    return regions.join(sizes, "episode_id").select("episode_id", start.alias("start"), end.alias("end"), F.lit(source).alias("source"))


def shared_frames(frames: DataFrame, fraction: float) -> DataFrame:
    """Frames whose value two episodes have at least, and no more than that share of them; dealt by value once, counted where they then lie."""
    n = frames.agg(F.count_distinct("episode_id").alias("_n"))
    w = Window.partitionBy("value")
    told = frames.where("value is not null").withColumn("_new", F.when(F.lag("episode_id").over(w.orderBy("episode_id")) == F.col("episode_id"), 0).otherwise(1))
    told = told.withColumn("_episodes", F.sum("_new").over(w)).join(F.broadcast(n))  # one row
    return told.where((F.col("_episodes") > 1) & (F.col("_episodes") <= fraction * F.col("_n"))).select(*frames.columns)


def self_diagonals(frames: DataFrame, match_frames: int = S.MATCH_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(episode_id, other, offset, parts) of the corpus with itself, each pair of episodes once, the smaller id first; parts are (first, last) of the first one's frames.

    Episodes with the same frames throughout are matched through one of them: the first of its class meets the firsts of
    the other classes, and each other member its own first. So a group of g exact copies makes g pairs, not g squared.
    With it comes (episode_id, first): the class of each episode.
    """
    whole = frames.groupBy("episode_id").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("frame", "value", F.lit(x))).alias(f"h{x}") for x in (1, 2)])
    same = ["n", "h1", "h2"]
    first = whole.groupBy(*same).agg(F.min("episode_id").alias("first"))
    member = stage(whole.join(first, same).select("episode_id", "first"))
    crossed = diagonals.self_voted(frames.join(member.where("episode_id = first").select("episode_id"), "episode_id", "left_semi"), match_frames)
    copies = frames.join(member.where("episode_id <> first"), "episode_id")
    # a copy lies on the main diagonal of its first; only frames that aren't stopped take part
    own = copies.groupBy(F.col("first").alias("episode_id"), F.col("episode_id").alias("other")).agg(F.collect_list(F.struct(F.col("frame").cast("int").alias("first"), F.col("frame").cast("int").alias("last"))).alias("parts")).where(F.size("parts") >= match_frames)
    return crossed.unionByName(own.select("episode_id", "other", F.lit(0).alias("offset"), "parts")), member


def recurrence(frames: DataFrame, fraction: float = S.STOP_EPISODE_FRACTION, least_episodes: int = 0, match_frames: int = S.MATCH_FRAMES, floor: int = S.MIN_REGION_FRAMES, bridge: int = S.BRIDGE_FRAMES) -> tuple[DataFrame, DataFrame]:
    """The corpus matched with itself: regions (episode_id, first, last, members), and the diagonals they come from, one a pair."""
    frames = stage(frames)
    enough = frames.agg(F.count_distinct("episode_id").alias("_n")).where(F.col("_n") >= least_episodes)
    shared = stage(shared_frames(frames, fraction).join(F.broadcast(enough)).drop("_n"))  # one row or none
    unstage(frames)
    found, member = self_diagonals(shared, match_frames)
    ends = F.array(F.struct("episode_id", F.lit(0).alias("off")), F.struct(F.col("other").alias("episode_id"), F.col("offset").alias("off")))
    sides = found.select(F.explode(ends).alias("x"), "parts").select("x.episode_id", "x.off", F.explode("parts").alias("p"))
    hit = sides.select("episode_id", (F.col("p.first") - F.col("off")).alias("first"), (F.col("p.last") - F.col("off")).alias("last")).distinct()
    # what a first has, its copies have
    copied = hit.join(member.where("episode_id <> first").select(F.col("episode_id").alias("copy"), F.col("first").alias("episode_id")), "episode_id").select(F.col("copy").alias("episode_id"), "first", "last")
    return runs_of_pieces(hit.unionByName(copied).distinct(), ["episode_id"], bridge, max(floor, match_frames)), found


def discover_recurring(frames: DataFrame, fraction: float = S.STOP_EPISODE_FRACTION, least_episodes: int = S.RECUR_MIN_EPISODES, **kw) -> DataFrame:
    """(episode_id, first, last, members): what recurs between episodes, common values stopped; nothing below a least number of episodes."""
    return recurrence(frames, fraction, least_episodes, **kw)[0]
