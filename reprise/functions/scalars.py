"""Column expressions: text, durations, keywords, frames, bytes. All JVM-side but for half-even rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results must use these.
SHINGLE_K, MATCH_THRESHOLD, BRIDGE_GAP = 5, 0.4, 2
MIN_SHOW_HISTORY = 3
MATCH_FRAMES, MIN_REGION_FRAMES, BRIDGE_FRAMES = 40, 80, 16
STOP_EPISODE_FRACTION = 0.30
EDITORIAL_SAMPLE_SECONDS, EDITORIAL_WINDOW, EDITORIAL_MIN_WINDOW = 180, 60, 10
NOMINAL_SECONDS_PER_FRAME = 0.123882
RECUR_MIN_EPISODES = 8
SPEECH_MIN_WORDS = 5
CUT_ANOMALY_FRACTION = 0.35
SNAP_WINDOW = 2.5
TIME_BUCKET, POINT_BUCKET = 60.0, 256  # our own: joins on time and place file both sides under such stretches
ANCHOR_SIZE, ANCHOR_SKIP = 4096, 200_000
DEFAULT_BYTES, ESCALATED_BYTES = 6 << 20, 20 << 20
DAI_EDGE_MARGIN, MAX_DAI_BREAK, MIN_DAI_BREAK = 2.0, 240.0, 8.0
CHUNK_CHARS = 20_000
AUDIO_GONE_STATUSES = (404, 410)
TEXT_SOURCES = ("chapter", "llm", "manual")
AUDIO_SOURCES = ("chapter", "llm", "manual", "dai")
CUT_SOURCES = ("chapter", "llm", "manual", "repeat", "fpmatch")
AD_KEYWORDS = r"\b(ad|ads|advert|advertisement|sponsor|sponsors|sponsored|promo)\b"


def normalize_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +"), lambda x: x != "")


def ordered_shingles(words: Column, k: int = SHINGLE_K) -> Column:
    """k consecutive words joined by spaces, in order, repeats kept; none if there are fewer than k."""
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def shingles(words: Column, k: int = SHINGLE_K) -> Column:
    return F.array_distinct(ordered_shingles(words, k))


def parse_duration(text: Column) -> Column:
    """S, M:S or H:M:S; each part is truncated to whole units, anything else is null."""
    parts = F.split(F.trim(text), ":")
    whole = F.forall(parts, lambda p: p.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"))
    n = F.transform(parts, lambda p: p.try_cast("double").cast("long"))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s * 60 + x)
    return F.when(whole & F.size(parts).between(1, 3), total).cast("int")


def keyword_match(title: Column) -> Column:
    return F.coalesce(title.rlike("(?i)" + AD_KEYWORDS), F.lit(False))


def is_audio_gone(status: Column) -> Column:
    return status.isin(*AUDIO_GONE_STATUSES)


def is_anomalous_cut(ad_seconds: Column, duration: Column, fraction: float = CUT_ANOMALY_FRACTION) -> Column:
    return F.coalesce((duration > 0) & (F.try_divide(ad_seconds, duration) > fraction), F.lit(False))


def frame_span(first: Column, last: Column, frames: Column, duration: Column) -> tuple[Column, Column]:
    """Seconds of the frames first..last of an episode."""
    return first * duration / frames, (last + 1) * duration / frames


def nominal_duration(frames: Column) -> Column:
    return frames * NOMINAL_SECONDS_PER_FRAME


def parse_fingerprint(raw: Column) -> Column:
    return F.transform(F.filter(F.split(raw, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long").bitwiseAND(F.lit(4294967295)))


def clamp(x: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, duration))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def split_sources(arg: Column) -> Column:
    return F.filter(F.transform(F.split(arg, ","), F.trim), lambda x: x != "")


@F.pandas_udf(T.StringType())
def render_segment(idx: pd.Series, start: pd.Series, end: pd.Series, text: pd.Series) -> pd.Series:
    """"[i] s-e: text" with one decimal, halves to even, as a prompt shows it."""
    return pd.Series([f"[{i}] {s:.1f}-{e:.1f}: {t}" for i, s, e, t in zip(idx, start, end, text)])
