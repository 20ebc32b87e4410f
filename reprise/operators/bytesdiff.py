"""Two downloads of one recording compared: where they part, where they meet again, and the seconds between."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


@F.pandas_udf(T.LongType())
def first_divergence(a: pd.Series, b: pd.Series) -> pd.Series:
    """The first byte that differs within the common length, null if none."""
    def one(x, y):
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        at = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(at[0]) if len(at) else None

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")


def reconvergence(a: Column, b: Column, divergence: Column, skip: int = S.ANCHOR_SKIP, size: int = S.ANCHOR_SIZE) -> Column:
    """Where in b the anchor a[divergence + skip :][: size] stands, null if it isn't whole or isn't there."""
    anchor = F.substring(a, (divergence + skip + 1).cast("int"), F.lit(size))
    at = F.expr("0") + F.call_function("locate", F.decode(anchor, "ISO-8859-1"), F.decode(b, "ISO-8859-1")) - 1
    return F.when((F.octet_length(anchor) == size) & (at >= 0), at.cast("long"))


def probed(pairs: DataFrame, window: int, skip: int = S.ANCHOR_SKIP, size: int = S.ANCHOR_SIZE) -> DataFrame:
    """(episode_id, divergence_byte, reconvergence_byte) within the first `window` bytes of a and b."""
    cut = pairs.select("episode_id", F.substring("a", 1, window).alias("a"), F.substring("b", 1, window).alias("b")).withColumn("divergence_byte", first_divergence("a", "b"))
    return cut.select("episode_id", "divergence_byte", F.when(F.col("divergence_byte").isNotNull(), reconvergence(F.col("a"), F.col("b"), F.col("divergence_byte"), skip, size)).alias("reconvergence_byte"))


def probe_variance(pairs: DataFrame, default: int = S.DEFAULT_BYTES, escalated: int = S.ESCALATED_BYTES, skip: int = S.ANCHOR_SKIP, size: int = S.ANCHOR_SIZE) -> DataFrame:
    """Probe a small window; where the streams part and don't meet again, a larger one, taken only if they meet there."""
    small = probed(pairs, default, skip, size)
    open_ = small.where("divergence_byte is not null and reconvergence_byte is null").select("episode_id")
    large = probed(pairs.join(open_, "episode_id", "left_semi"), escalated, skip, size).where("reconvergence_byte is not null").select("episode_id", F.col("divergence_byte").alias("_d"), F.col("reconvergence_byte").alias("_r"))
    out = small.join(large, "episode_id", "left")
    return out.select("episode_id", F.coalesce("_d", "divergence_byte").alias("divergence_byte"), F.coalesce("_r", "reconvergence_byte").alias("reconvergence_byte"), F.col("_r").isNotNull().alias("escalated"))


def dai_spans(probe: DataFrame, audio: DataFrame) -> DataFrame:
    """(episode_id, start, end, confidence, reject): seconds between parting and meeting again, or why there are none."""
    per = F.col("size") / F.col("duration")
    p = probe.join(audio, "episode_id", "left").withColumn("start", F.col("divergence_byte") / per + S.DAI_EDGE_MARGIN)
    end = F.least(F.col("reconvergence_byte") / per - S.DAI_EDGE_MARGIN, F.col("start") + S.MAX_DAI_BREAK, F.col("duration"))
    p = p.withColumn("end", end)
    reject = (
        F.when(F.col("divergence_byte").isNull(), "no divergence").when(F.col("reconvergence_byte").isNull(), "no realignment").when(F.col("size").isNull(), "no audio")
        .when(F.coalesce(F.col("duration") <= 0, F.lit(True)), "unreadable").when(F.col("end") - F.col("start") < S.MIN_DAI_BREAK, "too short")
    )
    fine = reject.isNull()
    return p.select("episode_id", F.when(fine, F.col("start")).alias("start"), F.when(fine, F.col("end")).alias("end"), F.when(fine, F.lit(0.5)).alias("confidence"), reject.alias("reject"))
