"""Publisher chapters: keyword-classified titles, ends taken from the next chapter or the episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def chapter_ends(chapters: DataFrame, episodes: DataFrame) -> DataFrame:
    """chapters(episode_id, idx, title, startTime, endTime) with `end`: endTime, else the next start, else the duration."""
    nxt = F.lead("startTime").over(Window.partitionBy("episode_id").orderBy("idx"))
    told = chapters.withColumn("_next", nxt).join(episodes.select(F.col("id").alias("episode_id"), F.col("duration_seconds").alias("_d")), "episode_id", "left")
    return told.withColumn("end", F.coalesce("endTime", "_next", F.col("_d").cast("double"))).drop("_next", "_d").where("end is not null and startTime is not null")


def chapters_tier(chapters: DataFrame, episodes: DataFrame) -> DataFrame:
    told = chapter_ends(chapters, episodes).where(S.keyword_match(F.col("title")))
    return told.select("episode_id", F.col("startTime").alias("start"), "end", F.lit("chapter").alias("source"), F.col("title").alias("reason"))
