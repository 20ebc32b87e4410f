"""Work queues, upserts, tier rewriting, prioritisation and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.staging import stage


def numbered(df: DataFrame, *order: Column, name: str = "_n") -> DataFrame:
    """df with each row's place in the whole order, from 1: counted within ranges of the order, each range in a task of its own.

    The ranges are written first, so that they stay what they are; their totals are as few as there are tasks.
    """
    by = [F.struct(*order).alias("_by")]
    ranges = df.select("*", *by).repartitionByRange("_by")
    ranges = stage(ranges.withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.groupBy("_range").agg(F.count("*").alias("_many")).select("_range", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_by"))
    return ranges.withColumn("_at", within).join(F.broadcast(base), "_range").withColumn(name, (F.col("_at") + F.col("_base")).cast("long")).drop("_by", "_range", "_at", "_base")


def order_limit(df: DataFrame, limit: int | None = None, by: str = "id") -> DataFrame:
    """Ordered by id; no limit or 0 means all."""
    df = df.orderBy(by)
    return df.limit(limit) if limit else df


def pending_chapters(episodes: DataFrame, limit: int | None = None) -> DataFrame:
    return order_limit(episodes.where("chapters_url is not null and chapters_scanned_at is null"), limit)


def pending_transcribe(episodes: DataFrame, spans: DataFrame, limit: int | None = None) -> DataFrame:
    covered = spans.where("source = 'chapter'").select(F.col("episode_id").alias("id")).distinct()
    return order_limit(episodes.where("transcript_path is null and audio_url is not null and audio_gone_at is null").join(covered, "id", "left_anti"), limit)


def pending_detect(episodes: DataFrame, limit: int | None = None) -> DataFrame:
    return order_limit(episodes.where("transcript_path is not null and llm_detected_at is null"), limit)


def pending_cut(episodes: DataFrame, spans: DataFrame, sources: tuple[str, ...] = S.CUT_SOURCES, limit: int | None = None) -> DataFrame:
    some = spans.where(F.col("source").isin(*sources)).select(F.col("episode_id").alias("id"))
    return order_limit(episodes.where("cut_path is null and cut_held_at is null").join(some, "id", "left_semi"), limit)


def pending_index(episodes: DataFrame, cached: DataFrame, audio: Column, scope: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Episodes with audio and no cached fingerprint, within a scope of ids if one is given."""
    queue = episodes.where(audio).join(cached.select(F.col("episode_id").alias("id")), "id", "left_anti")
    return order_limit(queue if scope is None else queue.join(scope, "id", "left_semi"), limit)


def stamped(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Sets columns on the rows where the condition holds."""
    return df.withColumns({k: F.when(when, v).otherwise(F.col(k)) for k, v in values.items()})


def hold_cut(episodes: DataFrame, held: Column, now: Column) -> DataFrame:
    return stamped(episodes, held, cut_path=F.lit(None).cast("string"), cut_held_at=now)


def replace_tier(spans: DataFrame, new: DataFrame, source: str, looked_at: DataFrame | None = None) -> DataFrame:
    """A tier rewrites only its own rows of the episodes it looked at (all that are in `new`, if none are named); doing it twice changes nothing more."""
    done = (new if looked_at is None else looked_at).select("episode_id").distinct()
    own = spans.where(F.col("source") == source).join(done, "episode_id", "left_anti")
    return spans.where(F.col("source") != source).unionByName(own).unionByName(new.withColumn("source", F.lit(source)), allowMissingColumns=True)


def register(feeds: DataFrame, urls: DataFrame) -> DataFrame:
    """Feeds with the new urls added under the next ids; known urls stay as they are."""
    new = urls.select("source_url").distinct().join(feeds.select("source_url"), "source_url", "left_anti")
    last = feeds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    placed = numbered(new, F.col("source_url")).join(F.broadcast(last)).select((F.col("_last") + F.col("_n")).alias("id"), "source_url")  # one row
    return feeds.unionByName(placed, allowMissingColumns=True)


def refresh(feeds: DataFrame, parsed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """New values where there are any, the old ones elsewhere."""
    new = parsed.select("source_url", *[F.col(c).alias(f"_{c}") for c in columns])
    return feeds.join(new, "source_url", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*feeds.columns)


def dedupe_first(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], columns: tuple[str, ...], pos: str) -> DataFrame:
    """(keys, columns, change): inserted, updated (a value differs, nulls equal) or unchanged; the first of repeated keys wins."""
    new = dedupe_first(incoming, keys, pos).select(*keys, F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in columns])
    old = current.select(*keys, F.lit(True).alias("_was"), *columns)
    both = old.join(new, keys, "full")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_was").isNull(), "inserted").when(F.col("_in") & differs, "updated").otherwise("unchanged")
    return both.select(*keys, *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], change.alias("change"))


def spans_of_episode(spans: DataFrame, episode_id: int) -> DataFrame:
    return spans.where(F.col("episode_id") == episode_id).orderBy("start", "end")


def feed_episodes(episodes: DataFrame, feed_id: int) -> DataFrame:
    """A feed's episodes with their place, newest first, undated ones last."""
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc_nulls_last("pubdate"), "id"))
    return episodes.where(F.col("feed_id") == feed_id).withColumn("place", place)


def truth_counts(episodes: DataFrame, spans: DataFrame, sources: tuple[str, ...] = S.TEXT_SOURCES) -> DataFrame:
    """Confirmed spans per examined episode, zeros included."""
    a = spans.select(F.col("episode_id").alias("_e"), "source")
    joined = episodes.where("llm_detected_at is not null").join(a, (F.col("id") == F.col("_e")) & F.col("source").isin(*sources), "left")
    return joined.groupBy("id", "feed_id").agg(F.count("_e").alias("n"))


def median_per_show(counts: DataFrame, least: int = S.MIN_SHOW_HISTORY) -> DataFrame:
    return counts.groupBy("feed_id").agg(F.median("n").alias("median"), F.count("*").alias("episodes")).where(F.col("episodes") >= least)


def prioritize(pending: DataFrame, found: DataFrame, medians: DataFrame) -> DataFrame:
    """Pending episodes by how far their count is from the show's median; those without a median last, in order."""
    told = pending.join(found.select("id", "n"), "id", "left").join(medians.select("feed_id", "median"), "feed_id", "left")
    diff = F.abs(F.coalesce("n", F.lit(0)) - F.col("median"))
    told = told.select("id", "feed_id", diff.alias("diff"))
    return numbered(told, F.col("diff").isNull(), -F.col("diff"), F.col("id"), name="place").withColumn("place", F.col("place").cast("int"))


def stats(feeds: DataFrame, episodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(what, n): feeds, episodes, transcribed, cut, and spans by source."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    out = one("feeds", feeds).unionByName(one("episodes", episodes)).unionByName(one("transcribed", episodes.where("transcript_path is not null"))).unionByName(one("cut", episodes.where("cut_path is not null")))
    return out.unionByName(spans.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("source "), "source").alias("what"), "n"))
