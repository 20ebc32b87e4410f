"""Podcast-shaped views over the driver's tables, each as a DataFrame and as the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence, text

SOURCES = ("chapter", "llm", "manual", "dai", "repeat", "fpmatch", "recur")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as transcript segments; 16 characters are a second."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))
    done = F.sum(F.length("text") + 1).over(Window.partitionBy("episode_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("episode_id", "seg_idx", ((done - F.length("text") - 1) / 16).alias("start"), (done / 16).alias("end"), "text")


SEG = """seg1 AS (SELECT doc_id AS episode_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS p FROM documents),
seg AS (SELECT episode_id, CAST(i - 1 AS INT) AS seg_idx, CAST(sum(length(p[i]) + 1) OVER w - length(p[i]) - 1 AS DOUBLE) / 16 AS "start", CAST(sum(length(p[i]) + 1) OVER w AS DOUBLE) / 16 AS "end", p[i] AS text
  FROM seg1 WINDOW w AS (PARTITION BY episode_id ORDER BY i ROWS UNBOUNDED PRECEDING))"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Detected spans of all tiers, made from events: dealt evenly over all documents, starting anywhere in theirs."""
    e, x = F.col("event_id"), F.col("event_id") * 7919
    source = F.get(F.array(*[F.lit(x) for x in SOURCES]), F.expr("event_id * 2654435761 % 4294967296 div 65536 % 7").cast("int"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), F.greatest(F.length("text"), F.lit(1)).alias("_n"))
    many = F.broadcast(d.agg(F.count("*").alias("_many")))  # one row
    dealt = table(spark, sf, "events").select("event_id").join(many).select("event_id", (e % F.col("_many")).alias("episode_id"))
    return dealt.join(d, "episode_id").select(e.alias("id"), "episode_id", (x % F.col("_n") / 16).alias("start"), ((x % F.col("_n") + e * 13 % 400 + 16) / 16).alias("end"), source.alias("source"))


SPANS = f"""spans AS (SELECT v.event_id AS id, d.doc_id AS episode_id, CAST(v.event_id * 7919 % greatest(length(d.text), 1) AS DOUBLE) / 16 AS "start",
  CAST(v.event_id * 7919 % greatest(length(d.text), 1) + v.event_id * 13 % 400 + 16 AS DOUBLE) / 16 AS "end", [{", ".join(repr(x) for x in SOURCES)}][v.event_id * 2654435761 % 4294967296 // 65536 % 7 + 1] AS source
  FROM events v JOIN documents d ON d.doc_id = v.event_id % (SELECT count(*) FROM documents))"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as episodes at various stages; labelled ones have been examined."""
    d, seen = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.lit("2026-01-02T03:04:05Z").alias("llm_detected_at")).distinct()
    i = F.col("doc_id")
    when = lambda c, v: F.when(c, F.lit(v) if isinstance(v, str) else v)
    return d.join(seen, "doc_id", "left").select(
        i.alias("id"), F.substring("source", 4, 9).cast("long").alias("feed_id"), F.concat(F.lit("g"), i.cast("string")).alias("guid"),
        when(i % 9 != 0, F.concat(F.lit("Show & tell "), i.cast("string"))).alias("title"),
        when(i % 10 != 0, F.concat(F.lit("2026-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).alias("pubdate"),
        (F.col("n_chars") / 16).alias("duration"), when(i % 7 != 0, F.concat(F.lit("https://a/"), i.cast("string"), F.lit(".mp3"))).alias("audio_url"),
        when(i % 5 == 0, "https://a/c.json").alias("chapters_url"), when(i % 15 == 0, "2026-01-01T00:00:00Z").alias("chapters_scanned_at"),
        when(i % 3 != 0, "t").alias("transcript_path"), "llm_detected_at", when(i % 13 == 0, "c").alias("cut_path"),
        when(i % 11 == 0, "2026-01-03T00:00:00Z").alias("audio_gone_at"), when(i % 17 == 0, "2026-01-04T00:00:00Z").alias("cut_held_at"),
    )


EPISODES = """episodes AS (SELECT d.doc_id AS id, CAST(substring(d.source, 4) AS BIGINT) AS feed_id, 'g' || d.doc_id AS guid, CASE WHEN d.doc_id % 9 <> 0 THEN 'Show & tell ' || d.doc_id END AS title,
  CASE WHEN d.doc_id % 10 <> 0 THEN '2026-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS pubdate, CAST(n_chars AS DOUBLE) / 16 AS duration,
  CASE WHEN d.doc_id % 7 <> 0 THEN 'https://a/' || d.doc_id || '.mp3' END AS audio_url, CASE WHEN d.doc_id % 5 = 0 THEN 'https://a/c.json' END AS chapters_url,
  CASE WHEN d.doc_id % 15 = 0 THEN '2026-01-01T00:00:00Z' END AS chapters_scanned_at, CASE WHEN d.doc_id % 3 <> 0 THEN 't' END AS transcript_path,
  CASE WHEN l.doc_id IS NOT NULL THEN '2026-01-02T03:04:05Z' END AS llm_detected_at, CASE WHEN d.doc_id % 13 = 0 THEN 'c' END AS cut_path,
  CASE WHEN d.doc_id % 11 = 0 THEN '2026-01-03T00:00:00Z' END AS audio_gone_at, CASE WHEN d.doc_id % 17 = 0 THEN '2026-01-04T00:00:00Z' END AS cut_held_at
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)"""


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("https://f/"), F.col("n_nationkey").cast("string")).alias("source_url"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("title"), F.lit(None).cast("string").alias("description"))


FEEDS = "feeds AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 'https://f/' || n_nationkey AS source_url, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS title, CAST(NULL AS VARCHAR) AS description FROM nation)"


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events as spans on a user's timeline, in whole microseconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", "user_id", start.alias("start"), (start + F.round(F.col("value") * 1000000).cast("long")).alias("end"), F.col("event_type").alias("source"))


TIMELINE = "tl AS (SELECT event_id, user_id, epoch_us(ts) AS \"start\", epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS \"end\", event_type AS source FROM events)"


def library(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles of the benchmark passages, standing for confirmed material."""
    return text.shingled(table(spark, sf, "benchmark"), ["item_id"]).select("shingle").distinct()


WORDS = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')"
LIB = f"""libw AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark),
lib AS (SELECT DISTINCT array_to_string(w[i:i+4], ' ') AS shingle FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM libw WHERE len(w) >= 5))"""
SEGW = f"segw AS (SELECT episode_id, seg_idx, {WORDS.format(t='text')} AS w FROM seg)"
GRAMS = "grams AS (SELECT DISTINCT episode_id, seg_idx, array_to_string(w[i:i+4], ' ') AS shingle FROM (SELECT episode_id, seg_idx, w, unnest(range(1, len(w) - 3)) AS i FROM segw WHERE len(w) >= 5))"
RATIO = "ratio AS (SELECT g.episode_id, g.seg_idx, count(*) AS grams, count(l.shingle) AS hits, CAST(count(l.shingle) AS DOUBLE) / count(*) AS ratio FROM grams g LEFT JOIN lib l ON l.shingle = g.shingle GROUP BY 1, 2)"


def doc_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.text_fingerprints(table(spark, sf, "documents"), "doc_id")


def doc_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.text_frames(table(spark, sf, "documents"), "doc_id")


def library_frames(spark: SparkSession, sf: str) -> DataFrame:
    b = sequence.text_frames(table(spark, sf, "benchmark"), "item_id")
    return b.select((-1 - F.col("episode_id")).alias("episode_id"), F.col("episode_id").alias("ad_id"), "frame", "value")


def _frames_sql(name: str, table_: str, key: str) -> str:
    return f"""{name}w AS (SELECT {key} AS episode_id, {WORDS.format(t="text")} AS w FROM {table_}),
{name} AS (SELECT episode_id, CAST(i - 1 AS INT) AS frame, CAST(('0x' || substring(md5(array_to_string(w[i:i+4], ' ')), 1, 8)) AS BIGINT) AS value FROM (SELECT episode_id, w, unnest(range(1, len(w) - 3)) AS i FROM {name}w WHERE len(w) >= 5))"""


FRAMES = _frames_sql("fr", "documents", "doc_id")
LIBFRAMES = _frames_sql("lf", "benchmark", "item_id")


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's bytes beside those of the next id, as two downloads."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("a"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id").select(F.col("doc_id").alias("episode_id"), "a", "b")
