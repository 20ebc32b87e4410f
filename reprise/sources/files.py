"""Whole text files as tables, unreadable ones apart as errors: transcripts, chapters, silence logs. Feed files as a sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.staging import stage
from . import feeds as fd
from .audio import scan_ranges

MOST_TEXT = 256 << 20


def scan_texts(spark: SparkSession, folder: str, most: int = MOST_TEXT) -> DataFrame:
    """(path, name, text, error) of each file under the folder; name is the file's without its suffix.

    A file that can't be read, is longer than `most` bytes or isn't UTF-8 has an error instead of a text.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.coalesce("error", F.when(text.isNull(), "not UTF-8"))
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return scan_ranges(spark, folder, most=most, over="error").select("path", name.alias("name"), text.alias("text"), error.alias("error"))


def _split(texts: DataFrame, key: Column, fault: Column) -> tuple[DataFrame, DataFrame]:
    """Texts with their key, staged so that files are read once, and (path, error) of all that have no key or a fault."""
    told = texts.withColumn("_key", key)
    told = stage(told.withColumn("error", F.coalesce("error", F.when(F.col("_key").isNull(), "no id in the file's name"), fault)))
    return told.where("error is null").select(F.col("_key").alias("episode_id"), "text"), told.where("error is not null").select("path", "error")


def _not_json(held: str) -> Column:
    """Why a JSON text has no list under `held`."""
    v = F.try_parse_json("text")
    kind = F.schema_of_variant(v)
    listed = F.schema_of_variant(F.try_variant_get(v, f"$.{held}", "variant")) if held else kind
    fit = kind.startswith("ARRAY") | F.coalesce(listed.startswith("ARRAY"), F.lit(False))
    return F.when(v.isNull(), "not JSON").when(~fit, f"no list of {held}")


def _by_name() -> Column:
    return F.col("name").try_cast("long")


def scan_transcripts(spark: SparkSession, folder: str, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(episode_id, seg_idx, start, end, text) of transcript files, and (path, error) of those that can't be read.

    A file is a list of segments, or an object that has one. The episode is the number that names the file, unless `key`
    says otherwise from (path, name). An empty list has no rows and no error.
    """
    fine, errors = _split(scan_texts(spark, folder), _by_name() if key is None else key, _not_json("segments"))
    return fd.transcript_of(fine, "episode_id", "text"), errors


def scan_chapter_files(spark: SparkSession, folder: str, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(episode_id, idx, title, startTime, endTime) of chapter files, and (path, error); an object without chapters has none and no error."""
    v = F.try_parse_json("text")
    fault = F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    fine, errors = _split(scan_texts(spark, folder), _by_name() if key is None else key, fault)
    return fd.chapters_of(fine, "episode_id", "text"), errors


def scan_silence_logs(spark: SparkSession, folder: str, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(episode_id, start, end) of silence logs, lines in the order of their file, and (path, error)."""
    fine, errors = _split(scan_texts(spark, folder), _by_name() if key is None else key, F.lit(None).cast("string"))
    lines = fine.select("episode_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    return fd.silences_of(lines, ["episode_id"], "pos", "line"), errors


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class OneFileAKey(DataSource):
    """Sink `one_file_a_key`: rows (file, part), together by file and in order, are appended to folder/file as they come."""

    @classmethod
    def name(cls) -> str:
        return "one_file_a_key"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


class FileWriter(DataSourceWriter):
    """Tasks write under a folder of the job's own; only the commit moves files to their names.

    So a task that is lost or tried again shows no file. One that is still being killed while the job aborts can leave
    parts in that folder, whose name starts with `_`, which readers skip.
    """

    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder)
        mine, done, at, out = f"{root}/{self.job}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(mine, recursive=True)
        try:
            for name, part in rows:
                if name != at:
                    if out:
                        out.close()
                    if not name or "/" in name or name.startswith(("_", ".")):
                        raise ValueError(f"{name!r} can't be the name of a file")
                    at, path = name, f"{mine}/{len(done)}"
                    out = system.open_output_stream(path)
                    done.append((path, name))
                out.write(part.encode())
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one file came from several tasks")
        for path, name in files:
            system.move(path, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def rss_parts(feeds: DataFrame, episodes: DataFrame, base_url: str, cuts: DataFrame | None = None) -> DataFrame:
    """(feed_id, kind, pubdate, id, xml): the head (0), items (1) and end (2) of each feed's document, a row each."""
    head = feeds.select(F.col("id").alias("feed_id"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("pubdate"), F.lit(None).cast("long").alias("id"), fd.channel_head(feeds).alias("xml"))
    items = fd.rss_items(episodes, base_url, cuts).join(head.select("feed_id"), "feed_id", "left_semi").select("feed_id", F.lit(1).alias("kind"), "pubdate", "id", "xml")
    return head.unionByName(items).unionByName(head.withColumns({"kind": F.lit(2), "xml": F.lit(fd.END)}))


def write_rss(feeds: DataFrame, episodes: DataFrame, base_url: str, folder: str, cuts: DataFrame | None = None) -> None:
    """A file `<feed_id>.xml` for each feed, newest episode first, undated ones last; older files of other feeds stay.

    Items are sorted by Spark and streamed to their file: no feed is ever held whole.
    """
    spark = feeds.sparkSession
    spark.dataSource.register(OneFileAKey)
    order = ["feed_id", "kind", F.desc_nulls_last("pubdate"), "id"]
    parts = rss_parts(feeds, episodes, base_url, cuts).repartition("feed_id").sortWithinPartitions(*order)
    parts.select(F.concat(F.col("feed_id").cast("string"), F.lit(".xml")).alias("file"), F.col("xml").alias("part")).write.format("one_file_a_key").mode("append").save(folder)
