"""Cutting lineage with written tables in the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode, where all executors see it."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_reprise_dir"):
        spark.sparkContext._reprise_dir = tempfile.mkdtemp(prefix="reprise-")
    return f"file://{spark.sparkContext._reprise_dir}"


_written: list[tuple[SparkSession, str]] = []
#: While tables are written: shuffle files of a write go once it is done, as what reads the table never needs them, and
#: rows go to Python in batches of a few MB, however long their texts are.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


_writing = 0
_before: dict[str, str | None] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _while_writing(spark: SparkSession):
    """SETTINGS hold while any table is being written, and what was set before once none is."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = {k: spark.conf.get(k, None) for k in SETTINGS}
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                for k, v in _before.items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    with _while_writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(*frames: DataFrame | None) -> None:
    """Delete what stage() wrote for these frames; only for intermediates nothing lazy still reads."""
    for df in frames:
        if df is not None and getattr(df, "_staged_at", None):
            drop_path(df.sparkSession, df._staged_at)
            _written[:] = [x for x in _written if x[1] != df._staged_at]


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone already
            return
