"""Audio by ranges: capped reads of files, and fingerprints of WAV files from their short-time spectra.

Files are opened with `pyarrow.fs` where the task runs, and only the bytes asked for are read. A long file is cut into
pieces of frames that go to different tasks, so neither a file nor its frames stand whole in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S
from ..functions.staging import stage
from ..streaming.index import latest

MOST_BYTES = 1024 << 20
#: A frame looks at this many seconds of sound, and its bits at so many frames around it.
WINDOW_SECONDS, CONTEXT = 0.3715, 32
#: 33 bands of equal ratio give 32 bits.
LOWEST, HIGHEST, BANDS = 150.0, 3500.0, 33
PIECE = 4096
AT_ONCE = 256
HEADER = 64 << 10
FORMATS = {(1, 8): "u1", (1, 16): "<i2", (1, 24): "u1", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}
PROBE = "bits INT, format INT, channels INT, rate INT, data_at LONG, data_bytes LONG"


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class ByteRanges(DataSource):
    """`spark.read.format("byte_ranges").load(folder)`: a row per file, with bytes [start, start + most) of it.

    Options: start (0), most (1 GiB), over: `cut` gives the first `most` bytes of a longer file, `error` none of them.
    A file that can't be read, or changed its size since it was listed, is a row with `error`.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path STRING, size LONG, start LONG, content BINARY, error STRING"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    TASK_BYTES, TASK_FILES = 128 << 20, 1000

    def __init__(self, options: dict[str, str]):
        self.folder, self.start, self.most = options["path"], int(options.get("start", 0)), int(options.get("most", MOST_BYTES))
        self.over = options.get("over", "cut")
        if self.over not in ("cut", "error"):
            raise ValueError(f"over must be cut or error, not {self.over}")

    def partitions(self) -> list[InputPartition]:
        """Files together up to so many bytes that will be read; only names and sizes come to the driver, as for any file source."""
        system, name = fs.FileSystem.from_uri(self.folder)
        scheme = self.folder.partition("://")[0] + "://" if "://" in self.folder else ""
        found = [i for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))]
        out, held = [], 0
        for i in sorted(found, key=lambda i: i.path):
            wanted = max(0, min(self.most, i.size - self.start))
            if not out or held + wanted > self.TASK_BYTES or len(out[-1].files) >= self.TASK_FILES:
                out.append(Files([]))
                held = 0
            out[-1].files.append((scheme + i.path, i.size))
            held += wanted
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            try:
                if self.over == "error" and size - self.start > self.most:
                    raise ValueError(f"{size} bytes, over the cap of {self.most}")
                with _opened(path) as f:
                    if f.size() != size:
                        raise ValueError(f"{f.size()} bytes, {size} when it was listed")
                    content = f.read_at(max(0, min(self.most, size - self.start)), self.start) if self.start < size else b""
                yield path, size, self.start, content, None
            except (OSError, ValueError) as e:
                yield path, size, self.start, None, str(e)


def scan_ranges(spark: SparkSession, folder: str, start: int = 0, most: int = MOST_BYTES, over: str = "cut") -> DataFrame:
    """(path, size, start, content, error) of each file under the folder; never more than `most` bytes of one are read."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(start=str(start), most=str(most), over=over).load(folder)


class Wav(NamedTuple):
    bits: int
    format: int
    channels: int
    rate: int
    data_at: int
    data_bytes: int


def wav_header(f, most: int = MOST_BYTES) -> Wav:
    """Where the samples stand and how they are written; a streamed file, whose sizes are not known, goes to its end or the cap."""
    size, head = f.size(), f.read_at(min(HEADER, f.size()), 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        kind, length = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        body = head[at + 8 : at + 24 + 10]
        if kind == b"fmt " and len(body) >= 16:
            code, channels, rate, bits = (int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            code = int.from_bytes(body[24:26], "little") if code == 0xFFFE else code
            if (code, bits) not in FORMATS or not channels or rate < 2 * HIGHEST:
                raise ValueError(f"samples of format {code}, {bits} bits, {channels} channels, {rate} a second aren't read")
            form = bits, code, channels, rate
        elif kind == b"data" and form:
            whole = max(0, min(length, size - at - 8, most - at - 8))
            return Wav(*form, at + 8, whole - whole % (form[0] // 8 * form[2]))
        at += 8 + length + length % 2
    raise ValueError("no samples found")


def _samples(raw: bytes, wav: Wav) -> np.ndarray:
    """The mean of the channels, between -1 and 1."""
    x = np.frombuffer(raw, FORMATS[wav.format, wav.bits])
    if wav.bits == 24:
        b = x.reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float64) / (1 << 23)
    elif wav.format == 1:
        x = x / 128.0 - 1 if wav.bits == 8 else x.astype(np.float64) / (1 << (wav.bits - 1))
    return np.nan_to_num(x.astype(np.float64)).reshape(-1, wav.channels).mean(1)


def frame_count(wav: Wav) -> int:
    samples = wav.data_bytes // (wav.bits // 8 * wav.channels)
    left = samples - round(WINDOW_SECONDS * wav.rate)
    return 0 if left < 0 else int(left / (S.NOMINAL_SECONDS_PER_FRAME * wav.rate)) + 1


def energies(f, wav: Wav, first: int, last: int) -> np.ndarray:
    """Logarithms of the energy in each band, for frames first..last-1; a range of the file is read for 256 frames at a time."""
    step, hop, window = wav.bits // 8 * wav.channels, S.NOMINAL_SECONDS_PER_FRAME * wav.rate, round(WINDOW_SECONDS * wav.rate)
    hz = np.fft.rfftfreq(window, 1 / wav.rate)
    band = np.searchsorted(np.geomspace(LOWEST, HIGHEST, BANDS + 1), hz, "right") - 1
    member = (band[:, None] == np.arange(BANDS)).astype(np.float64)
    hann, out = np.hanning(window), []
    for a in range(first, last, AT_ONCE):
        starts = np.array([int(k * hop) for k in range(a, min(last, a + AT_ONCE))])
        low, high = int(starts[0]), int(starts[-1]) + window
        raw = f.read_at((high - low) * step, wav.data_at + low * step)
        if len(raw) < (high - low) * step:
            raise ValueError("the file ends before its samples")
        x = _samples(raw, wav)
        cut = np.lib.stride_tricks.sliding_window_view(x, window)[starts - low]
        out.append(np.log((np.abs(np.fft.rfft(cut * hann)) ** 2) @ member + 1e-6))
    return np.concatenate(out) if out else np.empty((0, BANDS))


def values(f, wav: Wav, first: int, last: int) -> np.ndarray:
    """32-bit values of frames first..last-1, whichever piece asks for them.

    Bit b says whether the energy of band b over that of band b + 1 is rising around the frame: its signs against one
    period of a sine under a bell, which is smooth enough that sound that starts between two frames keeps most values.
    Silence is 0.
    """
    count, half = frame_count(wav), CONTEXT // 2
    low, high = max(0, first - half), min(count, last + half)
    e = energies(f, wav, low, high)
    e = np.pad(e, ((half - (first - low), half - (high - last)), (0, 0)), "edge")  # only at the ends of the file
    at = np.arange(-half, half + 1)
    wave = np.sin(2 * np.pi * at / CONTEXT) * np.hanning(len(at) + 2)[1:-1]
    change = np.einsum("fbc,c->fb", np.lib.stride_tricks.sliding_window_view(e[:, :-1] - e[:, 1:], len(at), axis=0), wave)
    return (change > 1e-9).astype(np.int64) @ (np.int64(1) << np.arange(BANDS - 1))


def probe(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files(key, path, ...) with what their headers say, `frames` and `duration` in seconds; `error` where one can't be read."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + f", {PROBE}, frames LONG, duration DOUBLE, error STRING"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for path in batch.column("path").to_pylist():
                try:
                    if path is None:
                        raise ValueError("no path")
                    with _opened(path) as f:
                        wav = wav_header(f, most)
                    told.append([*wav, frame_count(wav), wav.data_bytes / (wav.bits // 8 * wav.channels * wav.rate), None])
                except (OSError, ValueError) as e:
                    told.append([None] * 8 + [str(e)])
            types = [pa.int32()] * 4 + [pa.int64()] * 3 + [pa.float64(), pa.string()]
            more = [pa.array([row[i] for row in told], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *Wav._fields, "frames", "duration", "error"])

    return files.mapInArrow(ask, schema)


def regions_of(probed: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Probed files cut down to regions(key, region, start, end) in seconds: only the bytes of a region count as its samples."""
    step, rate = F.expr("bits / 8 * channels").cast("long"), F.col("rate")
    both = probed.drop("frames", "duration").join(regions.select(key, "region", "start", "end"), key)
    total = F.expr("data_bytes div (bits div 8 * channels)")
    low = F.greatest(F.lit(0), F.least(total, F.floor(F.col("start") * rate)))
    high = F.greatest(low, F.least(total, F.ceil(F.col("end") * rate)))
    cut = both.select("*", low.cast("long").alias("_low"), (high - low).cast("long").alias("_many"), step.alias("_step"))
    window, hop = F.round(F.lit(WINDOW_SECONDS) * rate), F.lit(S.NOMINAL_SECONDS_PER_FRAME) * rate
    frames = F.when(F.col("_many") >= window, F.floor((F.col("_many") - window) / hop) + 1).otherwise(0)
    made = {"data_at": F.col("data_at") + F.col("_low") * F.col("_step"), "data_bytes": F.col("_many") * F.col("_step"), "frames": frames.cast("long"), "duration": F.col("_many") / rate}
    return cut.withColumns(made).drop("_low", "_many", "_step", "start", "end")


def frames_of(probed: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """(keys, piece, values, error) of probed files or regions, each piece of frames in a task of its own choice."""
    cut = probed.where("error is null and frames > 0").select(*keys, "path", *Wav._fields, "frames", F.explode(F.sequence(F.lit(0), F.expr(f"cast((frames - 1) div {piece} as int)"))).alias("piece"))
    parts = max(cut.sparkSession.sparkContext.defaultParallelism, cut.count() // 4)  # headers only; a task has some four pieces
    types = {f.name: f.dataType.simpleString() for f in probed.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", piece INT, values ARRAY<LONG>, error STRING"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["path", *Wav._fields, "frames", "piece"]).to_pylist()):
                wav, first, error = Wav(*[row[n] for n in Wav._fields]), row["piece"] * piece, None
                try:
                    with _opened(row["path"]) as f:
                        got = values(f, wav, first, min(row["frames"], first + piece))
                except (OSError, ValueError) as e:  # the file went or shrank since its header was read
                    got, error = np.empty(0, np.int64), str(e)
                own = [batch.column(k).slice(i, 1) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([row["piece"]], pa.int32()), pa.array([got], pa.list_(pa.int64())), pa.array([error], pa.string())], names=[*keys, "piece", "values", "error"])

    return cut.repartition(parts, *keys, "piece").mapInArrow(made, schema)


def fingerprints(probed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint, duration, error) of every probed file or region: empty if shorter than a frame, null with an error."""
    pieces = frames_of(probed, keys).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.array_sort(F.collect_list(F.struct("piece", "values"))).alias("_p"), F.max("error").alias("_e"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    error = F.coalesce("error", "_e")
    whole = F.when(error.isNull(), F.coalesce(F.flatten(F.transform("_p", lambda p: p["values"])), F.array().cast("array<long>")))
    return probed.join(pieces, same, "left").select(*keys, whole.alias("fingerprint"), F.when(error.isNull(), F.col("duration")).alias("duration"), error.alias("error"))


def fingerprinted(cache: DataFrame, files: DataFrame, key: str = "episode_id", most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(the cache with the files it lacked, errors(key, path, error)); a file whose key is in the cache isn't opened.

    cache has (key, fingerprint, duration, created_at); files has (key, path), one file a key. What gives no frame isn't
    cached and is asked again next time.
    """
    missing = probe(files.select(key, "path").join(cache.select(key), key, "left_anti"), most)
    missing = stage(missing)
    made = stage(fingerprints(missing, [key]))
    fresh = made.where(F.size("fingerprint") > 0).select(key, "fingerprint", "duration", S.iso_z(F.current_timestamp()).alias("created_at"))
    errors = made.where("error is not null").select(key, "error").join(missing.select(key, "path"), key).select(key, "path", "error")
    return latest(cache, fresh, key), errors
