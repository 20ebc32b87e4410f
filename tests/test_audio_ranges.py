import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.operators import sequence
from reprise.sources import audio

RATE = 11025


def tune(seed: int, seconds: float) -> np.ndarray:
    """Notes of changing pitch with overtones."""
    r = np.random.default_rng(seed)
    out = []
    while sum(map(len, out)) < seconds * RATE:
        t = np.arange(int(RATE * r.uniform(0.15, 0.5))) / RATE
        out.append(sum(r.uniform(0.1, 1) * np.sin(2 * np.pi * r.uniform(150, 3300) * t) for _ in range(6)))
    x = np.concatenate(out)[: int(seconds * RATE)]
    return 0.2 * x + 0.001 * r.standard_normal(len(x))


def saved(path, x: np.ndarray, channels: int = 1) -> str:
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.repeat((np.clip(x, -1, 1) * 32000).astype("<i2"), channels).tobytes())
    return str(path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("audio")
    ad = tune(1, 40)
    saved(d / "1.wav", np.concatenate([tune(2, 31.37), ad, tune(3, 20)]))
    saved(d / "2.wav", np.concatenate([tune(4, 12.811), ad, tune(5, 45.2)]), channels=2)
    saved(d / "3.wav", 0.3 * np.random.default_rng(6).standard_normal(90 * RATE))
    saved(d / "4.wav", 0.3 * np.random.default_rng(7).standard_normal(90 * RATE))
    saved(d / "5.wav", np.zeros(100))
    (d / "6.wav").write_bytes(b"RIFF....not sound")
    return d


@pytest.fixture(scope="module")
def files(spark, folder):
    rows = [(i, str(folder / f"{i}.wav")) for i in range(1, 7)] + [(8, str(folder / "none.wav")), (9, None)]
    return spark.createDataFrame(rows, "episode_id long, path string")


def test_equal_sound_matches_at_another_place(spark, files):
    probed = audio.probe(files).cache()
    got = {r["episode_id"]: r for r in audio.fingerprints(probed, ["episode_id"]).collect()}
    assert {i for i, r in got.items() if r["error"]} == {6, 8, 9} and got[5]["fingerprint"] == []
    assert abs(got[1]["duration"] - 91.37) < 0.01 and abs(len(got[1]["fingerprint"]) * 0.123882 - 91.37) < 0.5
    assert all(0 <= v < 1 << 32 for v in got[3]["fingerprint"])
    rows = [(i, r["fingerprint"]) for i, r in got.items() if r["fingerprint"]]
    frames = sequence.frames(spark.createDataFrame(rows, "episode_id long, fingerprint array<long>"))
    library = frames.withColumn("ad_id", F.col("episode_id"))
    found = {r["episode_id"]: r for r in sequence.match_regions(frames, library).collect()}
    assert set(found) == {1, 2}
    for i, start in ((1, 31.37), (2, 12.811)):
        assert abs(found[i]["first"] * 0.123882 - start) < 5 and abs(found[i]["last"] * 0.123882 - start - 40) < 5


def test_pieces_equal_the_whole(files):
    probed = audio.probe(files.where("episode_id <= 2")).cache()
    whole = {r["episode_id"]: r["values"] for r in audio.frames_of(probed, ["episode_id"]).collect()}
    parts: dict = {}
    for r in sorted(audio.frames_of(probed, ["episode_id"], piece=37).collect(), key=lambda r: r["piece"]):
        parts.setdefault(r["episode_id"], []).extend(r["values"])
    assert parts == whole and len(whole) == 2


def test_region_equals_a_file_of_its_own(spark, files, folder, tmp_path):
    regions = spark.createDataFrame([(1, 7, 31.0, 71.0), (1, 8, 80.0, 500.0), (1, 9, 95.0, 99.0)], "episode_id long, region long, start double, end double")
    cut = audio.regions_of(audio.probe(files.where("episode_id = 1")), regions, "episode_id")
    got = {r["region"]: r for r in audio.fingerprints(cut, ["episode_id", "region"]).collect()}
    with wave.open(str(folder / "1.wav")) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    alone = tmp_path / "alone.wav"
    with wave.open(str(alone), "wb") as w:
        w.setparams((1, 2, RATE, 0, "NONE", ""))
        w.writeframes(x[31 * RATE : 71 * RATE].tobytes())
    want = audio.fingerprints(audio.probe(spark.createDataFrame([(1, str(alone))], "episode_id long, path string")), ["episode_id"]).first()
    assert got[7]["fingerprint"] == want["fingerprint"] and got[7]["duration"] == want["duration"] == 40.0
    assert abs(got[8]["duration"] - 11.37) < 0.01 and got[9]["fingerprint"] == []


def test_only_what_the_cache_lacks(spark, files):
    cache = spark.createDataFrame([(1, [5, 6], 1.0, "2020"), (8, [7], 2.0, "2020")], "episode_id long, fingerprint array<long>, duration double, created_at string")
    now, errors = audio.fingerprinted(cache, files)
    held = {r["episode_id"]: r["fingerprint"] for r in now.collect()}
    assert held[1] == [5, 6] and held[8] == [7] and set(held) == {1, 2, 3, 4, 8} and len(held[2]) > 700
    assert {r["episode_id"] for r in errors.collect()} == {6, 9}  # not sound, no path; 8 is cached and wasn't opened
    again, _ = audio.fingerprinted(now, files)
    assert {r["episode_id"]: r["fingerprint"] for r in again.collect()} == held


@pytest.mark.parametrize("bits,code,kind", [(8, 1, "u1"), (24, 1, None), (32, 1, "<i4"), (32, 3, "<f4")])
def test_sample_formats(bits, code, kind):
    x = np.linspace(-0.9, 0.9, 50)
    if kind is None:
        raw = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)
    else:
        raw = (x if code == 3 else (x + 1) * 128 if bits == 8 else x * (1 << 31)).astype(kind).tobytes()
    assert np.allclose(audio._samples(raw, audio.Wav(bits, code, 1, RATE, 0, len(raw))), x, atol=0.01)


def test_streamed_header_and_cap():
    head = b"RIFF\xff\xff\xff\xffWAVEfmt \x10\0\0\0\x01\0\x01\0" + RATE.to_bytes(4, "little") + bytes(4) + b"\x02\0\x10\0data\xff\xff\xff\xff"
    raw = head + bytes(1001)

    class Held(io.BytesIO):
        size = lambda self: len(raw)
        read_at = lambda self, n, at: raw[at : at + n]

    assert audio.wav_header(Held()).data_bytes == 1000 and audio.wav_header(Held(), len(head) + 101).data_bytes == 100


def test_capped_reads(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.write(b"begin")
        f.truncate(100 << 20)
    (tmp_path / "small.bin").write_bytes(b"0123456789")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    at = lambda r: os.path.basename(r["path"])
    cut = {at(r): r for r in audio.scan_ranges(spark, f"file://{tmp_path}", most=1 << 20).collect()}
    assert set(cut) == {"large.bin", "small.bin", "empty.bin"} and cut["large.bin"]["size"] == 100 << 20
    assert len(cut["large.bin"]["content"]) == 1 << 20 and cut["large.bin"]["content"].startswith(b"begin") and cut["empty.bin"]["content"] == b""
    strict = {at(r): r for r in audio.scan_ranges(spark, str(tmp_path), start=3, most=1 << 20, over="error").collect()}
    assert strict["large.bin"]["content"] is None and "cap" in strict["large.bin"]["error"]
    assert strict["small.bin"]["content"] == b"3456789" and strict["empty.bin"]["content"] == b""
