import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import events
from voxframe.sources import tables, wav


def wav_file(samples, kind=1, bits=16, rate=16000, channels=1, before=b"", after=b"", data_size=None, fmt_extra=b""):
    if kind == 3:
        data = np.asarray(samples, dtype="<f4").tobytes()
    else:
        data = np.asarray(samples, dtype=f"<i{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + fmt_extra
    body = (b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt
            + b"data" + struct.pack("<I", len(data) if data_size is None else data_size) + data + after)
    return b"RIFF" + struct.pack("<I", len(body)) + body


S16 = [0, 1, -1, 32767, -32768, 100, 7]
FILES = {
    "pcm16.wav": wav_file(S16),
    "pcm32.wav": wav_file([0, 2 ** 30, -2 ** 31], bits=32),
    "float.wav": wav_file([0.0, 0.5, -2.0], kind=3, bits=32),
    "odd_chunk.wav": wav_file(S16, before=b"LIST" + struct.pack("<I", 3) + b"abc\0"),
    "trailing.wav": wav_file(S16, after=b"LIST" + struct.pack("<I", 4) + b"abcd"),
    "stream.wav": wav_file(S16, data_size=0),
    "too_long.wav": wav_file(S16, data_size=10 ** 6),
    "ext.wav": wav_file(S16, fmt_extra=b"\0\0"),
    "bad_riff.wav": b"RIFX" + wav_file(S16)[4:],
    "bad_wave.wav": wav_file(S16)[:8] + b"WAVX",
    "empty.wav": b"",
    "no_fmt.wav": b"RIFF\0\0\0\0WAVE",
    "cut_skip.wav": b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", 50) + b"xx",
    "short_fmt.wav": b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 4) + b"abcd",
    "no_data.wav": wav_file([])[:36],
    "cut_data.wav": wav_file([])[:42],
    "alaw.wav": wav_file(S16, kind=6),
    "pcm24.wav": wav_file([1], bits=32)[:34] + struct.pack("<H", 24) + wav_file([1], bits=32)[36:],
    "float64.wav": wav_file([1.0], kind=3, bits=32)[:34] + struct.pack("<H", 64) + wav_file([1.0], kind=3, bits=32)[36:],
    "stereo.wav": wav_file(S16, channels=2),
    "rate.wav": wav_file(S16, rate=8000),
}
ERRORS = {
    "bad_riff.wav": "where RIFF belongs", "bad_wave.wav": "where WAVE belongs", "empty.wav": "where RIFF belongs",
    "no_fmt.wav": "no fmt chunk", "cut_skip.wav": "past the end", "short_fmt.wav": "fewer than 16",
    "no_data.wav": "no data chunk", "cut_data.wav": "ends inside", "alaw.wav": "format 6", "pcm24.wav": "24 bits",
    "float64.wav": "64 bits", "stereo.wav": "2 channels", "rate.wav": "8000 samples",
}
VALUES = {
    "pcm32.wav": [0.0, 0.5, -1.0], "float.wav": [0.0, 0.5, -2.0],
    **{n: [v / 32768 for v in S16] for n in ("pcm16.wav", "odd_chunk.wav", "trailing.wav", "stream.wav", "too_long.wav", "ext.wav")},
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    return str(folder)


def by_name(rows, field="path"):
    return {os.path.basename(getattr(r, field)): r for r in rows}


def check_headers(rows):
    got = by_name(rows)
    assert set(got) == set(FILES)
    for name, r in got.items():
        if name in ERRORS:
            assert ERRORS[name] in r.error and r.data_offset is None, (name, r.error)
        else:
            assert r.error is None and r.sample_rate == 16000 and r.channels == 1, (name, r.error)


def test_headers_from_files_and_content(spark, corpus):
    headers = wav.wav_headers(spark, corpus)
    missing = spark.createDataFrame([(f"{corpus}/empty.wav",)], "path string")
    empty = wav.wav_headers_at(missing)
    check_headers(headers.collect() + empty.collect())
    gone = wav.wav_headers_at(spark.createDataFrame([(f"{corpus}/gone.wav",)], "path string")).first()
    assert gone.error and gone.file_size is None
    files = spark.createDataFrame([(n, bytearray(d)) for n, d in FILES.items()], "path string, content binary")
    check_headers(wav.wav_headers_of(files).collect())
    profile = wav.wav_corpus_profile(headers.unionByName(empty)).collect()
    assert sum(r.files for r in profile) == len(FILES)
    good = {(r.audio_format, r.bits_per_sample): (r.files, r.hours) for r in profile if r.error is None}
    assert good[(1, 16)][0] == 6 and good[(1, 16)][1] == pytest.approx(2 * 7 * 4 / 32000 / 3600 + (14 + 14) / 32000 / 3600)


def check_samples(chunks):
    got = {}
    for r in tables.samples_by_value(chunks).orderBy("stream_id", "sample_idx").collect():
        got.setdefault(os.path.basename(r.stream_id), []).append(r.value)
    assert set(got) == set(VALUES)
    # The unbounded and oversized files run to the end of the file.
    assert got == VALUES


@pytest.mark.parametrize("range_bytes", [8, 1 << 20])
def test_decode(spark, corpus, range_bytes):
    check_samples(wav.decode_pcm(wav.wav_headers(spark, corpus), chunk_samples=2, range_bytes=range_bytes))
    files = spark.createDataFrame([(n, bytearray(d)) for n, d in FILES.items()], "path string, content binary")
    chunks = wav.decode_pcm(wav.wav_headers_of(files), files, chunk_samples=2, range_bytes=range_bytes)
    check_samples(chunks)
    seqs = [(r.chunk_seq, r.start_sample) for r in chunks.filter("stream_id = 'pcm16.wav'").orderBy("chunk_seq").collect()]
    assert seqs == [(0, 0), (1, 2), (2, 4), (3, 6)]


def test_properties(spark):
    headers = spark.createDataFrame(
        [("a", 16000, 1, 16, 64000), ("b", None, None, None, None), ("c", 44100, 2, 16, 0)],
        "path string, sample_rate int, channels int, bits_per_sample int, data_size bigint")
    got = {r.path: (r.duration_s, r.error) for r in wav.wav_properties(headers).collect()}
    assert got == {"a": (2.0, None), "b": (None, "No audio stream found in source"),
                   "c": (None, "Cannot determine audio duration")}


def test_export_and_write(spark, tmp_path):
    rows = [("s", 0, 0.5, 0.002, [0.5, -1.0, 2.0]), ("s", 1, 3725.9996, 1.0005, [0.25])]
    df = spark.createDataFrame(rows, "stream_id string, segment_idx bigint, start_s double, duration_s double, samples array<float>")
    named = events.segment_names(df)
    assert sorted(r.name for r in named.collect()) == ["segment_0000_500ms_502ms.wav", "segment_0001_3725999ms_3727000ms.wav"]
    out = wav.export_segments(named)
    content = {r.name: bytes(r.wav) for r in out.collect()}
    import io
    import wave
    with wave.open(io.BytesIO(content["segment_0000_500ms_502ms.wav"])) as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (16000, 1, 2)
        assert np.frombuffer(f.readframes(9), dtype="<i2").tolist() == [16384, -32768, 32767]
    wav.write_segment_files(out, f"file://{tmp_path}/out")
    for name, data in content.items():
        assert (tmp_path / "out" / "s" / name).read_bytes() == data
    with pytest.raises(ValueError, match="Unsupported output format"):
        events.segment_names(df, "mp3")
