import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_wav import FILES, wav_file
from voxframe.operators import framing
from voxframe.sources import wav
from voxframe.sources.corpus import WavCorpus
from voxframe.sources.wav_source import WavChunks, WavChunksReader


def signal(n, channels=1, seed=0):
    return np.random.default_rng(seed).integers(-20000, 20000, (n, channels)).astype("<i2")


RECORDINGS = {
    "mono16.wav": (16000, signal(40_000, 1, 1)), "stereo44.wav": (44100, signal(90_001, 2, 2)),
    "three8.wav": (8000, signal(20_003, 3, 3)), "mono48.wav": (48000, signal(100_000, 1, 4)), "tiny11.wav": (11025, signal(1, 1, 5)),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("any")
    for name, (rate, x) in RECORDINGS.items():
        (root / name).write_bytes(wav_file(x.ravel(), rate=rate, channels=x.shape[1], after=b"LIST\x04\0\0\0abcd"))
    (root / "bad.wav").write_bytes(FILES["bad_riff.wav"])
    return str(root)


def mono(name):
    rate, x = RECORDINGS[name]
    return rate, (x.astype(np.float32) / np.float32(32768)).astype(np.float64).sum(axis=1) / x.shape[1]


def at_rate(name, rate):
    own, x = mono(name)
    x = x.astype(np.float32)
    j = np.arange(len(x) * rate // own)
    return x if own == rate else np.interp(j * own / rate, np.arange(len(x)), x)


def by_stream(chunks):
    out = {}
    for r in chunks.orderBy("stream_id", "start_sample").collect():
        got = out.setdefault(os.path.basename(r.stream_id), [])
        assert len(got) == r.start_sample
        got += r.samples
    return out


@pytest.mark.parametrize("rate", [16000, 22050])
def test_chunks_of_any_rate(spark, folder, rate):
    corpus = WavCorpus(spark, folder)
    assert [os.path.basename(r.path) for r in corpus.errors.collect()] == ["bad.wav"]
    chunks = corpus.chunks(rate)
    got = by_stream(chunks)
    assert set(got) == {n for n in RECORDINGS if len(at_rate(n, rate))}
    for name, x in got.items():
        assert np.allclose(x, at_rate(name, rate), atol=2e-6) and len(x) == len(at_rate(name, rate))
    # Whole windows: none lies across two chunks.
    assert chunks.filter(F.col("start_sample") % 512 != 0).count() == 0
    properties = {os.path.basename(r.path): (r.sample_rate, r.channels, r.duration_s) for r in corpus.properties().collect()}
    assert properties == {n: (r, x.shape[1], len(x) / r) for n, (r, x) in RECORDINGS.items()}


def test_equals_resample_series(spark, folder):
    corpus = WavCorpus(spark, folder, "stereo44.wav")
    own = corpus.chunks(44100)
    assert by_stream(framing.resample_series(own, 44100, 16000)) == by_stream(corpus.chunks(16000))


def test_no_samples_are_dealt_out(spark, folder):
    corpus = WavCorpus(spark, folder)
    segments = corpus.headers.select("stream_id", F.lit(0).cast("long").alias("segment_idx"), F.lit(100).cast("long").alias("start_sample"),
                                     F.lit(5000).cast("long").alias("n_samples"))
    for df in (corpus.chunks(), corpus.cut(segments), corpus.cut_pieces(segments)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("MapInPandas")]
        assert "Exchange" not in above and "Sort" not in above


@pytest.mark.parametrize("rate", [16000, 44100])
def test_cut(spark, folder, rate):
    corpus = WavCorpus(spark, folder).renamed(F.regexp_extract("path", r"([^/]*)\.wav$", 1))
    rows = [(n[:-4], i, s, k, "x") for n in RECORDINGS for i, (s, k) in enumerate([(0, 1000), (999, 1), (30_000, 50_000), (10**7, 5), (7, 0)])]
    segments = spark.createDataFrame(rows, "stream_id string, segment_idx bigint, start_sample bigint, n_samples bigint, channels string")
    want = {(n, i): at_rate(n + ".wav", rate)[s : s + k] for n, i, s, k, _ in rows}
    got = corpus.cut(segments, rate).collect()
    assert len(got) == len(rows) and {r.channels for r in got} == {"x"}
    for r in got:
        assert np.allclose(r.samples, want[r.stream_id, r.segment_idx], atol=2e-6)
    pieces = {}
    for r in corpus.cut_pieces(segments, rate, piece=700).orderBy("start_sample").collect():
        assert len(r.samples) <= 700
        pieces.setdefault((r.stream_id, r.segment_idx), []).extend(r.samples)
    assert {k: len(v) for k, v in pieces.items()} == {k: len(v) for k, v in want.items() if len(v)}


@pytest.mark.parametrize("rate", [None, 16000])
def test_export_round_trip(spark, folder, tmp_path, rate, monkeypatch):
    monkeypatch.setattr("voxframe.sources.corpus.EXPORT_SAMPLES", 1000)
    corpus = WavCorpus(spark, folder).renamed(F.regexp_extract("path", r"([^/]*)\.wav$", 1))
    segments = corpus.headers.filter("frames > 1").select(
        "stream_id", F.explode(F.expr("sequence(0L, 2L)")).alias("segment_idx")).withColumns(
        {"start_s": F.col("segment_idx") * 0.4, "duration_s": F.col("segment_idx") * 0.3 + 0.1})
    listed = corpus.export(segments, f"file://{tmp_path}/out", rate).collect()
    assert len(listed) == 12 and {r.rate for r in listed} == ({16000, 44100, 8000, 48000} if rate is None else {16000})
    for r in listed:
        with wave.open(r.path.removeprefix("file://")) as f:
            assert (f.getframerate(), f.getnchannels(), f.getnframes()) == (r.rate, 1, r.n_samples)
            got = np.frombuffer(f.readframes(10**7), "<i2") / 32768
        start, end = int(r.segment_idx * 0.4 * r.rate), int((r.segment_idx * 0.4 + (r.segment_idx * 0.3 + 0.1)) * r.rate)
        assert np.allclose(got, at_rate(r.stream_id + ".wav", r.rate)[start:end], atol=2e-5)
    again = WavCorpus(spark, f"file://{tmp_path}/out")
    durations = sorted((r.sample_rate, round(r.duration_s * r.sample_rate)) for r in again.properties().collect())
    assert durations == sorted((r.rate, r.n_samples) for r in listed)


def test_other_file_systems(spark, folder):
    with pytest.raises(Exception, match="nosuch"):
        WavCorpus(spark, "nosuch://bucket/x")
    with pytest.raises(Exception, match="nosuch"):
        wav.wav_headers_at(spark.createDataFrame([("nosuch://a/b.wav",)], "path string")).collect()
    assert wav.scheme_of("/a/b:c") == "file" and wav.scheme_of("file:/a") == "file" and wav.scheme_of("S3A://b/c") == "s3a"
    # A scheme that only Spark reads: contents come from its reader.
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.voxframe.link./in", f"file://{folder}")
    corpus = WavCorpus(spark, "viewfs://voxframe/in")
    assert corpus.files is not None
    got = by_stream(corpus.chunks(16000, 1024))
    for name, x in got.items():
        assert np.allclose(x, at_rate(name, 16000), atol=2e-6)
    assert set(got) == set(RECORDINGS)
    headers = wav.wav_headers(spark, "viewfs://voxframe/in")
    assert {os.path.basename(r.path) for r in headers.filter("error is null").collect()} == {"mono16.wav"}


def test_data_source(spark, folder):
    spark.dataSource.register(WavChunks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda **o: spark.read.format("wav_chunks").options(**o).load(folder)
    want = by_stream(WavCorpus(spark, folder).chunks(16000, 1024))
    for size in (3001, 1 << 20):
        assert by_stream(read(chunkSamples=1024, rangeBytes=size)) == want
    one = read(chunkSamples=1024, rangeBytes=5000).filter(F.col("stream_id") == f"file://{folder}/mono16.wav")
    assert by_stream(one) == {"mono16.wav": want["mono16.wav"]} and one.rdd.getNumPartitions() == -(-os.path.getsize(f"{folder}/mono16.wav") // 5000)
    assert read().filter(F.col("stream_id").isin("a", "b")).count() == 0
    with pytest.raises(Exception, match="RIFF"):
        read(onError="fail").count()
    with pytest.raises(Exception, match="nosuch"):
        spark.read.format("wav_chunks").load("nosuch://x").count()


def test_reader_plans_ranges(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = WavChunksReader({"path": folder, "rangeBytes": "30000"})
    assert sum(p.end - p.start for p in reader.partitions()) == sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))
    more = GreaterThan(("start_sample",), 5)
    paths = [p for p, _ in reader.files()]
    assert list(reader.pushFilters([EqualTo(("stream_id",), paths[0]), more, In(("stream_id",), tuple(paths))])) == [more]
    assert {p.path for p in reader.partitions()} == {paths[0]}
