import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.signal import rms
from voxframe.operators import cut, framing
from voxframe.sources import tables

SCHEMA = "stream_id string, chunk_seq bigint, start_sample bigint, samples array<float>"


def chunks_of(spark, streams, rnd, longest=40):
    rows = []
    for name, values in streams.items():
        at = seq = 0
        while at < len(values):
            n = rnd.randint(1, longest)
            rows.append((name, seq, at, values[at:at + n]))
            at, seq = at + n, seq + 1
    return spark.createDataFrame(rows, SCHEMA)


def ramp(n, base=0):
    return [float(base + i) for i in range(n)]


def test_frames_cross_chunks(spark):
    rnd = random.Random(1)
    streams = {"a": ramp(503), "b": ramp(15), "c": ramp(160, 1000)}
    df = chunks_of(spark, streams, rnd)
    got = {}
    for r in framing.frame(df, 16).orderBy("stream_id", "window_idx").collect():
        assert r.start_sample == r.window_idx * 16 and r.ts == r.window_idx * 16 / 16000
        got.setdefault(r.stream_id, []).append(r.samples)
    for k, v in streams.items():
        assert got.get(k, []) == [v[i:i + 16] for i in range(0, len(v) - 15, 16)]
    lost = {r.stream_id: r.dropped_samples for r in framing.dropped_samples(df, 16).collect()}
    assert lost == {"a": 7, "b": 15, "c": 0}


def test_samples_at_a_gap_are_counted(spark):
    df = spark.createDataFrame([("a", 0, 0, ramp(20)), ("a", 1, 25, ramp(20)), ("b", 0, 3, ramp(0)), ("c", 0, 16, ramp(32))], SCHEMA)
    assert framing.frame(df, 16).count() == 3
    lost = {r.stream_id: r.dropped_samples for r in framing.dropped_samples(df, 16).collect()}
    assert lost == {"a": 24, "b": 0, "c": 0}


def test_offsets(spark):
    df = chunks_of(spark, {"a": ramp(300), "b": ramp(70)}, random.Random(2))
    got = framing.with_offsets(df.drop("start_sample")).select("stream_id", "chunk_seq", "start_sample")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.select("stream_id", "chunk_seq", "start_sample").collect()))


def test_scoring(spark):
    df = framing.frame(chunks_of(spark, {"a": ramp(64)}, random.Random(3)), 16)
    by_column = framing.score_windows(df, rms(F.col("samples")), 16).orderBy("window_idx").collect()
    by_batch = framing.score_windows(df, lambda m: np.sqrt((m.astype("f8") ** 2).mean(axis=1)), 16).orderBy("window_idx").collect()
    assert [r.speech_prob for r in by_column] == pytest.approx([r.speech_prob for r in by_batch])
    with pytest.raises(Exception, match="window length"):
        framing.score_windows(df, rms(F.col("samples")), 17).collect()


@pytest.mark.parametrize("rates", [(48000, 16000), (44100, 16000), (8000, 11025), (16000, 16000)])
def test_resample(spark, rates):
    rnd = random.Random(sum(rates))
    streams = {"a": [rnd.random() for _ in range(441)], "b": [rnd.random() for _ in range(5)]}
    out = tables.samples_by_value(framing.resample_series(chunks_of(spark, streams, rnd, 9), *rates))
    got = {}
    for r in out.orderBy("stream_id", "sample_idx").collect():
        got.setdefault(r.stream_id, []).append((r.sample_idx, r.value))
    for k, v in streams.items():
        m = int(len(v) * rates[1] / rates[0])
        want = np.interp(np.arange(m) * rates[0] / rates[1], np.arange(len(v)), np.asarray(v, dtype=np.float32))
        assert [g[0] for g in got.get(k, [])] == list(range(m))
        assert [g[1] for g in got.get(k, [])] == pytest.approx(want.tolist(), abs=1e-6)


def test_resample_lengths(spark):
    for n, rate in ((4800, 48000), (4410, 44100)):
        df = chunks_of(spark, {"a": ramp(n)}, random.Random(n), 1000)
        assert tables.samples_by_value(framing.resample_series(df, rate, 16000)).count() == 1600


def test_progress(spark):
    rows = [("a", i, i * 30, ramp(30)) for i in range(10)]
    got = framing.progress(spark.createDataFrame(rows, SCHEMA), every=4, size=16).orderBy("chunks_read").collect()
    assert [(r.chunks_read, r.clock_s) for r in got] == [(4, 112 / 16000), (8, 240 / 16000)]


@pytest.mark.parametrize("bucket", [7, 64, 1 << 18])
def test_cut(spark, bucket):
    rnd = random.Random(bucket)
    streams = {"a": ramp(500), "b": ramp(90, 5000)}
    chunks = chunks_of(spark, streams, rnd)
    segs, at = [], 0
    for i in range(12):
        at += rnd.randint(0, 20)
        n = rnd.randint(1, 60)
        segs.append(("a", i, at, n))
        at += n
    segs.append(("b", 0, 80, 50))
    df = spark.createDataFrame(segs, "stream_id string, segment_idx bigint, start_sample bigint, n_samples bigint")
    got = {(r.stream_id, r.segment_idx): (r.start_sample, r.samples) for r in cut.cut_segments(df, chunks, bucket).collect()}
    want = {(s, i): (at, streams[s][at:at + n]) for s, i, at, n in segs if streams[s][at:at + n]}
    assert got == want


def test_cut_at_rate(spark):
    chunks = chunks_of(spark, {"a": ramp(1000)}, random.Random(8))
    segs = spark.createDataFrame([("a", 0, 0.0101, 0.0205), ("a", 1, 0.09, 0.5)],
                                 "stream_id string, segment_idx bigint, start_s double, duration_s double")
    got = {r.segment_idx: (r.start_sample, r.samples) for r in cut.cut_segments_at_rate(segs, chunks, 8000, 50).collect()}
    assert got == {0: (80, ramp(1000)[80:int((0.0101 + 0.0205) * 8000)]), 1: (720, ramp(1000)[720:1000])}


def test_read_values(spark):
    rows = [("a", t, float(t)) for t in range(37)] + [("b", t, float(-t)) for t in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(5)
    got = {(r.stream_id, r.chunk_seq): (r.start_sample, r.samples) for r in tables.read_values(df, "k", "v", ["t"], 10).collect()}
    assert got[("a", 3)] == (30, ramp(7, 30)) and got[("a", 0)] == (0, ramp(10)) and got[("b", 0)][1] == [0.0, -1.0, -2.0, -3.0]
    assert len(got) == 5
