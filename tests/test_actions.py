"""End to end on generated recordings: loud bursts between silences."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_fold import fold
from tests.test_segmentation import windows
from voxframe.functions.signal import rms
from voxframe.operators import events, recognize
from voxframe.operators.fold import SegmentFold, SegmentOptions
from voxframe.operators.segmentation import segment_activity_with_scorer
from voxframe.plans import actions
from voxframe.sources import jsonl, wav
from voxframe.sources.corpus import WavCorpus

OPTIONS = SegmentOptions(min_speech_s=0.064, soft_limit_s=0.5, hard_limit_s=1.0, min_silence_ms=96, look_back_s=0.064)
FLAGS = "...SSSSS" + "." * 12 + "S" * 40 + "." * 8 + "SS"


def recording(flags, size=512):
    t = np.arange(size * len(flags))
    loud = np.repeat([1.0 if c == "S" else 0.0 for c in flags], size)
    return (0.5 * loud * np.sign(np.sin(t / 5.0) + 1e-9)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rec")
    for name, flags in (("one", FLAGS), ("two", "SSSS" + FLAGS)):
        (folder / f"{name}.wav").write_bytes(wav.wav_bytes(np.append(recording(flags), [0.3] * 100), 16000))
    return str(folder)


def chunks_of(spark, corpus):
    chunks = wav.decode_pcm(wav.wav_headers(spark, corpus), chunk_samples=1000, range_bytes=20000)
    return chunks.withColumn("stream_id", events.base_name(F.col("stream_id")))


def recognizer():
    def fn(samples, prompt):
        return [{"text": f"{len(samples)} samples", "t0": 0.0, "t1": None}]
    return fn


def test_transcribe(spark, corpus):
    log = actions.transcribe(chunks_of(spark, corpus), rms(F.col("samples")), recognizer, OPTIONS, 0.1)
    rows = log.orderBy(*events.SORT_KEYS).collect()
    for name, flags in (("one", FLAGS), ("two", "SSSS" + FLAGS)):
        segs = fold(flags, OPTIONS)
        own = [r for r in rows if r.stream_id == name]
        assert [r.type for r in own] == ["stream_start"] + ["segment_start", "transcript", "segment_end"] * len(segs) + ["stream_end"]
        assert [r.text for r in own if r.type == "transcript"] == [f"{n} samples" for _, n, *_ in segs]
        assert [r.timestamp_ms for r in own if r.type == "segment_start"] == [round(max(0, s - sh) / 16) for s, n, sh, _ in segs]
    lines = [json.loads(r.value) for r in events.json_lines(log).collect()]
    assert len(lines) == len(rows)


def test_split(spark, corpus):
    out = actions.split(chunks_of(spark, corpus), rms(F.col("samples")), OPTIONS, 0.1).filter("stream_id = 'one'")
    got = {r.segment_idx: r for r in out.collect()}
    pcm = np.rint(recording(FLAGS) * 32768).astype("<i2")
    for i, (s, n, sh, _) in enumerate(fold(FLAGS, OPTIONS)):
        assert bytes(got[i].wav)[44:] == pcm[s:s + n].tobytes()
        assert got[i].name.startswith(f"segment_{i:04d}_{int((s - sh) / 16)}ms_")


def test_split_keeps_rate(spark, corpus):
    same = {(r.stream_id, r.segment_idx) for r in actions.split(chunks_of(spark, corpus), rms(F.col("samples")), OPTIONS, 0.1).collect()}
    up = np.repeat(recording(FLAGS), 3)
    rows = [("one", i, i * 4800, up[i * 4800:(i + 1) * 4800].tolist()) for i in range(-(-len(up) // 4800))]
    chunks = spark.createDataFrame(rows, "stream_id string, chunk_seq bigint, start_sample bigint, samples array<float>")
    out = actions.split(chunks, rms(F.col("samples")), OPTIONS, 0.1, rate=48000).collect()
    assert len(out) == len([k for k in same if k[0] == "one"])
    for r in out:
        import io
        import wave
        with wave.open(io.BytesIO(bytes(r.wav))) as f:
            assert f.getframerate() == 48000
            assert f.getnframes() / 48000 == pytest.approx(r.duration_s, abs=1e-4)


class Counting:
    """Scores a window by how many windows it has seen since the last reset."""

    def __init__(self):
        self.seen = 0

    def reset(self):
        self.seen = 0

    def score(self, samples):
        self.seen += 1
        return float(samples[0]) * (1.0 if self.seen % 9 else 0.0)


def test_scorer_in_fold(spark):
    flags = FLAGS * 2
    df = windows(spark, {"a": flags, "b": FLAGS}).withColumn(
        "samples", F.array_repeat(F.col("is_speech").cast("float"), 4))
    got = {}
    for r in segment_activity_with_scorer(df, Counting, OPTIONS).orderBy("stream_id", "segment_idx").collect():
        got.setdefault(r.stream_id, []).append((r.start_sample, r.n_samples))
    for name, f in (("a", flags), ("b", FLAGS)):
        model, machine, want = Counting(), SegmentFold(OPTIONS), []
        for i, c in enumerate(f):
            machine.feed(i, 1, model.score([1.0 if c == "S" else 0.0]) > 0.5)
            if machine.out:
                want += [s[:2] for s in machine.out]
                machine.out.clear()
                model.reset()
        machine.finish()
        assert got[name] == want + [s[:2] for s in machine.out]


# --- manifests ------------------------------------------------------------------------------

JOBS = ("job_id string, source string, duration_s double, backend string, language string, model string, condition boolean, "
        "sub_timestamps boolean, device string, script string")


def talker(job):
    """Says the family and the length, and whether there was a prompt."""
    def fn(samples, prompt):
        said = "with" if prompt else "no"
        # A repeated length repeats the text, which is an echo for the families that take prompts.
        text = f"{job['backend']} {job['language_param']} {len(samples) % 7} {said}"
        if job["backend"] == "moonshine":
            text = "好 好 a 好"
        return [{"text": text, "t0": 0.0, "t1": None}]
    return fn


def test_transcribe_jobs(spark, tmp_path):
    """One pass over jobs of different limits, against the fold and the recognizer by hand."""
    rng = np.random.default_rng(2)
    flags = {name: "".join(c * n for c, n in zip("S." * 14, rng.integers(40, 420, 28))) for name in ("x", "y")}
    for (name, f), rate in zip(flags.items(), (16000, 48000)):
        loud = np.repeat([0.5 if c == "S" else 0.0 for c in f], 512 * rate // 16000).astype(np.float32)
        (tmp_path / f"{name}.wav").write_bytes(wav.wav_bytes(loud, rate))
    corpus = WavCorpus(spark, str(tmp_path)).renamed(events.base_name(F.col("path")))
    rows = [
        ("a", "x", 1.0, "whisper", "en", None, None, None, None, None), ("b", "x", 1.0, "moonshine", "zh", None, None, True, None, "traditional"),
        ("c", "y", 1.0, "nvidia-whisper", None, None, False, None, None, None), ("d", "y", 1.0, "qwen-asr-rs", "en", None, None, None, None, None),
        ("e", "y", 1.0, "whisper", "en", None, False, False, None, None), ("f", "y", None, "whisper", "en", None, None, None, None, None),
        ("g", "x", 1.0, "moonshine", "fr", None, None, None, None, None), ("h", "x", 1.0, "qwen-asr-rs", "xx", None, None, None, None, None),
        ("i", "gone", 1.0, "whisper", "en", None, None, None, None, None),
    ]
    scored, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def scorer(batch):
        scored.add(len(batch))
        return np.sqrt((batch.astype("f8") ** 2).mean(axis=1))

    def recognizer(job):
        fn = talker(job)

        def counted(samples, prompt):
            asked.add(1)
            return fn(samples, prompt)
        return counted

    log, rejected = actions.transcribe_jobs(
        spark.createDataFrame(rows, JOBS), corpus, scorer, recognizer, 0.1, scripts={"traditional": ("好", "號")})
    assert {r.job_id for r in rejected.collect()} == {"f", "g", "h"}
    got = {}
    for r in log.orderBy(*events.SORT_KEYS).collect():
        got.setdefault(r.stream_id, []).append(r)
    assert set(got) == set("abcdei")
    limits = {"a": (60, 6.0), "b": (9, 6.0), "c": (30, 6.0), "d": (60, 30.0), "e": (30, 6.0)}
    calls = 0
    for job in "abcdei":
        own = got[job]
        assert (own[0].type, own[-1].type) == ("stream_start", "stream_end")
        if job == "i":
            assert len(own) == 2
            continue
        source, _, backend, language = rows["abcdefghi".index(job)][1:5]
        segs = fold(flags[source], SegmentOptions(hard_limit_s=limits[job][0], soft_limit_s=limits[job][1]))
        assert len(segs) > 3
        starts = [r.timestamp_ms for r in own if r.type == "segment_start"]
        assert starts == [round(max(0, s - sh) / 16) for s, n, sh, _ in segs]
        memory, conditioned = recognize.Conversation(), job in "ad"
        fn = talker({"backend": backend, "language_param": {"c": "multi", "d": "English"}.get(job, language)})
        want = []
        for _, n, *_ in segs:
            if not conditioned:
                memory = recognize.Conversation()
            (chunk, retried), = recognize.recognize_one(fn, np.zeros(n), memory, job == "a", None, conditioned)
            calls += 1 + retried
            want.append((chunk["text"] if job != "b" else "號號 a 號", retried))
        assert [(r.text, r.prompt_retry) for r in own if r.type == "transcript"] == want
    assert scored.value == sum(map(len, flags.values()))
    path = str(tmp_path / "log")
    jsonl.write_jsonl(log, path)
    # Writing the log reads the transcripts, it does not recognize again; only retries are second calls.
    assert asked.value == calls
    assert len(spark.read.text(path).collect()) == log.count()


def test_split_corpus(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    for name, rate in (("one", 16000), ("two", 48000), ("three", 8000)):
        x = recording(FLAGS)
        x = np.repeat(x, rate // 16000) if rate >= 16000 else x[::2]
        (folder / f"{name}.wav").write_bytes(wav.wav_bytes(x, rate))
    corpus = WavCorpus(spark, str(folder)).renamed(events.base_name(F.col("path")))
    segs = fold(FLAGS, OPTIONS)
    for rate in (16000, None):
        got = actions.split_corpus(corpus, out + str(rate), rms(F.col("samples")), OPTIONS, 0.1, rate).collect()
        one = sorted((r for r in got if r.stream_id == "one"), key=lambda r: r.segment_idx)
        assert [r.n_samples for r in one] == [int((max(0, s - sh) + n) / 16000 * 16000) - max(0, s - sh) for s, n, sh, _ in segs]
        assert {r.stream_id: r.rate for r in got} == ({"one": 16000, "two": 48000, "three": 8000} if rate is None else dict.fromkeys(("one", "two", "three"), 16000))
        for r in got:
            import wave
            with wave.open(r.path.removeprefix("file://")) as f:
                assert (f.getframerate(), f.getnframes()) == (r.rate, r.n_samples)


def test_jobs_share_segments_and_cuts(spark, monkeypatch):
    """Jobs with one source and the same limits are segmented and cut once, and each gets its own log."""
    asked, packed = [], []
    whole, pack = actions.cut.cut_segments, actions.segmentation._pack

    def cut_segments(segments, *args, **named):
        asked.append(segments.count())
        return whole(segments, *args, **named)

    def pack_windows(windows, *args):
        packed.append(windows.count())
        return pack(windows, *args)

    monkeypatch.setattr(actions.cut, "cut_segments", cut_segments)
    monkeypatch.setattr(actions.segmentation, "_pack", pack_windows)
    flags = ("S" * 60 + "." * 60) * 3
    chunks = spark.createDataFrame(
        [("x", i * 512, [0.9 if c == "S" else 0.0] * 512) for i, c in enumerate(flags)], "stream_id string, start_sample bigint, samples array<float>")
    rows = [(name, "x", 1.0, backend, "en", None, None, None, None, None) for name, backend in
            (("a", "whisper"), ("b", "whisper"), ("c", "whisper"), ("d", "qwen-asr-rs"))]
    log, _ = actions.transcribe_jobs(
        spark.createDataFrame(rows, JOBS), actions.ChunkTable(chunks, aligned=True), lambda x: np.abs(x).max(axis=1), talker, epoch_ms=F.lit(0))
    starts = {}
    for r in log.filter("type = 'segment_start'").collect():
        starts.setdefault(r.stream_id, set()).add((r.segment_idx, r.timestamp_ms))
    assert packed == [len(flags)] and sorted(starts) == list("abcd")
    assert starts["a"] == starts["b"] == starts["c"] and 3 <= asked[0] <= len(starts["a"]) + len(starts["d"])
