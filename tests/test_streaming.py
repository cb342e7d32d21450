"""Batch input replayed in several files must give the batch result."""

import glob
import json
import random

from pyspark.sql import functions as F

from tests.test_fold import fold, random_case
from tests.test_segmentation import windows
from voxframe.operators import scan
from voxframe.operators.fold import SegmentOptions
from voxframe.operators.recognize import Conversation
from voxframe.streaming import processors, sink

SCHEMA = "stream_id string, window_idx bigint, is_speech boolean, is_end boolean"


def replay(spark, tmp_path, batches, schema, build, name, available_now=True):
    """Write each batch as one file and run the query to the end of the input."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/f{i:03d}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(source)
    )
    q = (
        build(stream).writeStream.outputMode("append").format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    return spark.sql(f"select * from {name}").collect()


def test_segments_equal_batch(spark, tmp_path):
    rnd = random.Random(21)
    o = SegmentOptions(min_speech_s=0.064, soft_limit_s=0.3, hard_limit_s=0.7, min_silence_ms=64, look_back_s=0.1)
    streams = {f"s{k}": random_case(rnd)[0][:200] for k in range(3)}
    parts = [[], [], []]
    for name, flags in streams.items():
        order = list(range(len(flags)))
        for i in range(0, len(order) - 8, 8):
            mixed = order[i:i + 8]
            rnd.shuffle(mixed)
            order[i:i + 8] = mixed
        for n, i in enumerate(order):
            parts[min(2, n * 3 // len(order))].append((name, i, flags[i] == "S", False))
        parts[2].append((name, None, None, True))
    got = {}
    for r in replay(spark, tmp_path, parts, SCHEMA, lambda d: processors.segment_activity_stream(d, o), "seg1"):
        got.setdefault(r.stream_id, []).append((r.segment_idx, r.start_sample, r.n_samples, r.end_reason))
        assert r.late_windows == 0
    for name, flags in streams.items():
        assert sorted(got[name]) == [(i, s, n, why) for i, (s, n, _, why) in enumerate(fold(flags, o))]


def test_late_and_gap(spark, tmp_path):
    o = SegmentOptions(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3.0, min_silence_ms=64, look_back_s=0)
    first = [("a", i, True, False) for i in range(4)]
    second = [("a", 1, True, False)] + [("a", i, True, False) for i in range(20, 24)]
    end = [("a", None, None, True)]
    rows = replay(spark, tmp_path, [first, second, end], SCHEMA,
                  lambda d: processors.segment_activity_stream(d, o, reorder=4), "seg2")
    flags = "SSSS" + "." * 16 + "SSSS"
    assert sorted((r.start_sample, r.n_samples) for r in rows) == [s[:2] for s in fold(flags, o)]
    assert max(r.late_windows for r in rows) == 1


def test_far_windows_wait_and_resumed_streams_number_on(spark, tmp_path):
    o = SegmentOptions(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3.0, min_silence_ms=64, look_back_s=0)
    flags = ("SSSS" + "." * 6) * 60
    rows = [("a", i, c == "S", False) for i, c in enumerate(flags)]
    # Windows 300 and more ahead of a missing one are kept, not passed over.
    batches = [rows[1:], rows[:1] + [("a", None, None, True)], [("a", len(flags) + i, True, False) for i in range(4)] + [("a", None, None, True)]]
    got = replay(spark, tmp_path, batches, SCHEMA, lambda d: processors.segment_activity_stream(d, o), "seg3")
    want = [s[:2] for s in fold(flags, o)]
    assert sorted((r.segment_idx, r.start_sample, r.n_samples) for r in got) == [
        *((i, *s) for i, s in enumerate(want)), (len(want), len(flags) * 512, 4 * 512)]
    assert max(r.late_windows for r in got) == 0


def test_frames(spark, tmp_path):
    rnd = random.Random(3)
    chunks, at = [], 0
    for seq in range(12):
        n = rnd.randint(1, 20)
        chunks.append(("a", seq, [float(at + i) for i in range(n)]))
        at += n
    chunks[4], chunks[5] = chunks[5], chunks[4]
    rows = replay(spark, tmp_path, [chunks[:5], chunks[5:9], chunks[9:]],
                  "stream_id string, chunk_seq bigint, samples array<float>",
                  lambda d: processors.frame_stream(d, 16), "frames1")
    got = {r.window_idx: r.samples for r in rows}
    assert got == {w: [float(w * 16 + i) for i in range(16)] for w in range(at // 16)}


def test_retry_plans_equal_batch(spark, tmp_path):
    rnd = random.Random(6)
    words = ["hello there", "Hello there", "go go go go", "well", "hello therr"]
    segments = [(s, i, [rnd.choice(words) for _ in range(rnd.randint(1, 3))]) for i in range(12) for s in "ab"]
    schema = "stream_id string, segment_idx bigint, chunks array<struct<text string, t0 double, t1 double>>"
    data = [(s, i, [(t, float(k), k + 1.0) for k, t in enumerate(texts)]) for s, i, texts in segments]
    rows = replay(spark, tmp_path, [data[:8], data[8:14], data[14:]], schema, processors.plan_retries_stream, "plans1")
    chunks = spark.createDataFrame(
        [(s, i, k, t, float(k), k + 1.0) for s, i, texts in segments for k, t in enumerate(texts)],
        "stream_id string, segment_idx bigint, chunk_idx int, text string, t0 double, t1 double")
    batch = scan.plan_retries_chunks(chunks, scan.prior_state(scan.segment_line(chunks)))
    want = sorted((r.stream_id, r.segment_idx, r.repeat_idx, r.trim_start_samples) for r in batch.collect())
    assert want and sorted((r.stream_id, r.segment_idx, r.repeat_idx, r.trim_start_samples) for r in rows) == want
    assert Conversation().prompt == ""


def test_sink_and_listener(spark, tmp_path):
    o = SegmentOptions(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3.0, min_silence_ms=64, look_back_s=0)
    flags = "SSS....SS"
    rows = [("a", i, c == "S", False) for i, c in enumerate(flags)] + [("a", None, None, True)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    listener = sink.ProgressListener()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    out = str(tmp_path / "log")
    q = sink.write_log_stream(
        processors.segment_activity_stream(stream, o), out, str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.streams.removeListener(listener)
    lines = [json.loads(x) for p in sorted(glob.glob(out + "/batch=*/part-*")) for x in open(p)]
    segs = fold(flags, o)
    assert sorted(r["timestamp_ms"] for r in lines) == sorted(
        t for s, n, *_ in segs for t in (round(s / 16), round((s + n) / 16)))
    assert {r["type"] for r in lines} == {"segment_start", "segment_end"}
    assert len(windows(spark, {"a": flags}).filter(F.col("is_speech")).collect()) == 5


def test_idle_stream_is_closed_by_timer(spark, tmp_path):
    import time
    o = SegmentOptions(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3.0, min_silence_ms=640, look_back_s=0)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", i, True, False) for i in range(5)], SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = (
        processors.segment_activity_stream(stream, o, idle_timeout_ms=1500).writeStream.outputMode("append")
        .format("memory").queryName("idle1").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(processingTime="1 second").start()
    )
    rows, deadline = [], time.time() + 60
    while not rows and time.time() < deadline:
        time.sleep(1)
        rows = spark.sql("select * from idle1").collect()
    q.stop()
    assert [(r.start_sample, r.n_samples, r.end_reason) for r in rows] == [(0, 5 * 512, "flush")]


# --- waiting rows, timers, order over micro-batches ---------------------------------------------

PLAIN = dict(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3.0, min_silence_ms=64, look_back_s=0)


def test_late_windows_are_rows(spark, tmp_path):
    o = SegmentOptions(**PLAIN)
    flags = "SSSS..SSS" + "." * 6 + "SS"
    rows = [("a", i, c == "S", False) for i, c in enumerate(flags)]
    batches = [rows, [rows[2], rows[5]], [("b", 0, True, False), ("a", None, None, True), ("b", None, None, True)], [rows[1]]]
    got = replay(spark, tmp_path, batches, SCHEMA, lambda d: processors.segment_activity_stream(d, o, late_rows=True), "late1")
    late = sorted((r.stream_id, r.late_window_idx) for r in got if r.segment_idx is None)
    assert late == [("a", 1), ("a", 2), ("a", 5)]
    assert sorted((r.start_sample, r.n_samples) for r in got if r.stream_id == "a" and r.segment_idx is not None) == [s[:2] for s in fold(flags, o)]


def test_windows_in_any_order_over_blocks(spark, tmp_path):
    """Windows in reverse order wait as bits: everything comes out when the first one has come."""
    rnd = random.Random(5)
    o = SegmentOptions(min_speech_s=0.064, soft_limit_s=0.3, hard_limit_s=0.7, min_silence_ms=64, look_back_s=0.1)
    flags = "".join(rnd.choice("S.") * rnd.randint(1, 9) for _ in range(700))
    rows = [("a", i, c == "S", False) for i, c in enumerate(flags)][::-1]
    cut = len(rows) // 3
    batches = [rows[:cut], rows[cut:-5], [*rows[-5:], ("a", None, None, True)]]
    got = replay(spark, tmp_path, batches, SCHEMA, lambda d: processors.segment_activity_stream(d, o), "any1")
    assert len(flags) > 3 * processors.WAITING_BLOCK
    assert sorted((r.start_sample, r.n_samples) for r in got) == [s[:2] for s in fold(flags, o)]


def run_until(spark, build, source, schema, tmp_path, name, done, files=1):
    import time

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(source)
    q = (build(stream).writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    deadline = time.time() + 90
    rows = []
    while not done(rows) and time.time() < deadline:
        time.sleep(1)
        rows = spark.sql(f"select * from {name}").collect()
    q.stop()
    return rows


def test_hole_timer_passes_a_missing_window(spark, tmp_path):
    o = SegmentOptions(**PLAIN)
    source = str(tmp_path / "in")
    flags = "SSSSS.....SSSS" + "." * 8
    rows = [("a", i, c == "S", False) for i, c in enumerate(flags) if i != 7]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    got = run_until(spark, lambda d: processors.segment_activity_stream(d, o, hole_timeout_ms=1500), source, SCHEMA, tmp_path, "hole1",
                    lambda r: len(r) >= 2)
    assert sorted((r.start_sample, r.n_samples) for r in got) == [s[:2] for s in fold(flags, o, finish=False)]


CHUNKS = "stream_id string, chunk_seq bigint, start_sample bigint, samples array<float>"


def state_rows(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).collect()


def test_missing_chunk_keeps_state_small(spark, tmp_path):
    chunks = [("a", i, i * 10, [float(i * 10 + k) for k in range(10)]) for i in range(60) if i != 3]
    batches = [chunks[i : i + 10] for i in range(0, len(chunks), 10)]
    got = replay(spark, tmp_path, batches, CHUNKS, lambda d: processors.frame_stream(d, 16, max_waiting=4), "miss1")
    # Sample 30 to 39 are missing: windows 1 and 2 touch them, all others are whole.
    assert {r.window_idx: r.samples for r in got} == {
        w: [float(w * 16 + k) for k in range(16)] for w in range(600 // 16) if w not in (1, 2)}
    assert len(state_rows(spark, tmp_path, "waiting")) == 0
    head, = state_rows(spark, tmp_path, "head")
    assert len(head.value.rest) < 16 * 4


def test_chunks_wait_within_the_bound(spark, tmp_path):
    rnd = random.Random(8)
    chunks = [("a", i, i * 7, [float(i * 7 + k) for k in range(7)]) for i in range(40)]
    mixed = [c for i in range(0, 40, 5) for c in rnd.sample(chunks[i : i + 5], 5)]
    batches = [mixed[i : i + 9] for i in range(0, 40, 9)]
    got = replay(spark, tmp_path, batches, CHUNKS, lambda d: processors.frame_stream(d, 16, max_waiting=8), "wait1")
    assert {r.window_idx: r.samples for r in got} == {w: [float(w * 16 + k) for k in range(16)] for w in range(280 // 16)}


PLAN_SCHEMA = "stream_id string, segment_idx bigint, chunks array<struct<text string, t0 double, t1 double>>, is_end boolean"


def test_retry_plans_of_shuffled_segments(spark, tmp_path):
    rnd = random.Random(16)
    words = ["hello there", "Hello there", "go go go go", "well", "hello therr"]
    segments = [(s, i, [rnd.choice(words) for _ in range(rnd.randint(1, 3))]) for i in range(14) for s in "ab"]
    data = [(s, i, [(t, float(k), k + 1.0) for k, t in enumerate(texts)], False) for s, i, texts in segments]
    rnd.shuffle(data)
    # Segment 14 never comes: the one behind it goes when the stream ends.
    data = data[:10] + [("a", 15, [("well", 0.0, 1.0)], False)] + data[10:] + [("a", None, None, True)]
    rows = replay(spark, tmp_path, [data[:9], data[9:20], data[20:-1], data[-1:]], PLAN_SCHEMA, processors.plan_retries_stream, "plans2")
    chunks = spark.createDataFrame(
        [(s, i, k, t, float(k), k + 1.0) for s, i, texts in [*segments, ("a", 15, ["well"])] for k, t in enumerate(texts)],
        "stream_id string, segment_idx bigint, chunk_idx int, text string, t0 double, t1 double")
    batch = scan.plan_retries_chunks(chunks, scan.prior_state(scan.segment_line(chunks)))
    key = lambda r: (r.stream_id, r.segment_idx, r.repeat_idx, r.trim_start_samples)
    want = sorted(map(key, batch.collect()))
    assert want and sorted(map(key, rows)) == want


def talker():
    def fn(samples, prompt):
        n = len(samples)
        return [] if n % 5 == 0 else [{"text": f"{n % 4} said {bool(prompt)}", "t0": 0.0, "t1": None}] * (1 + n % 2)
    return fn


SPOKEN = "stream_id string, segment_idx bigint, start_s double, samples array<float>"


def spoken(rnd, n=12):
    return [(s, i, i * 1.5, [0.1] * rnd.randint(1, 12)) for s in "ab" for i in range(n)]


def test_transcripts_equal_batch(spark, tmp_path):
    from voxframe.operators import recognize

    rows = spoken(random.Random(3))
    batch = recognize.transcribe_segments(spark.createDataFrame(rows, SPOKEN), talker)
    mixed = random.Random(4).sample(rows, len(rows))
    got = replay(spark, tmp_path, [mixed[:9], mixed[9:15], mixed[15:]], SPOKEN, lambda d: processors.transcribe_stream(d, talker), "talk1")
    names = ["stream_id", "segment_idx", "chunk_idx", "text", "start_s", "end_s", "prompt_retry"]
    assert sorted(tuple(r[c] for c in names) for r in got if r.chunks) == sorted(tuple(r[c] for c in names) for r in batch.collect())
    assert {(r.stream_id, r.segment_idx) for r in got} == {r[:2] for r in rows}


RECORDS = ("stream_id string, kind string, segment_idx bigint, start_s double, end_s double, chunk_idx int, text string, "
           "prompt_retry boolean, chunks int")


def test_merged_log_equals_batch_after_a_restart(spark, tmp_path):
    from voxframe.operators import events

    rnd = random.Random(9)
    segments, transcripts, ends = [], [], []
    for s in "abc":
        n = rnd.randint(4, 9)
        for i in range(n):
            segments.append((s, i, i * 2.0, 1.5))
            transcripts += [(s, i, k, f"text {i} {k}", i * 2.0 + k, None if k else i * 2.0 + 1, k == 1) for k in range(rnd.choice((0, 1, 3)))]
        ends.append((s, n))
    counts = {}
    for t in transcripts:
        counts[t[:2]] = counts.get(t[:2], 0) + 1
    parts = [(s, "segment", i, a, a + d, None, None, None, None) for s, i, a, d in segments]
    parts += [(s, "transcripts", i, a, b, k, text, retry, counts[s, i]) for s, i, k, text, a, b, retry in transcripts]
    parts += [(s, "transcripts", i, None, None, None, None, None, 0) for s, i, *_ in segments if (s, i) not in counts]
    parts += [(s, "end", n, None, None, None, None, None, None) for s, n in ends]
    rnd.shuffle(parts)
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp")
    epoch = F.lit(1_700_000_000_000)

    def run():
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        sink.write_merged_log(processors.merge_log_stream(stream), out, cp, epoch_ms=epoch).trigger(availableNow=True).start().awaitTermination(240)

    cut = len(parts) // 3
    for n, some in enumerate((parts[:cut], parts[cut : 2 * cut], parts[2 * cut :])):
        spark.createDataFrame(some, RECORDS).coalesce(1).write.parquet(f"{source}/f{n}")
        # Every part in a query of its own, from the checkpoint of the one before.
        run()
    log = events.event_log(
        spark.createDataFrame([(s,) for s, _ in ends], "stream_id string"),
        spark.createDataFrame(segments, "stream_id string, segment_idx bigint, start_s double, duration_s double"),
        spark.createDataFrame(transcripts, "stream_id string, segment_idx bigint, chunk_idx int, text string, start_s double, end_s double, prompt_retry boolean"),
        epoch_ms=epoch)
    want = {}
    for r in events.json_lines(log).orderBy(*events.SORT_KEYS).collect():
        want.setdefault(r.stream_id, []).append(r.value)
    lines = [x.rstrip("\n") for p in sorted(glob.glob(out + "/batch=*/part-*")) for x in open(p)]
    assert sorted(lines) == sorted(x for own in want.values() for x in own)
    # In order within a stream: texts and times tell the streams' records apart only together, so compare the ordered kinds.
    for s, own in want.items():
        ids = {json.loads(x)["id"]: i for i, x in enumerate(own) if "id" in json.loads(x)}
        at = [ids[json.loads(x)["id"]] for x in lines if json.loads(x).get("id") in ids]
        assert at == sorted(at) and len(at) == len(ids)
    assert processors.log_input(
        spark.createDataFrame(segments, "stream_id string, segment_idx bigint, start_s double, duration_s double"),
        ends=spark.createDataFrame(ends, "stream_id string, segments int")).count() == len(segments) + 3


def test_live_state_and_clock_of_open_streams(spark, tmp_path):
    from voxframe.operators.segmentation import live_state

    rnd = random.Random(13)
    o = SegmentOptions(min_speech_s=0.064, soft_limit_s=0.3, hard_limit_s=0.7, min_silence_ms=64, look_back_s=0.1)
    flags = {f"s{k}": random_case(rnd)[0][: 60 + k] for k in range(4)}
    rows = [(s, i, c == "S", False) for s, f in flags.items() for i, c in enumerate(f)]
    listener = sink.ProgressListener()
    spark.streams.addListener(listener)
    replay(spark, tmp_path, [rows[:100], rows[100:]], SCHEMA,
           lambda d: processors.segment_activity_stream(sink.with_progress(d), o), "live1")
    import time
    deadline = time.time() + 30
    while time.time() < deadline and sum(x["windows"] for x in listener.observed.values()) < len(rows):
        time.sleep(0.5)
    spark.streams.removeListener(listener)
    seen = max(listener.observed.values(), key=lambda x: x["windows"])
    assert seen["windows"] == len(rows) and seen["clock_s"] == max(map(len, flags.values())) * 512 / 16000 and 1 <= seen["streams"] <= 4
    got = {r.stream_id: r for r in processors.live_state_of(spark, str(tmp_path / "cp"), o).collect()}
    batch = live_state(windows(spark, flags), o).collect()
    for s, f in flags.items():
        last = next(r for r in batch if r.stream_id == s and r.window_idx == len(f) - 1)
        assert (got[s].window_idx, got[s].in_speech, got[s].segment_seconds) == (last.window_idx, last.in_speech, last.segment_seconds)
        assert got[s].clock_s == len(f) * 512 / 16000


def test_resets_in_a_stream(spark, tmp_path):
    from tests.test_segmentation import with_resets

    rnd = random.Random(23)
    o = SegmentOptions(min_speech_s=0.2, soft_limit_s=0.6, hard_limit_s=1.37, min_silence_ms=200, look_back_s=0.1)
    flags = random_case(rnd)[0][:300] + "S" * 40
    resets = {0, 17, 18, 120, 299, 320}
    rows = [("a", i, c == "S", False, i in resets) for i, c in enumerate(flags)]
    mixed = [r for i in range(0, len(rows), 20) for r in rnd.sample(rows[i : i + 20], len(rows[i : i + 20]))]
    got = replay(spark, tmp_path, [mixed[:130], mixed[130:], [("a", None, None, True, None)]], SCHEMA + ", is_reset boolean",
                 lambda d: processors.segment_activity_stream(d, o), "reset1")
    assert sorted((r.segment_idx, r.start_sample, r.n_samples) for r in got) == [x[:3] for x in with_resets(flags, resets, o)]
