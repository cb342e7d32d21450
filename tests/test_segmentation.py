import random

import pytest
from pyspark.sql import functions as F

from tests.test_fold import GOLDENS, fold, options, random_case
from voxframe.operators import segmentation as G
from voxframe.operators.fold import SegmentOptions
from voxframe.operators.ordering import carry_forward, index_rows, running_total


def windows(spark, streams):
    rows = [(k, i, c == "S") for k, flags in streams.items() for i, c in enumerate(flags)]
    return spark.createDataFrame(rows, "stream_id string, window_idx bigint, is_speech boolean")


def collect(df):
    out = {}
    for r in df.orderBy("stream_id", "segment_idx").collect():
        out.setdefault(r.stream_id, []).append((r.segment_idx, r.start_sample, r.n_samples, r.start_s, r.end_reason))
    return out


def direct(flags, o):
    return [
        (i, s, n, max(0, s - sh) / o.rate, why)
        for i, (s, n, sh, why) in enumerate(fold(flags, o))
    ]


def test_goldens_as_streams(spark):
    groups = {}
    for i, (flags, *opts, finish, lengths, starts) in enumerate(GOLDENS):
        groups.setdefault(tuple(opts), {})[f"s{i}"] = (flags, lengths, starts)
    for opts, cases in list(groups.items())[:6]:
        got = collect(G.segment_activity(windows(spark, {k: v[0] for k, v in cases.items()}), options(*opts)))
        for k, (_, lengths, starts) in cases.items():
            assert [g[2] / 512 for g in got[k]] == lengths
            assert [g[1] / 512 for g in got[k]] == starts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_equal_whole_fold(spark, seed):
    rnd = random.Random(seed)
    _, o = random_case(rnd)
    if seed == 3:
        o = SegmentOptions(min_speech_s=0.064, soft_limit_s=0.3, hard_limit_s=0.7, min_silence_ms=64, look_back_s=0.1)
    streams = {f"s{k}": random_case(rnd)[0] for k in range(12)}
    streams["solid"] = "S" * 500 + "." * 3 + "S" * 90
    streams["flap"] = "SS." * 150
    streams["quiet"] = "." * 300
    got = collect(G.segment_activity(windows(spark, streams), o, block_windows=16))
    want = {k: direct(f, o) for k, f in streams.items() if direct(f, o)}
    assert got == want


def never_pausing(rnd, n):
    """Flags without a long pause: periodic ones, coin flips, and both mixed with speech."""
    coin = "".join(rnd.choice("S.") for _ in range(n))
    return {"period": ("SSSSS..." * n)[:n], "coin": coin, "mixed": ("SS.S....S" * n)[: n // 2] + coin[: n // 4] + "S" * (n // 4)}


@pytest.mark.parametrize("o", [
    SegmentOptions(min_speech_s=0.3, soft_limit_s=0.9, hard_limit_s=1.37, min_silence_ms=200, look_back_s=0.1),
    SegmentOptions(min_speech_s=0.2, soft_limit_s=None, hard_limit_s=0.3, min_silence_ms=96, look_back_s=0.5),
    SegmentOptions(min_speech_s=1.0, soft_limit_s=2.0, hard_limit_s=9.0, min_silence_ms=2000),
    SegmentOptions(min_speech_s=0.3, soft_limit_s=0.05, hard_limit_s=0.08, min_silence_ms=64, look_back_s=0.1),
])
def test_streams_that_never_pause(spark, o, monkeypatch):
    rnd = random.Random(4)
    streams = never_pausing(rnd, 1400)
    streams["pure"] = "S" * 900
    rounds, kept = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: (rounds.append("pos" in df.columns), kept(df))[1])
    got = collect(G.segment_activity(windows(spark, streams), o, block_windows=8))
    assert got == {k: direct(f, o) for k, f in streams.items() if direct(f, o)}
    # 175 blocks a stream: as many rounds as the logarithm says, at most (and the numbering of the blocks).
    assert 1 < sum(rounds) <= 1 + 8


def test_no_task_holds_a_stream(spark, monkeypatch):
    """No step of the segmentation puts the blocks of a stream into one task: blocks are dealt by stream and number, or stay."""
    plans, kept = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1])
    o = SegmentOptions(min_speech_s=0.3, soft_limit_s=0.9, hard_limit_s=1.37, min_silence_ms=200)
    G.segment_activity(windows(spark, never_pausing(random.Random(1), 400)), o, block_windows=16).collect()
    assert len(plans) > 6 and not any("RepartitionByExpression" in p for p in plans)


def test_options_of_each_stream(spark):
    """One pass over streams of different limits is the union of passes over each."""
    rnd = random.Random(11)
    limits = {"a": (9.0, 6.0), "b": (30.0, None), "c": (2.5, 2.0), "d": (None, G.DEFAULT_SOFT)}
    flags = {k: "".join(rnd.choice(("S" * rnd.randint(1, 60), "." * rnd.randint(1, 70))) for _ in range(60)) for k in limits}
    given = spark.createDataFrame([(k, *v) for k, v in limits.items()], "stream_id string, hard_limit_s double, soft_limit_s double")
    rows = windows(spark, flags).join(given, "stream_id").select(
        "stream_id", "window_idx", "is_speech", F.struct("hard_limit_s", "soft_limit_s").alias("options"))
    got = collect(G.segment_activity(rows, min_speech_s=1.0, block_windows=32))
    for k, (hard, soft) in limits.items():
        o = SegmentOptions(min_speech_s=1.0, **({} if hard is None else {"hard_limit_s": hard, "soft_limit_s": soft}))
        assert got[k] == direct(flags[k], o), k
    live = G.live_state(rows, min_speech_s=1.0, block_windows=32).groupBy("stream_id").agg(F.max("segment_seconds").alias("m")).collect()
    assert {r.stream_id: r.m <= (limits[r.stream_id][0] or 3600) for r in live} == dict.fromkeys(limits, True)


def test_missing_windows_are_silence(spark):
    o = SegmentOptions(min_speech_s=0.032, soft_limit_s=None, hard_limit_s=3, min_silence_ms=64)
    flags = "SSS" + "." * 40 + "SS....SSS" + "." * 70 + "S"
    full = windows(spark, {"a": flags})
    assert collect(G.segment_activity(full.filter("is_speech"), o, block_windows=16)) == {"a": direct(flags, o)}


@pytest.mark.parametrize("seed", [9, 10, 11, 12])
def test_live_state(spark, seed):
    rnd = random.Random(seed)
    flags, o = random_case(rnd)
    got = G.live_state(windows(spark, {"a": flags}), o, block_windows=32).orderBy("window_idx").collect()
    from voxframe.operators.fold import SegmentFold
    f = SegmentFold(o)
    assert len(got) == len(flags)
    for i, c in enumerate(flags):
        idle = not f.in_speech and c != "S"
        f.feed(i, 1, c == "S")
        assert (got[i].window_idx, got[i].in_speech, got[i].segment_seconds) == (i, f.in_speech, f.seconds)
        assert got[i].pending_window_s == (0.032 if idle else None)


@pytest.mark.parametrize("gap", [0, 2, 40])
def test_activity_runs_across_blocks(spark, gap):
    rnd = random.Random(gap)
    streams = {f"s{k}": random_case(rnd)[0] for k in range(6)}
    streams["sparse"] = ("S" + "." * 30) * 12
    got = {}
    for r in G.activity_runs(windows(spark, streams), gap, block_windows=16).collect():
        got.setdefault(r.stream_id, []).append((r.first_window, r.last_window))
    for k, flags in streams.items():
        want = []
        for i, c in enumerate(flags):
            if c == "S":
                if want and i - want[-1][1] <= gap + 1:
                    want[-1][1] = i
                else:
                    want.append([i, i])
        assert sorted(got[k]) == [tuple(w) for w in want]


def test_gaps_and_counts(spark):
    segs = spark.createDataFrame(
        [("a", 0, 512, 1024, 0.064), ("a", 1, 2048, 512, 0.032), ("b", 0, 0, 512, 0.032)],
        "stream_id string, segment_idx bigint, start_sample bigint, n_samples bigint, duration_s double")
    got = {(r.stream_id, r.segment_idx): r.gap_samples for r in G.gap_metrics(segs).collect()}
    assert got == {("a", 0): 512, ("a", 1): 512, ("b", 0): 0}
    assert {r.stream_id: r.segments for r in G.segment_counts(segs).collect()} == {"a": 2, "b": 1}


def test_index_rows_with_hot_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 5 + ["x", "y", "z"]), rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts int, id int").repartition(7)
    got = sorted((r.k, r.n, r.ts, r.id) for r in index_rows(df, "k", ["ts", "id"], "n").collect())
    want = []
    for k in sorted({r[0] for r in rows}):
        for n, (ts, i) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == k)):
            want.append((k, n, ts, i))
    assert got == want


def test_carry_and_running_total(spark):
    rnd = random.Random(2)
    rows = [(k, i, rnd.choice([None, None, i * 10])) for k in "ab" for i in range(60) if rnd.random() < 0.5]
    df = spark.createDataFrame(rows, "s string, i bigint, v bigint")
    got = {(r.s, r.i): r.p for r in carry_forward(df, "s", "i", {"v": "p"}, block_size=8).collect()}
    tot = {(r.s, r.i): r.t for r in running_total(df, "s", "i", "v", "t", block_size=8).collect()}
    for k in "ab":
        last, total = None, 0
        for s, i, v in rows:
            if s == k:
                assert got[(s, i)] == last and tot[(s, i)] == total
                last, total = (v if v is not None else last), total + (v or 0)


def with_resets(flags, resets, o):
    """The fold, cleared before each reset."""
    from voxframe.operators.fold import SegmentFold

    f = SegmentFold(o)
    for i, c in enumerate(flags):
        if i in resets:
            f.clear()
        f.feed(i, 1, c == "S")
    f.finish()
    return [(i, s, n, max(0, s - sh) / o.rate, why) for i, (s, n, sh, why) in enumerate(f.out)]


@pytest.mark.parametrize("block", [8, 64])
def test_resets(spark, block):
    rnd = random.Random(block)
    o = SegmentOptions(min_speech_s=0.2, soft_limit_s=0.6, hard_limit_s=1.37, min_silence_ms=200, look_back_s=0.1)
    streams = {f"s{k}": random_case(rnd)[0][:260] + "S" for k in range(5)} | {"solid": "S" * 200}
    resets = {k: {rnd.randrange(len(f)) for _ in range(rnd.choice((0, 1, 4)))} for k, f in streams.items()} | {"solid": {0, 50, 51, 199}}
    rows = [(k, i, c == "S", i in resets[k]) for k, f in streams.items() for i, c in enumerate(f)]
    # Windows that are not speech need no row, and a control row no window.
    rows = [(k, i, s if s or i % 2 else None, r) for k, i, s, r in rows if s or r or i == len(streams[k]) - 1 or rnd.random() < 0.5]
    table = spark.createDataFrame(rows, "stream_id string, window_idx bigint, is_speech boolean, is_reset boolean")
    got = collect(G.segment_activity_with_resets(table, o, block_windows=block))
    want = {k: with_resets(f, resets[k], o) for k, f in streams.items()}
    assert got.keys() == {k for k, v in want.items() if v}
    for k, segments in got.items():
        assert [(i, s, n, pytest.approx(t), why) for i, s, n, t, why in segments] == want[k], k


def test_sessions_in_event_time(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rnd = random.Random(2)
    marks = {k: sorted(rnd.randrange(4000) for _ in range(60)) for k in "ab"} | {"c": [0, 60, 120, 181]}
    rows = [(k, start + datetime.timedelta(seconds=s)) for k, own in marks.items() for s in own] + [("a", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id string, ts timestamp")
    want = []
    for k, own in marks.items():
        runs = []
        for s in own:
            if runs and s - runs[-1][1] <= 60:
                runs[-1][1], runs[-1][2] = s, runs[-1][2] + 1
            else:
                runs.append([s, s, 1])
        want += [(k, a, b, n) for a, b, n in runs]
    at = lambda t: int((t - start).total_seconds())
    got = [(r.stream_id, at(r.first_ts), at(r.last_ts), r.marks) for r in G.activity_sessions(df, "60 seconds").collect()]
    assert sorted(got) == sorted(want)
    # As a stream: what the watermark has passed, which a late mark of a far time brings about.
    far = [("z", start + datetime.timedelta(days=1))]
    for n, some in enumerate((rows[:70], rows[70:], far, [("z", start + datetime.timedelta(days=2))])):
        spark.createDataFrame(some, "stream_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    stream = spark.readStream.schema("stream_id string, ts timestamp").option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = (G.activity_sessions(stream, "60 seconds", watermark="2 hours").writeStream.outputMode("append").format("memory").queryName("sessions1")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination(240)
    streamed = [(r.stream_id, at(r.first_ts), at(r.last_ts), r.marks) for r in spark.sql("select * from sessions1 where stream_id <> 'z'").collect()]
    assert sorted(streamed) == sorted(want)
