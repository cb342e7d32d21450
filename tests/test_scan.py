import re

import pytest
from pyspark.sql import functions as F

from voxframe.operators import recognize, scan

CHUNKS = "stream_id string, segment_idx bigint, chunk_idx int, text string, t0 double, t1 double"
HELLO = [("hello world", 0.0, 3.0), ("more text", 3.0, 6.0)]


def state_df(spark, rows):
    return spark.createDataFrame(
        [(*r,) for r in rows],
        "stream_id string, segment_idx bigint, line string, last_chunk string, prior_line string, "
        "prior_last_chunk string, before_line string, before_prior string")


def chunk_df(spark, chunks, segment=1):
    return spark.createDataFrame([("s", segment, i, *c) for i, c in enumerate(chunks)], CHUNKS)


def plan(spark, chunks, prior_last="", prompt_source=None, **kw):
    state = state_df(spark, [("s", 1, "x", "x", prior_last, prior_last, prompt_source, "")])
    return [(r.repeat_idx, r.trim_start_s, r.trim_start_samples)
            for r in scan.plan_retries_chunks(chunk_df(spark, chunks), state, **kw).collect()]


def test_chunk_plans(spark):
    loop = [("hello", 0.0, 2.0), ("abcdefg", 2.0, 5.0), ("abcdefg", 5.0, 8.0)]
    assert plan(spark, loop) == [(2, 5.0, 80000)]
    assert plan(spark, HELLO, "hello world", "hello world") == [(0, 0.0, 0)]
    assert plan(spark, HELLO, "hello world", None) == []
    assert plan(spark, HELLO, "hello world", "hello world", condition=False) == []
    assert plan(spark, [("alpha", 0.0, 1.0), ("beta", 1.0, 2.0), ("gamma", 2.0, 3.0)], "prior text", "p") == []
    assert plan(spark, [("alpha", 0.0, 1.0), ("alpha", None, 2.0)]) == []
    assert plan(spark, [("a whole line of text", 0.0, 1.0), ("a whole line of texts", 1.0, 2.0)]) == [(1, 1.0, 16000)]


def test_single_plans(spark):
    rows = [("s", 1, "hello world", "", "hello world", "", "hello world", ""),
            ("t", 1, "hello world", "", "hello world", "", None, ""),
            ("u", 1, "hello world!", "", "hello world", "", "fresh", ""),
            ("v", 1, "hello world", "", "hello world", "", "go go go go", "")]
    got = scan.plan_retries_single(state_df(spark, rows)).collect()
    assert sorted((r.stream_id, r.prompt) for r in got) == [("s", "hello world"), ("u", "fresh")]


def test_splice_and_times(spark):
    chunks = chunk_df(spark, [("intro", 0.0, 3.0), ("loop", 3.0, 5.0), ("loop", 5.0, 7.0)])
    state = state_df(spark, [("s", 1, "x", "x", "", "", None, "")])
    plans = scan.plan_retries_chunks(chunks, state)
    retried = chunk_df(spark, [("tail", 1.0, 4.0), ("open", 4.0, None)])
    spliced = scan.splice_retries(chunks, plans, retried)
    segments = spark.createDataFrame([("s", 1, 10.0, 160000)], "stream_id string, segment_idx bigint, start_s double, n_samples bigint")
    got = [(r.chunk_idx, r.text, r.start_s, r.end_s, r.prompt_retry)
           for r in scan.to_absolute_times(spliced, segments).orderBy("chunk_idx").collect()]
    assert got == [(0, "intro", 10.0, 13.0, False), (1, "loop", 13.0, 15.0, False),
                   (2, "tail", 16.0, 19.0, True), (3, "open", 19.0, 20.0, True)]
    flags = scan.flag_retried(chunks, plans).orderBy("chunk_idx").collect()
    assert [r.prompt_retry for r in flags] == [False, False, True]
    bad = scan.to_absolute_times(
        chunk_df(spark, [("x", None, 1.0)]).withColumn("prompt_retry", F.lit(False)), segments).first()
    assert bad.error and bad.start_s is None and bad.end_s is None


def walk(lines):
    """Prior state and prompt segment by segment."""
    memory, out = recognize.Conversation(), []
    for texts in lines:
        out.append((memory.prior_line, memory.prior_last_chunk, memory.prompt))
        memory.remember(texts)
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_state_equals_walk(spark, block):
    import random
    rnd = random.Random(block)
    words = ["go go go go", "hello there", "Hello there ", "hello therr", " ", "well", "好好好好好"]
    streams = {f"s{k}": [[rnd.choice(words) for _ in range(rnd.randint(0, 3))] for _ in range(25)] for k in range(4)}
    rows = [(s, i, j, t, 0.0, 1.0) for s, segs in streams.items() for i, texts in enumerate(segs) for j, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    segments = spark.createDataFrame([(s, i) for s, segs in streams.items() for i in range(len(segs))],
                                     "stream_id string, segment_idx bigint")
    state = scan.prior_state(scan.segment_line(chunks, block_size=block), segments, block_size=block)
    got = {(r.stream_id, r.segment_idx): (r.prior_line, r.prior_last_chunk, r.prompt)
           for r in scan.conditioning_prompts(state).collect()}
    for s, segs in streams.items():
        for i, want in enumerate(walk(segs)):
            assert got[(s, i)] == want, (s, i)
    assert {r.prompt for r in scan.conditioning_prompts(state, condition=False).collect()} == {""}


def test_concat_results_and_budget(spark):
    results = spark.createDataFrame(
        [("a", 0, 0, [" one", "x"]), ("a", 0, 1, []), ("a", 0, 2, [" two "])],
        "stream_id string, segment_idx bigint, result_idx int, alternatives array<string>")
    assert scan.concat_results(results).first().text == "one two"
    segs = spark.createDataFrame([(0, "streaming"), (16000 * 60, "streaming"), (16000 * 100, "streaming"),
                                  (16000 * 9, "non_streaming"), (5, "fixed")], "n_samples bigint, family string")
    assert [r.max_tokens for r in scan.token_budget(segs).collect()] == [2, 390, 448, 117, 500]


def test_finish_text(spark):
    df = spark.createDataFrame([("zh", "简体"), ("en", "简体")], "language string, text string")
    got = scan.finish_text(df, "简体", "簡體", "traditional").collect()
    assert [r.text for r in got] == ["簡體", "簡體"]
    got = scan.finish_text(df, "简体", "簡體", "traditional", ["zh"]).collect()
    assert [r.text for r in got] == ["簡體", "简体"]


def test_recovery_audit(spark):
    log = spark.createDataFrame([("a", True, ["ab"]), ("a", False, []), ("b", False, ["ab"])],
                                "stream_id string, prompt_retry boolean, repetition_patterns_clipped array<string>")
    got = {(r.stream_id, r.pattern, r.level): (r.rows, r.retried, r.clipped) for r in scan.recovery_audit(log).collect()}
    assert got[(None, None, 3)] == (3, 1, 2) and got[("a", None, 1)] == (2, 1, 1) and got[("b", "ab", 0)] == (1, 0, 1)


class Staged:
    """Recognizer that returns prepared results in turn and notes its calls."""

    def __init__(self, *results):
        self.results, self.calls = list(results), []

    def __call__(self, samples, prompt):
        self.calls.append((len(samples), prompt))
        return [{"text": t, "t0": a, "t1": b} for t, a, b in self.results.pop(0)]


def one(fn, memory, n=160000, sub=True, **kw):
    import numpy as np
    return [(c["text"], c["t0"], c["t1"], r)
            for c, r in recognize.recognize_one(fn, np.zeros(n, dtype="float32"), memory, sub, **kw)]


def test_retry_goldens():
    M = recognize.Conversation
    fn = Staged([("hello world", 0.0, None)], [("something different", 0.0, None)])
    assert one(fn, M("hello world", "hello world", "p"), sub=False) == [("something different", 0.0, None, True)]
    assert [c[1] for c in fn.calls] == ["p", None]
    fn = Staged([("hello world", 0.0, None)])
    assert one(fn, M("hello world", "hello world"), sub=False)[0][3] is False and len(fn.calls) == 1
    fn = Staged([("hello", 0.0, 2.0), ("abcdefg", 2.0, 5.0), ("abcdefg", 5.0, 8.0)], [("fresh tail", 0.0, 3.0)])
    assert one(fn, M()) == [("hello", 0.0, 2.0, False), ("abcdefg", 2.0, 5.0, False), ("fresh tail", 5.0, 8.0, True)]
    assert fn.calls == [(160000, None), (80000, None)]
    fn = Staged(HELLO, [("actual transcription", 0.0, 6.0)])
    assert one(fn, M("hello world", "hello world", "p")) == [("actual transcription", 0.0, 6.0, True)]
    assert len(one(Staged(HELLO), M("hello world", "hello world"))) == 2
    memory = M()
    one(Staged([("alpha", 0.0, 1.0), ("alpha", 1.0, 2.0)], [("post-retry tail", 0.0, 1.0)]), memory)
    assert memory.prior_last_chunk == "post-retry tail"
    memory = M("kept", "kept", "kept")
    assert one(Staged([]), memory) == [] and memory.prior_line == "kept"


def test_transcribe_on_spark(spark):
    rows = [(s, i, float(i * 10), [0.1 * ((i * 7 + k) % 5) for k in range(1600)]) for s in "ab" for i in range(6)]
    df = spark.createDataFrame(rows, "stream_id string, segment_idx bigint, start_s double, samples array<float>")

    def build():
        def fn(samples, prompt):
            text = f"n{len(samples)} {round(float(samples[0]), 1)} after {prompt or 'nothing'}"[:40]
            return [{"text": text, "t0": 0.0, "t1": 0.05}, {"text": "tail %.1f" % samples[1], "t0": 0.05, "t1": None}]
        return fn

    got = sorted(tuple(r) for r in recognize.transcribe_segments(df, build).collect())
    want = []
    import numpy as np
    for s in "ab":
        memory = recognize.Conversation()
        for _, i, start, samples in [r for r in rows if r[0] == s]:
            for k, (c, retried) in enumerate(recognize.recognize_one(build(), np.asarray(samples, dtype="float32"), memory, True)):
                end = c["t1"] if c["t1"] is not None else 0.1
                want.append((s, i, k, c["text"], start + c["t0"], start + end, retried))
    assert got == want
    for size in (1, 2, 4):
        parallel = recognize.transcribe_segments(df, build, block_segments=size).collect()
        assert sorted(tuple(r) for r in parallel) == want
    free = recognize.transcribe_segments(df, build, condition=False).collect()
    assert all("nothing" in r.text for r in free if r.chunk_idx == 0)


def test_raw_or_converted_memory():
    for raw, want in ((False, "UPPER"), (True, "upper")):
        memory = recognize.Conversation()
        one(Staged([("upper", 0.0, None)]), memory, convert=str.upper, raw_memory=raw)
        assert memory.prior_line == want and memory.prior_last_chunk == "upper"


def test_plans_from_lists_equal_plans_from_chunks(spark):
    texts = [["go", "Go ", "stop"], ["stop", "on"], [None, "on"], ["on", "on", "on"], ["a whole line of text", "a whole line of texts"]]
    rows = [("s", i, k, t, None if (i, k) == (1, 0) else 2.0 * k, None) for i, part in enumerate(texts) for k, t in enumerate(part)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    for threshold in (0.9, 1.0):
        for condition in (True, False):
            state = scan.prior_state(scan.segment_line(chunks, keep=["t0"]))
            want = scan.plan_retries_chunks(chunks, state, condition, threshold).collect()
            assert want and sorted(scan.plan_retries_chunks(None, state, condition, threshold).collect()) == sorted(want)


def test_prior_state_filters_both_reads_alike(spark):
    """Both sides of the block join read one shuffle: the same filters stand below it on either."""
    chunks = chunk_df(spark, HELLO).withColumn("text", F.explode(F.split("text", " ")))
    plan = scan.prior_state(scan.segment_line(chunks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(FLOOR") + plan.count("isnotnull(block") != 1
    filters = [line.split("Filter", 1)[1] for line in plan.split("\n") if "Filter" in line and "segment_idx" in line]
    assert len({re.sub(r"#\d+L?", "", f) for f in filters}) <= 1 and len(filters) != 1


def test_prompts_in_steps_equal_the_function(spark):
    lines = ["", None, "go go go go", "hello there", "Hello there ", "hello their", "x" * 150 + "abc", "x" * 150 + "abd"]
    rows = [("s", i * 10 + j, "x", "", "", "", a, b) for i, a in enumerate(lines) for j, b in enumerate(lines)]
    for threshold in (0.9, 1.0):
        state = state_df(spark, rows)
        want = {r.segment_idx: r.p for r in state.select(
            "segment_idx", scan.conditioning_context(F.col("before_line"), F.col("before_prior"), threshold).alias("p")).collect()}
        assert {r.segment_idx: r.prompt for r in scan.conditioning_prompts(state, threshold=threshold).collect()} == want
