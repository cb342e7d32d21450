from voxframe import dims
from voxframe.operators import lookups
from voxframe.sources import jobs as J

JOB = ("job_id bigint, source string, duration_s double, backend string, language string, model string, "
       "condition boolean, sub_timestamps boolean, device string")


def job(backend="whisper", language=None, model=None, condition=None, sub=True, device=None, source="a.wav", duration=1.0):
    return (source, duration, backend, language, model, condition, sub, device)


def table(spark, *jobs):
    return spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], JOB)


def rows(df):
    return df.orderBy("job_id").collect()


def test_models(spark):
    df = table(spark, job("moonshine", "EN"), job("moonshine", "zh"), job("moonshine", "es"), job("moonshine", "en", "Tiny"),
               job("moonshine", "fr"), job("moonshine", "en", "huge"), job(model="large-v3-turbo"), job(model="org/own"), job(),
               job("glm-asr"), job("qwen-asr-rs"))
    got = rows(lookups.with_limits(lookups.resolve_models(df)))
    assert [(r.resolved_model, r.streaming, r.hard_s, r.soft_s) for r in got[:4]] == [
        ("small-streaming-en", True, 60, 6.0), ("base-zh", False, 9, 6.0), ("base-es", False, 9, 6.0), ("tiny-en", False, 9, 6.0)]
    assert got[0].url == f"{dims.MODEL_HOST}/small-streaming-en/quantized" and got[0].arch == 4
    assert got[3].url == f"{dims.MODEL_HOST}/tiny-en/quantized/tiny-en"
    assert got[4].model_error == "Unknown language: fr. Available: en, zh, es"
    assert got[5].model_error == ("Unknown model for language en: huge. "
                                  "Available: medium-streaming, small-streaming, base, tiny-streaming, tiny")
    assert [r.resolved_model for r in got[6:]] == ["openai/whisper-large-v3-turbo", "org/own", "openai/whisper-large-v3-turbo",
                                                   "zai-org/GLM-ASR-Nano-2512", None]
    assert all(r.model_error is None for r in got[6:])


def test_limits(spark):
    df = table(spark, job(), job(sub=False), job("nvidia-whisper"), job("qwen-asr-mlx"), job("glm-asr-mlx"), job("none"))
    got = rows(lookups.with_limits(lookups.resolve_models(df)))
    assert [(r.hard_s, r.soft_s) for r in got] == [(60, 6.0), (30, 6.0), (30, 6.0), (60, 30.0), (60, 30.0), (None, None)]
    assert got[5].limit_error == "Unsupported backend: none"


def test_languages(spark):
    df = table(spark, job("qwen-asr-rs", "yue"), job("qwen-asr-rs", "xx"), job("qwen-asr-mlx", ""), job("glm-asr", "en"),
               job("glm-asr", ""), job("glm-asr-mlx", "fr"), job("glm-asr-mlx", None), job("nvidia-whisper", None),
               job("nvidia-whisper", "de"), job("whisper", "yue", "alvanlii/whisper-small-cantonese"), job("whisper", "yue", "tiny"))
    got = rows(lookups.map_languages(df))
    assert [r.language_param for r in got] == ["Cantonese", None, None, "English", None, None, None, "multi", "de", "zh", "yue"]
    assert [r.language_error is not None for r in got] == [False, True, False, False, True] + [False] * 6
    assert got[3].prompt == "Transcribe the input speech in English."
    assert [r.language_warning for r in got[5:7]] == [True, False]
    assert len(dims.LANGUAGES) == 30


def test_validation(spark):
    df = table(spark, job(), job("moonshine"), job("moonshine", "en", condition=True, device="cpu"), job("what"),
               job(source="rtmp://x", duration=None), job("glm-asr", condition=True), job("glm-asr", condition=False))
    good, bad = J.validate_jobs(df)
    assert [r.job_id for r in rows(good)] == [0, 6]
    errors = {r.job_id: r.errors for r in bad.collect()}
    assert {k: len(v) for k, v in errors.items()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    assert errors[3] == ["Unsupported backend: what"]
    assert {r.job_id: r.is_url for r in bad.collect()}[4] is True


def test_detokenize(spark):
    vocab = [b"\xe2\x96\x81he", b"llo", b"<s>", b"\xe4\xbd", b"\xa0", b"<", None, "▁好".encode(), b"\xff"]
    tokens = [[2, 0, 1, 7, 99, -1], [3, 4], [3], [5, 1], [], [8, 0]]
    want = []
    for ids in tokens:
        parts = [vocab[i] for i in ids if 0 <= i < len(vocab) and vocab[i] is not None]
        data = b"".join(p for p in parts if not (len(p) >= 2 and p[:1] == b"<" and p[-1:] == b">"))
        want.append(data.decode("utf-8", "replace").replace("▁", " ").strip())
    t = spark.createDataFrame([(i, ids) for i, ids in enumerate(tokens)], "stream_id int, tokens array<int>")
    v = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(vocab)], "token_id int, token binary")
    assert [r.text for r in lookups.detokenize(t, v).orderBy("stream_id").collect()] == want


def test_detokenize_keeps_rows_of_one_key_apart(spark):
    v = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"b"))], "token_id int, token binary")
    rows = [("k", [0, 1]), ("k", [1]), ("k", [1]), ("k", None), (None, [0]), ("e", [])]
    t = spark.createDataFrame(rows, "stream_id string, tokens array<int>")
    got = sorted(((r.stream_id, r.text) for r in lookups.detokenize(t, v).collect()), key=repr)
    assert got == sorted([("k", "ab"), ("k", "b"), ("k", "b"), ("k", ""), (None, "a"), ("e", "")], key=repr)
