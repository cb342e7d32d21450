import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import signal as S
from voxframe.functions import timefmt as TF


def run(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_formatters(spark):
    rnd = random.Random(1)
    xs = [0.0, 0.0005, 0.0015, 59.9996, 3599.9999, 360000.5, 399999.999] + [rnd.random() * 50000 for _ in range(300)]

    def rounded(x):
        ms = round(x * 1000)
        return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"

    def whole(x):
        s = round(x)
        return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"

    def trunc(x):
        return f"{math.floor(x / 3600):02d}:{math.floor(x % 3600 / 60):02d}:{math.floor(x % 60):02d}.{int(x % 1 * 1000):03d}"

    assert run(spark, xs, TF.fmt_ts(F.col("x"))) == [rounded(x) for x in xs]
    assert run(spark, xs, TF.fmt_ts(F.col("x"), decimals=False)) == [whole(x) for x in xs]
    assert run(spark, xs, TF.fmt_ts_trunc(F.col("x"))) == [trunc(x) for x in xs]
    with pytest.raises(Exception, match="non-negative"):
        run(spark, [-1.0], TF.fmt_ts_trunc(F.col("x")))


def test_event_id(spark):
    df = spark.range(2000).select(TF.event_id(F.lit(1_700_000_000_000), F.col("id")).alias("v"))
    ids = [r.v for r in df.collect()]
    assert len(set(ids)) == 2000
    import uuid
    for text in ids[:50]:
        u = uuid.UUID(text)
        assert u.version == 7 and u.variant == uuid.RFC_4122
        assert int(text.replace("-", "")[:12], 16) == 1_700_000_000_000


def test_window_size(spark):
    assert run(spark, [16000, 8000, 44100, 48000], S.window_size(F.col("x")), "int") == [512, 256, 256, 256]
    assert S.window_size_for(16000) == 512 and S.window_size_for(8000) == 256


def test_quantize_matches_numpy(spark):
    rnd = np.random.default_rng(2)
    arr = (rnd.random(500) * 3 - 1.5).astype(np.float32)
    got = run(spark, [arr.tolist()], S.quantize_pcm16(F.col("x")), "array<float>")[0]
    assert got == (np.clip(arr, -1.0, 1.0) * np.float32(32767.0)).astype(np.int16).tolist()


def test_downmix_and_rms(spark):
    assert run(spark, [[1.0, 3.0, -2.0, 2.0, 9.0], []], S.downmix(F.col("x"), 2), "array<float>") == [[2.0, 0.0], []]
    assert run(spark, [[3.0, 4.0]], S.rms(F.col("x")), "array<float>")[0] == pytest.approx(math.sqrt(12.5))


def test_flag_is_strict(spark):
    assert run(spark, [0.5, 0.5000001], S.flag_speech(F.col("x"))) == [False, True]
