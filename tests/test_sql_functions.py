from pyspark.sql import functions as F

from voxframe.functions import signal, text, timefmt
from voxframe.functions.sql import register_functions


def test_sql_equals_columns(spark):
    names = register_functions(spark)
    lines = ["go go go go", "好好好好", "  Hello\xa0", "ab" * 60, "", None, "one two three four"]
    df = spark.createDataFrame([(i, t, "hello ", i * 1234.56789) for i, t in enumerate(lines)], "i int, t string, p string, s double")
    df.createOrReplaceTempView("vf_lines")
    pairs = {
        "vf_strip(t)": text.strip(F.col("t")),
        "vf_is_repetitive_words(t)": text.is_repetitive_words(F.col("t")),
        "vf_is_repetitive_cjk(t)": text.is_repetitive_cjk(F.col("t")),
        "vf_is_repetitive(t)": text.is_repetitive(F.col("t")),
        "vf_same_text(t, p)": text.is_near_duplicate(F.col("t"), F.col("p"), 1.0),
        "vf_is_near_duplicate(t, p)": text.is_near_duplicate(F.col("t"), F.col("p")),
        "vf_clip_repetitions(t).text": text.clip_repetitions(F.col("t"))["text"],
        "vf_clip_repetitions(t).patterns": text.clip_repetitions(F.col("t"))["patterns"],
        "vf_to_ms(s)": timefmt.to_ms(F.col("s")),
        "vf_fmt_ts(s)": timefmt.fmt_ts(F.col("s")),
        "vf_fmt_ts_seconds(s)": timefmt.fmt_ts(F.col("s"), False),
        "vf_fmt_ts_trunc(s)": timefmt.fmt_ts_trunc(F.col("s")),
        "vf_window_size(i * 4000)": signal.window_size(F.col("i") * 4000),
        "vf_flag_speech(s)": signal.flag_speech(F.col("s")),
        "vf_rms(array(float(s), 2F))": signal.rms(F.array(F.col("s").cast("float"), F.lit(2.0).cast("float"))),
        "vf_quantize_pcm16(array(float(s), 0.3F, -2F))": signal.quantize_pcm16(
            F.array(F.col("s").cast("float"), F.lit(0.3).cast("float"), F.lit(-2.0).cast("float"))),
    }
    for sql, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {sql} FROM vf_lines ORDER BY i").collect()]
        assert got == [r[0] for r in df.orderBy("i").select(column).collect()], sql
    assert {s.split("(")[0] for s in pairs} == set(names)
