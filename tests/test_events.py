import glob
import json

from pyspark.sql import functions as F

from voxframe.functions.text import CLIP_PLACEHOLDER as PH
from voxframe.operators import events
from voxframe.sources.jsonl import write_jsonl

TR = "stream_id string, segment_idx bigint, chunk_idx int, text string, start_s double, end_s double, prompt_retry boolean"


def records(spark, text, retry=False, clip=False):
    df = spark.createDataFrame([("s", 0, 0, text, 0.0, 1.0005, retry)], TR)
    log = events.event_log(df.select("stream_id").limit(0), df.select("stream_id", "segment_idx").limit(0)
                           .withColumn("start_s", F.lit(0.0)).withColumn("duration_s", F.lit(0.0)), df, clip)
    return [json.loads(r.value) for r in events.json_lines(log).collect()]


def test_transcript_record(spark):
    record, = records(spark, "hi", True)
    assert list(record) == ["type", "id", "start_ms", "start_formatted", "text", "end_ms", "end_formatted",
                            "prompt_retry", "repetition_patterns_clipped"]
    assert record["type"] == "transcript" and record["prompt_retry"] is True
    assert record["repetition_patterns_clipped"] == [] and record["end_ms"] == 1000
    assert record["end_formatted"] == "00:00:01.000"


def test_clip_is_opt_in(spark):
    loop = "dungu " * 30
    assert records(spark, loop)[0]["text"] == loop
    record, = records(spark, loop + "actual speech resumes", clip=True)
    assert record["text"] == "dungu " + PH + "actual speech resumes"
    assert record["repetition_patterns_clipped"] == ["dungu "]
    assert records(spark, "ordinary", clip=True)[0]["repetition_patterns_clipped"] == []


def test_log_order_and_jsonl(spark, tmp_path):
    streams = spark.createDataFrame([("a",), ("b",), ("a",)], "stream_id string")
    segments = spark.createDataFrame([("a", 1, 5.0, 1.0), ("a", 0, 0.0, 2.5)],
                                     "stream_id string, segment_idx bigint, start_s double, duration_s double")
    transcripts = spark.createDataFrame(
        [("a", 0, 1, "二", 1.0, 2.5, False), ("a", 0, 0, "one", 0.0, 1.0, False), ("a", 1, 0, "x", None, 1.0, False)], TR)
    log = events.event_log(streams, segments, transcripts)
    path = str(tmp_path / "log")
    write_jsonl(log, path, 3)
    lines = []
    for part in sorted(glob.glob(path + "/part-*")):
        lines += open(part, encoding="utf-8").read().splitlines()
    got = [json.loads(x) for x in lines]
    assert [g["type"] for g in got] == [
        "stream_start", "segment_start", "transcript", "transcript", "segment_end", "segment_start", "segment_end",
        "stream_end", "stream_start", "stream_end"]
    assert [g["text"] for g in got if g["type"] == "transcript"] == ["one", "二"]
    assert any("二" in x for x in lines)
    assert got[0] == {"type": "stream_start"}
    assert got[4] == {"type": "segment_end", "timestamp_ms": 2500, "timestamp_formatted": "00:00:02.500"}


def test_base_name(spark):
    import os
    sources = ["/a/b/talk.show.wav", "plain", "https://h/x.mp3", ".hidden", "a/.b.c", "dir/"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string")
    got = [r.n for r in df.select("i", events.base_name(F.col("s")).alias("n")).orderBy("i").collect()]
    assert got == [os.path.splitext(os.path.basename(s))[0] for s in sources]


def test_log_in_folders_by_stream(spark, tmp_path):
    """One evaluation, and folders in name order are the log of a stream."""
    import glob

    from pyspark.sql import functions as F

    from voxframe.operators import events
    from voxframe.sources import jsonl

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(s, i, i * 2.0, 1.5) for s, n in (("a/b", 25), ("c", 3)) for i in range(n)]
    segments = spark.createDataFrame(rows, "stream_id string, segment_idx bigint, start_s double, duration_s double")
    log = events.event_log(segments.select("stream_id"), segments.withColumn("start_s", counted("start_s")))
    path = str(tmp_path / "log")
    jsonl.write_jsonl_by_stream(log, path, folder_segments=10)
    assert seen.value == len(rows)
    want = {}
    for r in events.json_lines(log).orderBy(*events.SORT_KEYS).collect():
        want.setdefault(r.stream_id, []).append(r.value)
    folders = sorted(glob.glob(path + "/stream_id=*"))
    assert len(folders) == 2
    for folder, stream in zip(folders, sorted(want)):
        lines = [x.rstrip("\n") for p in sorted(glob.glob(folder + "/part=*/part-*")) for x in open(p)]
        assert lines == want[stream]
    assert len(glob.glob(folders[0] + "/part=1-*")) == 3
