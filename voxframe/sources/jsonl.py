"""Writing the event log as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.events import SORT_KEYS, json_lines

#: Segments of a stream in one folder of ``write_jsonl_by_stream``.
FOLDER_SEGMENTS = 10_000


def write_jsonl(log: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """One JSON object per line, in log order within and across the numbered part files.

    Ranges cover the full sort key, so a stream with most of the records spreads over
    several files.
    """
    lines = json_lines(log)
    ranged = (
        lines.repartitionByRange(partitions, *SORT_KEYS) if partitions
        else lines.repartitionByRange(*SORT_KEYS)
    )
    ranged.sortWithinPartitions(*SORT_KEYS).select("value").write.mode(mode).text(path)


def write_jsonl_by_stream(
    log: DataFrame, path: str, mode: str = "errorifexists", folder_segments: int = FOLDER_SEGMENTS
) -> None:
    """A folder per stream, in it one per ``folder_segments`` segments; folders and files in name order are the log of the stream.

    Records are dealt by stream and folder number, which needs no look at the data before: the log is evaluated once, and
    a stream with most of the records is as many tasks as it has folders.
    """
    part = F.when(F.col("phase") == 1, F.floor(F.col("segment_idx") / folder_segments)).otherwise(0)
    lines = json_lines(log).withColumn("part", F.format_string("%d-%09d", "phase", part.cast("long")))
    (
        lines.repartition("stream_id", "part").sortWithinPartitions(*SORT_KEYS)
        .select("stream_id", "part", "value").write.partitionBy("stream_id", "part").mode(mode).text(path)
    )
