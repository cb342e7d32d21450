"""Streaming event-log sink and progress reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from voxframe.functions.timefmt import fmt_ts, to_ms
from voxframe.operators.events import boundary_events, transcript_events
from voxframe.schemas import EVENT_LOG
from voxframe.sources.jsonl import write_jsonl


def write_log_stream(segments: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append boundary records of segments as they close, one folder per micro-batch.

    A batch that is run again replaces its own folder, so no record is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        log = boundary_events(batch)
        write_jsonl(_complete(log), f"{path}/batch={number}", mode="overwrite")

    return segments.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def write_transcript_stream(
    transcripts: DataFrame, path: str, checkpoint: str, clip: bool = False
) -> DataStreamWriter:
    """The same for transcript records."""

    def write(batch: DataFrame, number: int) -> None:
        log = transcript_events(batch, clip)
        write_jsonl(_complete(log), f"{path}/batch={number}", mode="overwrite")

    return transcripts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def merged_records(rows: DataFrame, clip: bool = False, epoch_ms: Column | None = None) -> DataFrame:
    """Rows of ``processors.merge_log_stream`` as records of the event log, with their number ``seq``."""
    is_type = F.col("type")
    phase = F.when(is_type == "stream_start", 0).when(is_type == "stream_end", 2).otherwise(1)
    kind = F.when(is_type == "transcript", 1).when(is_type == "segment_end", 2).otherwise(0)
    words = transcript_events(rows.filter(is_type == "transcript"), clip, epoch_ms)
    at = F.coalesce("start_s", "end_s")
    other = rows.filter(is_type != "transcript").select(
        "stream_id", "type", to_ms(at).alias("timestamp_ms"), F.when(at.isNotNull(), fmt_ts(at)).alias("timestamp_formatted"),
        phase.alias("phase"), F.coalesce("segment_idx", F.lit(0).cast("long")).alias("segment_idx"), kind.alias("kind"), F.lit(0).alias("chunk_idx"))
    return _complete(words.unionByName(other, allowMissingColumns=True))


def write_merged_log(
    rows: DataFrame, path: str, checkpoint: str, clip: bool = False, epoch_ms: Column | None = None
) -> DataStreamWriter:
    """Append the records of merged streams, one folder per micro-batch, in log order within it.

    The folders are the commit log: one is written whole, under its batch number, and a batch that runs again after a restart
    replaces its own. So the folders in order hold each record once, and the records of a stream in order.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_jsonl(merged_records(batch, clip, epoch_ms), f"{path}/batch={number:09d}", mode="overwrite")

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def with_progress(windows: DataFrame, name: str = "progress", size: int = 512, rate: int = 16000) -> DataFrame:
    """Observe the media clock of a stream of windows (F8): windows, streams and the furthest clock of each micro-batch.

    ``ProgressListener`` keeps what is observed; the clock of each single stream is in ``processors.live_state_of``.
    """
    return windows.observe(
        name, F.count(F.lit(1)).alias("windows"), F.approx_count_distinct("stream_id").alias("streams"),
        ((F.max("window_idx") + 1) * size / rate).alias("clock_s"))


def _complete(log: DataFrame) -> DataFrame:
    empty = log.sparkSession.createDataFrame([], EVENT_LOG)
    return empty.unionByName(log, allowMissingColumns=True)


class ProgressListener(StreamingQueryListener):
    """Keeps the number of input rows and the last batch number of each query."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        # What ``with_progress`` observed, by query and name: windows in all, and the furthest clock.
        self.observed: dict[tuple[str, str], dict] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.batches[str(p.id)] = p.batchId
        for name, row in (p.observedMetrics or {}).items():
            seen = row.asDict()
            known = self.observed.setdefault((str(p.id), name), {"windows": 0, "clock_s": 0.0, "streams": 0})
            known["windows"] += seen.get("windows") or 0
            known["clock_s"] = max(known["clock_s"], seen.get("clock_s") or 0.0)
            known["streams"] = max(known["streams"], seen.get("streams") or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


