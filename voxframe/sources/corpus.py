"""A folder of WAV files of any rate and channel count, read by ranges.

Everything that needs samples says which ones, as narrow rows (file, position, length), and the task that needs them reads
just these bytes: chunks for detection, the samples of segments, files of segments. Samples of a
file are mixed to one channel and brought to the asked rate while they are read, each range on its own, so nothing above a read shuffles
samples, and a sample is read once per use.

Files of schemes that cannot be read by ranges come as whole contents from Spark's own reader; then each file is one
row, and its ranges are cut from that.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.signal import TARGET_RATE, WINDOW_AT_TARGET
from voxframe.operators.events import segment_names
from voxframe.schemas import SAMPLE_CHUNKS
from voxframe.session import materialize
from voxframe.sources import wav

#: Chunks hold whole detection windows (about a second), and a range a few dozen chunks.
CHUNK = 32 * WINDOW_AT_TARGET
RANGE_CHUNKS = 64
#: Samples that an export holds at a time.
EXPORT_SAMPLES = 1 << 20

#: What a task has to know of a file: the fields of the struct ``file`` of narrow rows.
_FILE = ["path", "audio_format", "bits_per_sample", "sample_rate", "channels", "data_offset", "frames"]


def frames_of(f, file: dict, first: int, n: int) -> np.ndarray:
    """Frames [first, first + n) of a file as one channel, the mean of its channels."""
    channels = file["channels"]
    width = file["bits_per_sample"] // 8 * channels
    f.seek(file["data_offset"] + first * width)
    samples = wav.to_float(f.read(n * width), file["audio_format"], file["bits_per_sample"])
    if channels == 1:
        return samples
    whole = samples[: len(samples) // channels * channels].reshape(-1, channels)
    return (whole.astype(np.float64).sum(axis=1) / channels).astype(np.float32)


def samples_at(f, file: dict, rate: int, start: int, n: int) -> np.ndarray:
    """Samples [start, start + n) of a file at ``rate``, linearly interpolated; fewer at its end.

    A file of F frames has int(F * rate / sample_rate) samples. A position depends on its number alone,
    so ranges fit together without a seam.
    """
    frames, own = file["frames"], file["sample_rate"]
    n = max(0, min(n, frames * rate // own - start))
    if n == 0:
        return np.empty(0, np.float32)
    if own == rate:
        return frames_of(f, file, start, n)
    place = (start + np.arange(n, dtype=np.int64)) * own
    at = place // rate
    first = int(at[0])
    source = frames_of(f, file, first, min(int(at[-1]) + 2, frames) - first).astype(np.float64)
    left, right = source[at - first], source[np.minimum(at + 1 - first, len(source) - 1)]
    return (left + (right - left) * ((place - at * rate) / rate)).astype(np.float32)


def wav_head(n_samples: int, rate: int) -> bytes:
    """Header of a mono 16-bit file."""
    size = 2 * n_samples
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", size)


class WavCorpus:
    """``headers`` has one row per readable file, with ``stream_id`` (the path, unless renamed); ``errors`` the others."""

    def __init__(self, spark: SparkSession, path: str, glob: str = "*.wav"):
        self.spark = spark
        listing = wav.listed_files(spark, path, glob)
        self.files = None if wav.read_by_ranges(spark, path) else listing.select("path", "content")
        headers = materialize(wav.wav_headers(spark, path, glob, strict=False).withColumn("stream_id", F.col("path")))
        self.errors = headers.filter(F.col("error").isNotNull())
        width = F.col("bits_per_sample").cast("long") / 8 * F.col("channels")
        self.headers = headers.filter(F.col("error").isNull()).withColumn("frames", F.floor(wav._data_bytes() / width).cast("long"))

    def renamed(self, stream_id) -> WavCorpus:
        """The same files with another column as ``stream_id``; it has to tell them apart."""
        return self._with(self.headers.withColumn("stream_id", stream_id))

    def only(self, streams: DataFrame) -> WavCorpus:
        """The files of the streams in a table ``stream_id``; the others are not read."""
        return self._with(self.headers.join(streams, "stream_id", "left_semi"))

    def _with(self, headers: DataFrame) -> WavCorpus:
        other = object.__new__(WavCorpus)
        other.__dict__ |= self.__dict__ | {"headers": headers}
        return other

    def _file(self):
        return F.struct(*_FILE).alias("file")

    def _read(self, ranges: DataFrame, work, schema: T.StructType) -> DataFrame:
        """Apply ``work(open file, file, row)`` -> rows to narrow rows (dicts) that have a struct ``file``."""
        names, columns = schema.fieldNames(), ranges.columns

        def done(f, rows) -> Iterator[pd.DataFrame]:
            for row in rows:
                yield pd.DataFrame(work(f, row["file"], row), columns=names)

        if self.files is None:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                path, f = None, None
                try:
                    for pdf in batches:
                        for values in pdf.itertuples(index=False, name=None):
                            row = dict(zip(columns, values, strict=True))
                            if row["file"]["path"] != path:
                                if f is not None:
                                    f.close()
                                path = row["file"]["path"]
                                f = wav._open(path)
                            yield from done(f, [row])
                finally:
                    if f is not None:
                        f.close()

            return ranges.mapInPandas(run, schema)

        # Narrow rows meet the content of their file, which is handed over once.
        per_file = ranges.groupBy(F.col("file.path").alias("path")).agg(F.collect_list(F.struct(*columns)).alias("ranges"))

        def run_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content, rows in zip(pdf["content"], pdf["ranges"], strict=True):
                    yield from done(io.BytesIO(content), rows)

        return per_file.join(self.files, "path").select("ranges", "content").mapInPandas(run_content, schema)

    def properties(self) -> DataFrame:
        """Rate, channels and duration of each readable file."""
        return wav.wav_properties(self.headers.drop("stream_id", "frames"))

    def chunks(self, rate: int = TARGET_RATE, chunk_samples: int = CHUNK) -> DataFrame:
        """Chunk rows of all files at ``rate``. Only file names and positions are dealt out."""
        total = F.floor(F.col("frames") * rate / F.col("sample_rate"))
        step = chunk_samples * RANGE_CHUNKS
        ranges = (
            self.headers.filter(total > 0)
            .select("stream_id", self._file(), F.explode(F.sequence(F.lit(0).cast("long"), (total - 1).cast("long"), F.lit(step).cast("long"))).alias("first"))
            .repartition("file.path", "first")
        )

        def work(f, file, row):
            first = int(row["first"])
            samples = samples_at(f, file, rate, first, step)
            return [
                (row["stream_id"], (first + c) // chunk_samples, first + c, rate, samples[c : c + chunk_samples])
                for c in range(0, len(samples), chunk_samples)]

        return self._read(ranges, work, _with_stream(SAMPLE_CHUNKS, self.headers))

    def _of_segments(self, segments: DataFrame, columns: list[str], source: str = "stream_id") -> DataFrame:
        files = self.headers.select(F.col("stream_id").alias("_source"), self._file())
        return segments.join(files, F.col(source) == F.col("_source")).select(*columns, "file")

    def cut(self, segments: DataFrame, rate: int = TARGET_RATE, source: str = "stream_id", deal=None) -> DataFrame:
        """``segments`` (stream_id, segment_idx, start_sample, n_samples at ``rate``, further columns) with their ``samples``.

        ``source`` names the column that says which file a segment is of. ``deal`` places the narrow rows before they are read;
        the samples stay where it puts them, in its order (unless the files come as whole contents).
        """
        asked = [c for c in segments.columns if c not in ("samples", "file")]
        ranges = self._of_segments(segments, asked, source)
        ranges = ranges.repartition("file.path", "segment_idx") if deal is None or self.files is not None else deal(ranges)
        schema = T.StructType([*[segments.schema[c] for c in asked], SAMPLE_CHUNKS["samples"]])

        def work(f, file, row):
            return [(*[row[c] for c in asked], samples_at(f, file, rate, int(row["start_sample"]), int(row["n_samples"])))]

        read = self._read(ranges, work, schema)
        return read if deal is None or self.files is None else deal(read)

    def cut_pieces(self, segments: DataFrame, rate: int = TARGET_RATE, piece: int = 1 << 18) -> DataFrame:
        """(stream_id, segment_idx, start_sample, samples) in pieces of bounded length, for segments that should not be one row."""
        ends = F.col("start_sample") + F.col("n_samples")
        pieces = segments.filter("n_samples > 0").select(
            "stream_id", "segment_idx",
            F.explode(F.sequence(F.col("start_sample"), ends - 1, F.lit(piece).cast("long"))).alias("at"), ends.alias("end"),
        ).select("stream_id", "segment_idx", F.col("at").alias("start_sample"), (F.least(F.col("at") + piece, "end") - F.col("at")).alias("n_samples"))
        return self.cut(pieces, rate).drop("n_samples").filter(F.size("samples") > 0)

    def export(self, segments: DataFrame, folder: str, rate: int | None = None) -> DataFrame:
        """Write each segment (stream_id, segment_idx, start_s, duration_s) to ``folder``/stream/name and list the files.

        ``rate`` None keeps that of the file. A task copies a segment in parts of bounded length; it writes under a private name and moves the
        file into place, so a task that runs again does no harm.
        """
        asked = ["stream_id", "segment_idx", "start_s", "duration_s", "name"]
        ranges = self._of_segments(segment_names(segments.select(*asked[:4])), asked).repartition("file.path", "segment_idx")
        schema = T.StructType([segments.schema["stream_id"], *T._parse_datatype_string(
            "segment_idx bigint, name string, rate int, n_samples bigint, path string").fields])

        def work(f, file, row):
            to, name = rate or file["sample_rate"], row["name"]
            # Both ends in whole samples of the rate, truncated, within the file.
            total = file["frames"] * to // file["sample_rate"]
            start, end = max(0, int(row["start_s"] * to)), min(total, int((row["start_s"] + row["duration_s"]) * to))
            end = max(start, end)
            system, root = wav.file_system(folder)
            target = f"{root}/{row['stream_id']}"
            system.create_dir(target, recursive=True)
            draft = f"{target}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(wav_head(end - start, to))
                for at in range(start, end, EXPORT_SAMPLES):
                    out.write(wav.pcm16(samples_at(f, file, to, at, min(EXPORT_SAMPLES, end - at))))
            system.move(draft, f"{target}/{name}")
            return [(row["stream_id"], row["segment_idx"], name, to, end - start, f"{folder}/{row['stream_id']}/{name}")]

        return materialize(self._read(ranges, work, schema))


def _with_stream(schema: T.StructType, headers: DataFrame) -> T.StructType:
    return T.StructType([headers.schema["stream_id"], *schema.fields[1:]])
