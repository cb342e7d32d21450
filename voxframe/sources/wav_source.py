"""``spark.read.format("wav_chunks")``: chunk rows of WAV files as a data source with planned byte ranges.

    spark.dataSource.register(WavChunks)
    spark.read.format("wav_chunks").option("rate", 16000).load("file:///recordings")

Planning lists names and sizes and plans ranges of bytes; headers are read where a range is decoded. A range holds the chunks that
begin in it. Filters ``stream_id = ...`` and ``stream_id in (...)`` leave out the other files before anything is read, if
``spark.sql.python.filterPushdown.enabled`` is set. Only schemes that tasks can read by ranges are taken (``wav.RANGED_SCHEMES``);
``corpus.WavCorpus`` reads the rest too.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from voxframe.functions.signal import TARGET_RATE
from voxframe.schemas import SAMPLE_CHUNKS
from voxframe.sources import wav
from voxframe.sources.corpus import CHUNK, samples_at

_ARROW = pa.schema([
    ("stream_id", pa.string()), ("chunk_seq", pa.int64()), ("start_sample", pa.int64()), ("rate", pa.int32()),
    ("samples", pa.list_(pa.float32()))])


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class WavChunks(DataSource):
    """Options: path, pathGlobFilter (*.wav), rate, chunkSamples, rangeBytes, and onError (skip, or fail for files that are no WAV)."""

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self):
        return SAMPLE_CHUNKS

    def reader(self, schema):
        return WavChunksReader(self.options)


class WavChunksReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("wav_chunks needs a path")
        self.glob = options.get("pathGlobFilter", "*.wav")
        self.rate = int(options.get("rate", TARGET_RATE))
        self.chunk = int(options.get("chunkSamples", CHUNK))
        self.range_bytes = int(options.get("rangeBytes", wav.RANGE_BYTES))
        self.fail = options.get("onError", "skip") == "fail"
        self.only: set[str] | None = None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("stream_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of all files, by name."""
        from pyarrow import fs

        system, root = wav.file_system(self.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(
            (prefix + x.path, x.size) for x in found
            if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path), self.glob))

    def partitions(self) -> list[ByteRange]:
        return [
            ByteRange(path, size, at, min(at + self.range_bytes, size))
            for path, size in self.files() if self.only is None or path in self.only
            for at in range(0, max(size, 1), self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with wav._open(part.path) as f:
            try:
                head = wav.read_header(f, part.size, strict=False)
            except ValueError:
                if self.fail:
                    raise
                return
            rest = part.size - head["data_offset"]
            width = head["bits_per_sample"] // 8 * head["channels"]
            file = head | {"frames": (head["data_size"] if 0 < head["data_size"] <= rest else rest) // width}
            total = file["frames"] * self.rate // file["sample_rate"]

            def chunk_at(byte: int) -> int:
                """The first chunk whose first frame lies at or behind a byte."""
                frame = max(0, -(-(byte - file["data_offset"]) // width))
                return -(-frame * self.rate // (self.chunk * file["sample_rate"]))

            # The last range of a file takes what is left.
            end = -(-total // self.chunk) if part.end >= part.size else chunk_at(part.end)
            for k in range(chunk_at(part.start), min(end, -(-total // self.chunk))):
                samples = samples_at(f, file, self.rate, k * self.chunk, self.chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([k]), pa.array([k * self.chunk]), pa.array([self.rate], pa.int32()),
                     pa.array([samples], _ARROW.field("samples").type)], schema=_ARROW)
