"""WAV corpora: header profile, ranged decoding and segment export.

Listing a corpus reads names and sizes only. Headers are read with a few small seeks per
file, and the samples by byte ranges, so one long recording is decoded by many tasks.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.signal import TARGET_RATE
from voxframe.schemas import SAMPLE_CHUNKS, WAV_HEADER

RANGE_BYTES = 4 << 20
_HEADER_FIELDS = [f.name for f in WAV_HEADER if f.name not in ("path", "file_size")]


#: URI schemes whose files tasks read by ranges, with the name that the reader has for them.
RANGED_SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


class UnknownScheme(Exception):
    """No reader for the scheme of a path: that is a mistake of the call, not a broken file."""


def scheme_of(path: str) -> str:
    return path.split(":", 1)[0].lower() if "://" in path or path.startswith("file:/") else "file"


def file_system(path: str):
    """(file system, path within it) of a URI or a plain local path."""
    from pyarrow import fs

    scheme = scheme_of(path)
    if scheme not in RANGED_SCHEMES:
        raise UnknownScheme(f"files of scheme {scheme!r} are not read by ranges: {path}")
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(RANGED_SCHEMES[scheme] + path[path.index("://"):])


def _open(path: str):
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _chunks_until(f, size: int, wanted: bytes, missing: str):
    """Skip chunks up to the wanted one; return (body offset, body size)."""
    while True:
        head = f.read(8)
        if len(head) < 4:
            raise ValueError(missing)
        if len(head) < 8:
            raise ValueError("file ends inside a chunk header")
        name, length = struct.unpack("<4sI", head)
        body = f.tell()
        if name == wanted:
            return body, length
        if body + length > size:
            raise ValueError(f"chunk {name!r} runs past the end of the file")
        f.seek(min(size, body + length + length % 2))


def read_header(f, size: int, strict: bool = True) -> dict:
    """Header fields of a PCM or float file; raises ValueError for anything else.

    With ``strict`` any other than one channel of 16 kHz is an error too.
    """
    riff = f.read(12)
    for at, wanted in ((0, b"RIFF"), (8, b"WAVE")):
        if riff[at:at + 4] != wanted:
            raise ValueError(f"no RIFF/WAVE file: {riff[at:at + 4]!r} where {wanted.decode()} belongs")
    body, length = _chunks_until(f, size, b"fmt ", "no fmt chunk")
    fmt = f.read(min(length, 16))
    if len(fmt) < 16:
        raise ValueError("fmt chunk has fewer than 16 bytes")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt)
    allowed = {1: (16, 32), 3: (32,)}
    if kind not in allowed:
        raise ValueError(f"sample format {kind} is neither PCM (1) nor float (3)")
    if bits not in allowed[kind]:
        wanted = "16-bit or 32-bit PCM" if kind == 1 else "32-bit float"
        raise ValueError(f"{bits} bits a sample; {wanted} can be read")
    if channels < 1 or rate < 1:
        raise ValueError(f"{channels} channels of {rate} samples a second")
    if strict and channels != 1:
        raise ValueError(f"{channels} channels; one can be read")
    if strict and rate != TARGET_RATE:
        raise ValueError(f"{rate} samples a second; {TARGET_RATE} can be read")
    f.seek(min(size, body + length + length % 2))
    offset, data_size = _chunks_until(f, size, b"data", "no data chunk")
    return dict(audio_format=kind, bits_per_sample=bits, sample_rate=rate, channels=channels,
                data_size=data_size, data_offset=offset, error=None)


def _header_row(path: str, opener, size: int, strict: bool = True) -> dict:
    try:
        with opener() as f:
            fields = read_header(f, size, strict)
    except (ValueError, OSError) as e:
        fields = {**dict.fromkeys(_HEADER_FIELDS), "error": str(e)}
    return {"path": path, "file_size": size, **fields}


def _as_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in WAV_HEADER]).astype(object)


def listed_files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """``path, length, content`` of the files of a folder, by Spark's own file systems; a scheme that they do not know raises."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    )


def read_by_ranges(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read parts of the files at ``path``; else Spark has to hand over their content."""
    if "://" not in path and not path.startswith("file:/"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return scheme_of(path) in RANGED_SCHEMES


def wav_headers(spark: SparkSession, path: str, glob: str = "*.wav", strict: bool = True) -> DataFrame:
    """One row per file of a folder: header fields, or the first error.

    Spark's listing leaves out files of zero bytes; ``wav_headers_at`` reports them. With ``strict`` other
    formats than one channel of 16 kHz are errors.
    """
    listing = listed_files(spark, path, glob)
    if read_by_ranges(spark, path):
        return wav_headers_at(listing.select("path"), strict)
    return wav_headers_of(listing.select("path", "content"), strict)


def wav_headers_at(paths: DataFrame, strict: bool = True) -> DataFrame:
    """The same for a manifest of paths; a path that cannot be opened is an error row, one of an unknown scheme raises."""

    def read(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with _open(path) as f:
                        size = f.size()
                        rows.append(_header_row(path, lambda: f, size, strict))
                except (OSError, ValueError) as e:
                    rows.append({"path": path, **dict.fromkeys(["file_size", *_HEADER_FIELDS]), "error": str(e)})
            yield _as_frame(rows)

    return paths.select("path").mapInPandas(read, WAV_HEADER)


def wav_headers_of(files: DataFrame, strict: bool = True) -> DataFrame:
    """The same for a table ``path, content``."""

    def read(batches):
        for pdf in batches:
            yield _as_frame([
                _header_row(p, lambda c=c: io.BytesIO(c), len(c), strict) for p, c in zip(pdf["path"], pdf["content"])
            ])

    return files.select("path", "content").mapInPandas(read, WAV_HEADER)


def wav_corpus_profile(headers: DataFrame) -> DataFrame:
    """Files and hours per format and error."""
    return headers.groupBy("audio_format", "bits_per_sample", "error").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(_data_bytes() / (F.col("bits_per_sample") / 8) / F.col("sample_rate") / 3600).alias("hours"),
    )


def wav_properties(headers: DataFrame) -> DataFrame:
    """Rate, channels and duration per file from its header; what is missing becomes ``error``. Its two messages are fixed values."""
    frame_bytes = F.col("sample_rate") * F.col("channels") * F.col("bits_per_sample") / 8
    no_stream = F.col("sample_rate").isNull() | F.col("channels").isNull() | (F.col("channels") == 0)
    unknown = F.col("data_size").isNull() | (F.col("data_size") == 0)
    return headers.select(
        "path", "sample_rate", "channels",
        F.when(~no_stream & ~unknown, F.col("data_size") / frame_bytes).alias("duration_s"),
        F.when(no_stream, F.lit("No audio stream found in source"))
        .when(unknown, F.lit("Cannot determine audio duration")).alias("error"),
    )


def _data_bytes():
    """Usable bytes: the stated size, or up to the end of the file if that is 0 or too large."""
    rest = F.col("file_size") - F.col("data_offset")
    stated = F.col("data_size")
    return F.when((stated > 0) & (stated <= rest), stated).otherwise(rest)


def to_float(raw: bytes, audio_format: int, bits: int) -> np.ndarray:
    """Little-endian samples as 32-bit floats in [-1, 1); an incomplete last one is dropped."""
    kind = np.dtype("<f4") if audio_format == 3 else np.dtype(f"<i{bits // 8}")
    values = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], dtype=kind)
    if audio_format == 3:
        return values.astype(np.float32)
    return values.astype(np.float32) / np.float32(2 ** (bits - 1))


def _chunk_rows(path, samples: np.ndarray, start: int, rate: int, chunk: int) -> pd.DataFrame:
    cuts = range(0, len(samples), chunk)
    return pd.DataFrame({
        "stream_id": path,
        "chunk_seq": [(start + c) // chunk for c in cuts],
        "start_sample": [start + c for c in cuts],
        "rate": np.full(len(cuts), rate, dtype=np.int32),
        "samples": [samples[c:c + chunk] for c in cuts],
    })


def decode_pcm(
    headers: DataFrame, files: DataFrame | None = None,
    chunk_samples: int = TARGET_RATE, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Chunk rows of the files that have no error.

    Without ``files`` each byte range is read from the file system by the task that
    decodes it; with a table ``path, content`` the ranges are cut from its bytes.
    """
    good = headers.filter(F.col("error").isNull())
    width = (F.col("bits_per_sample") / 8).cast("long")
    step = F.greatest(F.floor(F.lit(range_bytes) / (width * chunk_samples)), F.lit(1)) * width * chunk_samples
    ranges = (
        good.withColumn("_bytes", _data_bytes()).withColumn("_step", step).filter("_bytes > 0")
        .withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_bytes") - 1, F.lit(0)), F.col("_step"))))
        .select(
            "path", "audio_format", "bits_per_sample", "sample_rate", "_at",
            (F.col("data_offset") + F.col("_at")).alias("_from"),
            F.least("_step", F.col("_bytes") - F.col("_at")).alias("_len"),
        )
    )
    if files is None:
        ranges = ranges.repartition("path", "_at")
    else:
        ranges = ranges.join(files.select("path", "content"), "path").withColumn(
            "raw", F.expr("substring(content, cast(_from as int) + 1, cast(_len as int))")
        ).drop("content")

    by_path = files is None

    def decode(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if by_path:
                    with _open(row.path) as f:
                        f.seek(row[5])
                        raw = f.read(row[6])
                else:
                    raw = bytes(row.raw)
                samples = to_float(raw, row.audio_format, row.bits_per_sample)
                start = row[4] // (row.bits_per_sample // 8)
                yield _chunk_rows(row.path, samples, start, row.sample_rate, chunk_samples)

    return ranges.mapInPandas(decode, SAMPLE_CHUNKS)


def pcm16(samples: np.ndarray, truncate: bool = False) -> bytes:
    """16-bit samples, scaled by 32768 and rounded, or by 32767 and truncated."""
    x = np.asarray(samples, dtype=np.float32)
    if truncate:
        return (np.clip(x, -1.0, 1.0) * np.float32(32767.0)).astype("<i2").tobytes()
    return np.clip(np.rint(x * np.float32(32768.0)), -32768, 32767).astype("<i2").tobytes()


def wav_bytes(samples: np.ndarray, rate: int, truncate: bool = False) -> bytes:
    """A mono 16-bit PCM file."""
    data = pcm16(samples, truncate)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16,
                       1, 1, rate, rate * 2, 2, 16, b"data", len(data))
    return head + data


def export_segments(named: DataFrame, rate: int = TARGET_RATE, truncate: bool = False) -> DataFrame:
    """Add ``wav``: the file of each segment, from its ``samples``."""

    @F.pandas_udf(T.BinaryType())
    def encode(samples: pd.Series) -> pd.Series:
        return pd.Series([wav_bytes(s, rate, truncate) for s in samples], dtype=object)

    return named.withColumn("wav", encode("samples")).drop("samples")


def write_segment_files(exported: DataFrame, folder: str) -> None:
    """Write ``folder/<stream>/<name>`` from the executors. ``folder`` is a URI they all reach."""

    def write(rows):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for row in rows:
            target = f"{root}/{row.stream_id}"
            system.create_dir(target, recursive=True)
            with system.open_output_stream(f"{target}/{row.name}") as out:
                out.write(bytes(row.wav))

    exported.select("stream_id", "name", "wav").foreachPartition(write)
