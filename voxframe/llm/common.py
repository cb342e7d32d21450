"""Shared helpers: tables in the folder all executors share, word rules, files by URI."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOCAL: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) may do without the setting; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="voxframe-llm-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_job_folders(spark: SparkSession) -> None:
    """Delete what this application's operators have written for themselves, when their results are no longer read.

    Tables that operators return may lie there, so this is for the end of a job.
    """
    base = job_folder(spark, "x").rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Names that the file reader has for schemes of Spark.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = job_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def filesystem(uri: str):
    """(file system, path) of a URI or a plain path, for files written inside tasks."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    scheme, _, rest = uri.partition("://")
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, data) -> str:
    """Write bytes under a private name, then move them into place; a repeated task does no harm.

    ``data`` is one bytes-like object or a list of them.
    """
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in data if isinstance(data, list) else [data]:
            out.write(part)
    store.move(draft, f"{base}/{name}")
    return f"{folder}/{name}"
