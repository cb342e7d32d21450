"""Sample chunks from any table, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.operators.ordering import index_rows


def read_samples(
    df: DataFrame, stream: str, samples: str, order: str, start: str | None = None, rate: int = 16000
) -> DataFrame:
    """Chunk rows from a table with one sample array per row; ``order`` is the chunk number."""
    columns = [
        F.col(stream).alias("stream_id"), F.col(order).cast("long").alias("chunk_seq"),
        *([F.col(start).cast("long").alias("start_sample")] if start else []),
        F.lit(rate).alias("rate"), F.col(samples).cast("array<float>").alias("samples"),
    ]
    return df.select(*columns)


def samples_by_value(chunks: DataFrame) -> DataFrame:
    """One row per sample with its position on the stream."""
    return chunks.select(
        "stream_id", "start_sample", F.posexplode("samples").alias("_i", "value")
    ).select("stream_id", (F.col("start_sample") + F.col("_i")).alias("sample_idx"), "value")


def read_values(
    df: DataFrame, stream: str, value: str, order_by: list[str], chunk_size: int = 16000, rate: int = 16000
) -> DataFrame:
    """Chunk rows from a table with one value per row, ordered by ``order_by`` within a stream."""
    placed = index_rows(
        df.select(F.col(stream).alias("stream_id"), F.col(value).cast("float").alias("_v"), *order_by),
        "stream_id", order_by, "_at",
    )
    return (
        placed.withColumn("chunk_seq", F.floor(F.col("_at") / chunk_size))
        .groupBy("stream_id", "chunk_seq")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"))
        .select(
            "stream_id", "chunk_seq", (F.col("chunk_seq") * chunk_size).alias("start_sample"),
            F.lit(rate).alias("rate"), F.transform("_s", lambda x: x["_v"]).alias("samples"),
        )
    )


def stream_samples(spark: SparkSession, path: str, schema, file_format: str = "parquet", **options) -> DataFrame:
    """Unbounded chunk rows from a folder (or any other stream source by ``file_format``)."""
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)
