"""Job manifests: validation as data, so one bad job does not stop the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe import dims


def is_url(source: Column) -> Column:
    test = F.lit(False)
    for prefix in dims.URL_PREFIXES:
        test = test | source.startswith(prefix)
    return test


def check_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``is_url`` and ``errors``, one message per broken rule.

    ``file_exists`` is optional; where it is missing or null the file is taken to exist.
    """
    backend = F.coalesce(F.col("backend"), F.lit("none"))
    exists = F.coalesce(F.col("file_exists"), F.lit(True)) if "file_exists" in jobs.columns else F.lit(True)
    backends = [b for b, *_ in dims.BACKEND_LIMITS]
    # Families that take no conditioning, and the one that takes no device.
    unconditioned = ("moonshine", "glm-asr", "glm-asr-mlx", "nvidia-whisper")
    # The messages are fixed values.
    rules = [
        (~is_url(F.col("source")) & ~exists, F.concat(F.lit("File does not exist: "), F.col("source"))),
        (F.col("duration_s").isNull(), F.lit(
            "Cannot determine audio duration. Live streams are not supported. "
            "Please provide a file or URL with fixed duration.")),
        (~backend.isin(*dict.fromkeys(backends)), F.concat(F.lit("Unsupported backend: "), backend)),
        ((backend == "moonshine") & F.col("language").isNull(),
         F.lit("--language is required for the moonshine backend")),
        (backend.isin(*unconditioned) & F.col("condition"),
         F.concat(F.lit("condition=True is not supported by the "), backend, F.lit(" backend"))),
        ((backend == "moonshine") & F.col("device").isNotNull(),
         F.lit("--device is not supported by the moonshine backend")),
    ]
    return jobs.withColumn("is_url", is_url(F.col("source"))).withColumn(
        "errors", F.array_compact(F.array(*[F.when(test, message) for test, message in rules]))
    )


def validate_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runnable jobs, and the rejected ones with their ``errors``."""
    checked = check_jobs(jobs)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
