"""Per-row signal functions on sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The detector's native rate, its two window sizes and its default threshold.
TARGET_RATE = 16000
WINDOW_AT_TARGET = 512
WINDOW_ELSEWHERE = 256
SPEECH_THRESHOLD = 0.5


def window_size(rate: Column) -> Column:
    return F.when(rate == TARGET_RATE, WINDOW_AT_TARGET).otherwise(WINDOW_ELSEWHERE)


def window_size_for(rate: int) -> int:
    return WINDOW_AT_TARGET if rate == TARGET_RATE else WINDOW_ELSEWHERE


def downmix(samples: Column, channels: int) -> Column:
    """Mean over interleaved channels; an incomplete last frame is dropped."""
    if channels == 1:
        return samples
    frames = F.floor(F.size(samples) / channels).cast("int")
    mixed = F.transform(
        F.sequence(F.lit(0), frames - 1),
        lambda i: (
            F.aggregate(
                F.slice(samples, i * channels + 1, F.lit(channels)),
                F.lit(0.0).cast("double"),
                lambda acc, x: acc + x,
            )
            / channels
        ).cast("float"),
    )
    return F.when(frames > 0, mixed).otherwise(F.array().cast("array<float>"))


def quantize_pcm16(samples: Column) -> Column:
    """Clip to [-1, 1], scale by 32767 in single precision, truncate to 16 bits."""
    one = F.lit(1.0).cast("float")
    return F.transform(
        samples,
        lambda x: (F.greatest(-one, F.least(one, x.cast("float"))) * F.lit(32767.0).cast("float")).cast("smallint"),
    )


def rms(samples: Column) -> Column:
    """Root mean square: a stand-in window score."""
    total = F.aggregate(
        samples, F.lit(0.0).cast("double"),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
    )
    return F.sqrt(total / F.size(samples))


def flag_speech(prob: Column, threshold: float = SPEECH_THRESHOLD) -> Column:
    return prob > threshold
