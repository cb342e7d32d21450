"""Fixed dimension tables. All rows are listed here, so their size is known and tiny."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Hard and soft limit in seconds per recognizer family and mode.
BACKEND_LIMITS = [
    ("whisper", "sub_timestamps", 60, 6.0),
    ("whisper", "no_sub_timestamps", 30, 6.0),
    ("nvidia-whisper", "any", 30, 6.0),
    ("moonshine", "streaming", 60, 6.0),
    ("moonshine", "non_streaming", 9, 6.0),
    ("qwen-asr-rs", "any", 60, 30.0),
    ("qwen-asr-mlx", "any", 60, 30.0),
    ("glm-asr", "any", 60, 30.0),
    ("glm-asr-mlx", "any", 60, 30.0),
]

# Default model names per family.
DEFAULT_MODELS = [
    ("whisper", "large-v3-turbo"),
    ("qwen-asr-mlx", "mlx-community/Qwen3-ASR-0.6B-bf16"),
    ("glm-asr", "zai-org/GLM-ASR-Nano-2512"),
    ("glm-asr-mlx", "mlx-community/GLM-ASR-Nano-2512-8bit"),
]

# Small-model registry as (language, scoped name, architecture number), in listed order.
SMALL_MODELS = [
    ("en", "medium-streaming", 5),
    ("en", "small-streaming", 4),
    ("en", "base", 1),
    ("en", "tiny-streaming", 2),
    ("en", "tiny", 0),
    ("zh", "base", 1),
    ("zh", "tiny", 0),
    ("es", "base", 1),
]
# Default models, where models lie, and the prefixes of sources that are not files.
DEFAULT_SMALL_MODEL = {"en": "small-streaming", "zh": "base", "es": "base"}
MODEL_HOST = "https://download.moonshine.ai/model"

# Language codes and names.
LANGUAGES = [
    ("zh", "Chinese"), ("en", "English"), ("yue", "Cantonese"), ("ar", "Arabic"), ("de", "German"),
    ("fr", "French"), ("es", "Spanish"), ("pt", "Portuguese"), ("id", "Indonesian"), ("it", "Italian"),
    ("ko", "Korean"), ("ru", "Russian"), ("th", "Thai"), ("vi", "Vietnamese"), ("ja", "Japanese"),
    ("tr", "Turkish"), ("hi", "Hindi"), ("ms", "Malay"), ("nl", "Dutch"), ("sv", "Swedish"),
    ("da", "Danish"), ("fi", "Finnish"), ("pl", "Polish"), ("cs", "Czech"), ("fil", "Filipino"),
    ("fa", "Persian"), ("el", "Greek"), ("ro", "Romanian"), ("hu", "Hungarian"), ("mk", "Macedonian"),
]

# Per-model language replacements, and the languages one family supports.
LANGUAGE_OVERRIDES = [("alvanlii/whisper-small-cantonese", "yue", "zh")]
GLM_MLX_LANGUAGES = ("zh", "en", "yue")

URL_PREFIXES = ("http://", "https://", "rtmp://", "rtsp://")


def listed(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of literal rows, planned as a local relation."""

    def literal(value):
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"{value}D"
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def backend_limits(spark: SparkSession) -> DataFrame:
    return listed(spark, BACKEND_LIMITS, "backend, mode, hard_s, soft_s")


def languages(spark: SparkSession) -> DataFrame:
    return listed(spark, LANGUAGES, "code, name")


def model_registry(spark: SparkSession) -> DataFrame:
    limits = {mode: (hard, soft) for family, mode, hard, soft in BACKEND_LIMITS if family == "moonshine"}
    rows = []
    for language, scoped, arch in SMALL_MODELS:
        streaming = scoped.endswith("-streaming")
        full = f"{scoped}-{language}"
        url = f"{MODEL_HOST}/{full}/quantized" + ("" if streaming else f"/{full}")
        hard, soft = limits["streaming" if streaming else "non_streaming"]
        rows.append((language, scoped, full, arch, streaming, url, hard, soft,
                     DEFAULT_SMALL_MODEL[language] == scoped))
    return listed(
        spark, rows, "language, scoped, model_name, arch, streaming, url, hard_s, soft_s, is_default"
    )


def listed_models(language: str) -> str:
    return ", ".join(scoped for code, scoped, _ in SMALL_MODELS if code == language)
