"""Dimension joins on job manifests, and token decoding.

The dimensions of ``voxframe.dims`` are listed in code, so broadcasting them is safe. The
vocabulary is a caller's table of unknown size: its join carries no hint, and adaptive
execution broadcasts it only if its measured size allows, or splits skewed keys if not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe import dims
from voxframe.functions.text import strip
from voxframe.session import materialize


def with_limits(jobs: DataFrame) -> DataFrame:
    """Add ``mode, hard_s, soft_s`` from ``backend``, ``sub_timestamps`` and ``streaming``.

    A job without a match keeps its row with ``limit_error`` set.
    """
    mode = (
        F.when(F.col("backend") == "whisper", F.when(
            F.coalesce("sub_timestamps", F.lit(True)), "sub_timestamps").otherwise("no_sub_timestamps"))
        .when(F.col("backend") == "moonshine", F.when(
            F.col("streaming"), "streaming").otherwise("non_streaming"))
        .otherwise("any")
    )
    limits = F.broadcast(dims.backend_limits(jobs.sparkSession))
    return jobs.withColumn("mode", mode).join(limits, ["backend", "mode"], "left").withColumn(
        "limit_error",
        F.when(F.col("hard_s").isNull(), F.concat(F.lit("Unsupported backend: "), F.coalesce(F.col("backend"), F.lit("none")))),
    )


def resolve_models(jobs: DataFrame) -> DataFrame:
    """Add the resolved model of each job, or ``model_error`` listing the choices.

    Small models are looked up by lower-cased language and name after removing the
    language suffix of the registry's names; other families get their default name, and
    short names of one family are completed.
    """
    spark = jobs.sparkSession
    registry = dims.model_registry(spark).withColumnRenamed("language", "_lang")
    default = registry.filter("is_default").select("_lang", F.col("scoped").alias("_default"))
    known = dims.listed(
        spark,
        [(code, dims.listed_models(code)) for code in dict.fromkeys(c for c, _, _ in dims.SMALL_MODELS)],
        "_lang, _choices",
    )
    family = dims.listed(spark, dims.DEFAULT_MODELS, "backend, _family_default")
    small = F.col("backend") == "moonshine"
    entries = registry.select(
        "_lang", F.col("scoped").alias("_wanted"), "model_name", "arch", "streaming", "url"
    )
    joined = (
        jobs.withColumn("_lang", F.when(small, F.lower("language")))
        .join(F.broadcast(default), "_lang", "left")
        .withColumn("_wanted", F.when(small, F.lower(F.coalesce("model", "_default"))))
        .join(F.broadcast(entries), ["_lang", "_wanted"], "left")
        .join(F.broadcast(known), "_lang", "left")
        .join(F.broadcast(family), "backend", "left")
    )
    given = F.coalesce("model", "_family_default")
    whisper = F.when(given.contains("/"), given).otherwise(F.concat(F.lit("openai/whisper-"), given))
    languages = ", ".join(dict.fromkeys(code for code, _, _ in dims.SMALL_MODELS))
    error = F.when(small & F.col("_choices").isNull(), F.concat(
        F.lit("Unknown language: "), F.coalesce("_lang", F.lit("")), F.lit(f". Available: {languages}"),
    )).when(small & F.col("model_name").isNull(), F.concat(
        F.lit("Unknown model for language "), F.col("_lang"), F.lit(": "), F.col("_wanted"),
        F.lit(". Available: "), F.col("_choices"),
    ))
    return joined.select(
        *jobs.columns,
        F.when(small, F.col("model_name")).when(F.col("backend") == "whisper", whisper).otherwise(given)
        .alias("resolved_model"),
        "arch", "streaming", "url", error.alias("model_error"),
    )


def map_languages(jobs: DataFrame) -> DataFrame:
    """Add what each family is told about the language.

    ``language_param`` is the value passed on, ``prompt`` the request text of one family,
    ``language_warning`` marks languages outside a family's support and ``language_error``
    unknown codes.
    """
    spark = jobs.sparkSession
    names = dims.languages(spark).select(F.col("code").alias("language"), F.col("name").alias("_name"))
    override = dims.listed(spark, dims.LANGUAGE_OVERRIDES, "model, language, _override")
    backend, language = F.col("backend"), F.col("language")
    given = F.when(language != "", language)
    by_name = backend.isin("qwen-asr-rs", "qwen-asr-mlx", "glm-asr")
    # An empty code counts as not given, but for one family it is an unknown code.
    asked = F.when(backend == "glm-asr", language).otherwise(given)
    available = ", ".join(code for code, _ in dims.LANGUAGES)
    joined = (
        jobs.join(F.broadcast(names), "language", "left")
        .join(F.broadcast(override), ["model", "language"], "left")
    )
    return joined.select(
        *jobs.columns,
        F.when(by_name, F.col("_name"))
        .when(backend == "whisper", F.coalesce(F.col("_override"), given))
        .when(backend == "nvidia-whisper", F.coalesce(given, F.lit("multi")))
        .when(backend == "moonshine", F.lower(language))
        .alias("language_param"),
        F.when(
            (backend == "glm-asr") & F.col("_name").isNotNull(),
            F.concat(F.lit("Transcribe the input speech in "), F.col("_name"), F.lit(".")),
        ).alias("prompt"),
        F.coalesce(
            (backend == "glm-asr-mlx") & ~language.isin(*dims.GLM_MLX_LANGUAGES), F.lit(False)
        ).alias("language_warning"),
        F.when(by_name & asked.isNotNull() & F.col("_name").isNull(), F.concat(
            F.lit("Unrecognized language code '"), language, F.lit(f"'. Available: {available}"),
        )).alias("language_error"),
    )


def detokenize(tokens: DataFrame, vocab: DataFrame, key: str = "stream_id") -> DataFrame:
    """Text of each row of ``key, tokens``; rows of one key stay apart.

    Ids outside the vocabulary and tokens of the form ``<...>`` are skipped; the rest are
    joined as bytes, decoded with replacement, word marks become spaces. A null array has the empty text. The rows are numbered in a
    table of their own, so that their tokens meet again by row, in one shuffle.
    """
    text_like = F.decode(F.col("token"), "ISO-8859-1")
    special = (F.octet_length("token") >= 2) & text_like.startswith("<") & text_like.endswith(">")
    known = vocab.filter(F.col("token").isNotNull() & ~special).select("token_id", F.hex("token").alias("_hex"))
    numbered = materialize(tokens.select(key, "tokens", F.monotonically_increasing_id().alias("_row")))
    placed = numbered.select(key, "_row", F.posexplode_outer("tokens").alias("_pos", "token_id"))
    texts = placed.join(known, "token_id", "left").groupBy("_row").agg(
        F.first(key).alias(key),
        F.array_sort(F.collect_list(F.when(F.col("_hex").isNotNull(), F.struct("_pos", "_hex")))).alias("_t"))
    data = F.unhex(F.array_join(F.transform("_t", lambda t: t["_hex"]), ""))
    text = strip(F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\u2581"), F.lit(" ")))
    return texts.select(key, F.coalesce(text, F.lit("")).alias("text"))
