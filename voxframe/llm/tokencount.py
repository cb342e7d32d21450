"""Token counts through a digest cache.

A count depends on two things only: the content and the tokenizer file. Both are named by
SHA-256 digests, and a table of (tokenizer, content) -> count serves as cache. Digests are
joined to it first; the texts of distinct contents without an entry, and only they, are shuffled and encoded, and their
counts are appended, so the next run over a grown corpus encodes what is new, and one over a known corpus moves no text at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import job_folder, written

CACHE_SCHEMA = "tokenizer string, content string, n_tokens bigint"
#: Digests that are few enough to go to all tasks (about 10 MB).
FEW_MISSES = 100_000
#: Texts handed to the library in one call, which bounds the ids in memory.
GROUP = 64

_LOADED: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of library kind and file: another file or library is another version."""
    kind = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(kind.encode() + b"\0" + f.read()).hexdigest()


def load_counter(path: str):
    """A function from a list of texts to a list of counts, loaded once per worker.

    ``.json`` files go to the tokenizers library, ``.model`` files to sentencepiece. Begin, end
    and special tokens are not added, nothing is cut or padded.
    """
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = lambda texts: [
                len(e) for e in tok.encode_batch(texts, add_special_tokens=False)
            ]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    return _LOADED[path]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = load_counter(path)
        for batch in batches:
            texts, counts = batch.column("text"), []
            for i in range(0, len(texts), GROUP):
                counts += count(texts.slice(i, GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"]
            )
    return run


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", limit: int = 4096
) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``cache`` names the folder of the cache table; None takes a new one. A null text counts as
    the empty text (0 bytes, 0 tokens if the tokenizer adds none). Every row is returned,
    repeated rows as often as they come; equal contents are encoded once. Columns of ``docs`` named like
    a result are replaced, all others are kept. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    cache = cache or job_folder(spark, "token-counts")
    version = tokenizer_digest(tokenizer)
    # The caller's columns travel in one struct, so none of them can clash with the names used here.
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("text"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("content"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Two runs at a time may both append a content: one row of each counts.
    stored = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
        .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))

    # Digests find what is missing, so a text travels only if its content has no count yet.
    missing = written(
        rows.select("content").distinct().join(stored.select("content"), "content", "left_anti"), "token-misses")
    n_missing = missing.count()
    if n_missing:
        texts = rows.select("content", "text")
        # Few misses are picked where the texts lie. Else copies meet on the map side before anything is joined: they are one row per task.
        if n_missing <= FEW_MISSES:
            misses = texts.join(F.broadcast(missing), "content", "left_semi").dropDuplicates(["content"])
        else:
            misses = texts.dropDuplicates(["content"]).join(missing, "content", "left_semi")
        (
            misses.mapInArrow(_count_batches(tokenizer), "content string, n_tokens bigint")
            .select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
            .write.mode("append").parquet(cache)
        )
        # A plan keeps the files that it listed when it was made.
        stored = (
            spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return (
        rows.drop("text").join(stored, "content", "left")
        .select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
