"""A corpus pipeline of five stages over ``documents``: toxicity, quality, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet to the
shared folder and reads it again as the next one's ``docs``. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import pareto, quality, sentencepiece_lattice, superminhash, toxicity
from voxframe.llm.common import read_table, written

#: SQL cannot express the nearest-example votes and the near-duplicate groups; tests/llm holds run() against a plain version.
ORACLE_SQL = None

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not vote to be toxic."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with the lines that pass; n_chars follows the text."""
    kept = quality.judge_quality(docs).filter("kept")
    return kept.withColumns({"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity of at least 0.8."""
    return superminhash.keep_one(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = pareto.mix(docs).filter("copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document as the library gives them (little-endian unsigned 32-bit integers), and whether they decode to its text."""
    return sentencepiece_lattice.encode(docs.select("doc_id", "lang", "source", "text"), PIECES, merges=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", clean_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, round_trip) of the documents that the stages leave."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
