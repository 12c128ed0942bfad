"""The corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go; lines that an earlier document has go; one document of each near-duplicate group
stays; sources are mixed to their target weights; what is left is encoded as pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapestream.llm import jaccard, lines, mixing, pieces, toxicity
from tapestream.llm.runtime import written
from tapestream.llm.text import word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; a null or empty text is scored by the bias alone. Without labelled texts all stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that earlier ones have; one of which no word is left goes. A null id or text and an empty text stay as they are.

    ``n_chars``, if the table has it, follows the text. What is left of a near copy is the text that no
    earlier document has; the next stage doesn't find it like anything any more.
    """
    out = lines.without_repeats(docs)
    changed = F.col("__removed") > 0
    out = out.where(~changed | (word_count(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of five-word shingles at 0.8 make.

    Rows without an id, and texts without words, stay. Ids are taken to name documents: rows that repeat
    an id stay or go together.
    """
    found = jaccard.jaccard_join(docs, width=5, percent=80)
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; a null source is one of its own."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes, ids_sha256 and round_trip of every document of the mix; a null or empty text has no pieces."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can't express the learned classifier nor the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
