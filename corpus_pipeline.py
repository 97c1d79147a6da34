"""A training-data pipeline over documents: five stages, each one operator of ledgerlake.llm.

In every stage null text is the empty text, repeated rows are judged like any other row, an empty table gives an empty
table, and extra columns of documents come along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm._common import crc_mod, discard, documents, materialise
from ledgerlake.llm.decontaminate import find_leaks
from ledgerlake.llm.jaccard_join import jaccard_components
from ledgerlake.llm.line_dedup import dedup_lines
from ledgerlake.llm.quality import score_quality
from ledgerlake.llm.sentencepiece_nbest import encode_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1; it learns from labels outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, labels, crc_mod(F.col("doc_id"), 3) != 1, keep=docs.columns)
    return scored.where("q_score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, but for their first occurrence; a document of which nothing is left goes."""
    out = dedup_lines(docs)
    return out.where((F.col("ld_chunks") == 0) | (F.length(F.trim("text")) > 0)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a five-word shingle similarity of 0.8 or more, the smallest doc_id stays."""
    groups = jaccard_components(docs, k=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return found.where("dc_n_hit = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, with its score and those of the runners-up; other columns end here."""
    out = encode_texts(docs, keep=["doc_id"])
    return out.select("doc_id", F.col("sp_ids").alias("ids"), F.col("sp_n_pieces").alias("n_pieces"), F.col("sp_score").alias("score"),
                      F.col("sp_scores").alias("nbest_scores"), F.col("sp_round_trip").alias("round_trip"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("encode", encode)]

#: The stages hold a trained network, hashing of lines and Viterbi search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if done is not None:
            discard(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
