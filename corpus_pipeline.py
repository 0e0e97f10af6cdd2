"""From raw documents to packed sequences: the stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import documents, kept
from assayer.llm.decontamination import find
from assayer.llm.near_dup import link
from assayer.llm.packing import pack
from assayer.llm.substrings import remove_repeats
from assayer.llm.weak_labels import classify

# Passages of so many words that repeat are removed.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as junk or toxic go."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles connect, the one with the smallest doc_id stays."""
    # A node that goes is named by its id; ids are written once, so that their number is known to the planner.
    gone = kept(link(docs).filter("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all texts but the first; a text of which nothing stays goes."""
    found = remove_repeats(docs, PASSAGE)
    stays = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))
    changed = {"text": F.col("cut_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("cut_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.filter(stays).select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("matches") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences along the curve."""
    return pack(docs).drop("ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]
# Classifiers, signatures and tokenizers aren't SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = kept(docs)
    return docs
