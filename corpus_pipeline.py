"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm.common import Scratch, Stages, table
from lakewarden.llm.exact_dedup import drop_exact_copies
from lakewarden.llm.mixing import mix
from lakewarden.llm.near_copies import drop_near_copies
from lakewarden.llm.packing import pack
from lakewarden.llm.quality_classifier import drop_low_quality

#: A stage is called on the written result of the one before, whose own tables it deletes.
stage = Stages()


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    return drop_near_copies(docs, shingle=5)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's share of the mix asks for."""
    return mix(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: one row per piece of a document."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

#: Training, fingerprints, rounding and packing are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        after = scratch.keep(apply(spark, docs, sf_dir))
        if i:
            scratch.drop(docs)
        docs = after
    stage.clear(spark)
    return docs
