"""A training-data pipeline over ``documents``: reject low quality, drop site boilerplate, keep one of each near-duplicate
group, mix the sources, and encode.  Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabforge.llm import bpe, line_dedup, mixing, quality, simhash
from tabforge.llm.common import table
from tabforge.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3; the model is fitted on labelled rows of the pipeline's own input."""
    scored = quality.fit(docs, table(spark, sf_dir, "labels")).score(docs.select(*docs.columns))
    return scored.where("predicted = 1").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that its source repeats.  A document that would lose every line is a copy of others and
    goes on whole: emptied, all such groups would be one to the next stage, which would keep none of their texts."""
    return line_dedup.dedup_lines(docs, keep_whole=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within three bits."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, at least once."""
    return mixing.mix(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the text decoded from them."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup_stage), ("simhash near-dedup", near_dedup),
          ("source mixing", source_mixing), ("byte-level bpe", byte_bpe)]

#: the classifier and the fingerprints are beyond SQL; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; each stage is written to the shared scratch folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
