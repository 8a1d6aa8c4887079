"""The corpus pipeline: documents to packed sequences, each stage on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orogrid.llm.common import released, saved, table
from orogrid.llm.dedup_exact import deduplicated
from orogrid.llm.minhash import near_deduplicated
from orogrid.llm.mixing import mixed_documents
from orogrid.llm.packing import packed
from orogrid.llm.queries import TOXIC_FROM, tokenizer_path
from orogrid.llm.toxicity import fit, training_rows, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the labelled documents that are not held out.

    Null and empty texts have the score of no evidence, repeated rows one each; without toxic or clean labelled rows all texts score alike. Other columns stay.
    """
    with released(spark):
        model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return without_toxic(docs, model, TOXIC_FROM)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; null counts as the empty text. ``deduplicated`` states nulls and ties."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest doc_id stays; null and empty texts stay. ``near_deduplicated`` states nulls and ties."""
    return near_deduplicated(docs, 0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in mixture order; those of sources short of their weight come again, none goes. A null source is a source, null ids and repeated rows are rows like others."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; a null or empty text is its end id alone, repeated rows give their pieces again."""
    return packed(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: The stages score with a trained model, hash and search, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "_"))
    return docs
