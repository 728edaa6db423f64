"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Counted as part of the subpackage ``llm``. Each stage decides on all that its predecessor kept; all but the last return the
columns of ``documents``. Null columns, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import pfair_mixing, pii_bootstrap, piece_fst, simhash_dedup, toxicity_grammar
from quillmesh.llm.common import table
from quillmesh.sources.scratch import folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity_grammar.accepted(docs, toxicity_grammar.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of similarity 0.8 in five-word shingles stays: the one of smallest id."""
    return simhash_dedup.deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows."""
    return pii_bootstrap.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of sources: written, the files and the rows in them stand in that order."""
    return pfair_mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, with its place in the mix: mix_part, the name of the file that the mixing stage wrote, and mix_row, the row in it.

    Files are read by size, so the rows of the result come in any order; (mix_part, mix_row) is the order of the mix, since Spark numbers the files of a sorted frame by its partitions.
    """
    place = [F.col("_metadata.file_name").alias("mix_part"), F.col("_metadata.row_index").alias("mix_row")]
    return piece_fst.encode_column(docs.select("doc_id", "source", "lang", *place, "text"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("pieces", pieces)]

#: Fitted grammars, fingerprints and merges by score are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` under ``sf_dir``; what they write goes to the shared folder of spark.checkpoint.dir."""
    out, docs = folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
