"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages, rows are written as Parquet in the shared folder and read again; the
table of a stage is deleted when that of the next one is written.

Defined cases, of all stages in a row: documents without a letter (null, empty and blank texts, too) go at the second
stage; rows with a null doc_id stay where they are clean, as no other row can name them; of repeated rows and ids one stays
after the third stage; a very long text goes through whole and is many pieces at the end; ties are settled as each
operator's docstring says; extra columns travel with their rows up to the last stage, whatever their names; an empty table
gives no rows. Without labels the first stage keeps all, and without benchmark items the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runfield.llm import decontaminate, language_id, minhash_dedup, packing, quality_classifier
from runfield.llm.common import table
from runfield.sources.shared import removed, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the documents labelled good; what the Gumbel top-k leaves out goes."""
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language with enough certainty, go."""
    return language_id.identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id stays."""
    return minhash_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Models, hashes and tokenizers have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            removed(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
