"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framesift.llm.decontaminate import find_leaks, without_leaks
from framesift.llm.packing import pack_power_of_two
from framesift.llm.personal import fit, redact
from framesift.llm.quality import quality
from framesift.llm.queries import packed_digests, table, tokenizer_path
from framesift.llm.wide import without_near_duplicates
from framesift.llm.words import without_rows
from framesift.plans.shared import write_shared


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 7).

    Null and blank texts are rejected; without labels of both kinds every text with words stays; repeated rows share their
    fate; rows with a null doc_id, source or lang are judged like any other; other columns are carried whatever their names.
    """
    found = quality(docs, table(spark, sf_dir, "labels"))
    return without_rows(docs, write_shared(found.where("NOT keep").select("row", "row2").distinct(), "rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a resemblance of 0.8 or more over five-word shingles (operator 9): that of the smallest doc_id.

    Rows with a null doc_id always stay; rows that repeat a doc_id are one document; blank texts are one group.
    """
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 6); null and blank texts hold none, and an empty benchmark drops nothing."""
    return without_leaks(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind (operator 2) and n_chars renewed; null texts stay null."""
    return redact(docs, fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents (operator 10); a null or empty text is one piece of the end id."""
    return packed_digests(pack_power_of_two(docs, tokenizer_path()))


STAGES = [
    ("quality", keep_good),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trained weights, alignment and tokenisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
