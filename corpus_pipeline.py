"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``; the last returns what the token record files hold of each document.

Defined cases. Null ``doc_id``: such rows are judged like others by quality and decontamination (which go by text); of a
group of near duplicates one with an id stays if there is any; the mix treats all rows without an id alike; their token
records come first. Null and empty texts are rejected by quality; given to a later stage they are near duplicates of each
other only, are not contaminated, repeat as their source does and add no words, and have a record of the end id alone. Very long texts are
worked on in parts by quality and decontamination, as whole sets by near duplicates, and are one record. Ties and repeated
rows: quality and decontamination keep all copies, near duplicates one row, the mix takes rows of one id alike, and records
repeat. An empty table stays one. Further columns of any name pass unchanged through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.decontaminate import drop_contaminated
from lodestrata.llm.jaccard import keep_one_similar
from lodestrata.llm.mixing import mixed_rows
from lodestrata.llm.quality import keep_quality, trusted_ids
from lodestrata.llm.storage import stored, table
from lodestrata.llm.token_records import token_records


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_quality(docs, trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target has it."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token record files of all documents, read back. A worker remembers fewer pre-tokens than alone: executors still hold what earlier stages took."""
    import public_tokenizers

    return token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=300_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: No SQL can express the hashed likelihood ratio or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
