"""A corpus pipeline of five stages over `documents`; each stage is written as Parquet and read again.

Defined cases: extra columns of documents pass all stages but the last; a null text is empty to every
stage (it is kept as null, links with other empty texts, and gets null ids); rows of a null doc_id are
never trained on and of a group stay only if no other row has a key; repeated rows are near copies, of
which one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaverlake.llm import decontaminate, pii, simhash, toxicity, unigram
from quaverlake.llm.common import discard, materialize, owned, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows among docs."""
    return toxicity.drop_toxic(docs, docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go."""
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts become [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", _length())


def _length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    return unigram.encode(docs, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others wrote. What a stage leaves in the shared folder goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with owned():
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", kept=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
