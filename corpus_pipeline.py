"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of
``documents``: toxic documents go, one document of each near-duplicate group stays, documents that contain a
benchmark item go, personal data is replaced in the texts, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm import decontaminate, near_dedup, packing, pii, toxicity
from jadwal.llm.common import table, written


def unused(name: str, docs: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches their language's threshold; rows without text stay."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, flag = unused("toxicity", docs), unused("toxic", docs)
    scored = toxicity.score_documents(docs, net, score=score, flag=flag)
    return scored.where(~F.col(flag) | F.col("text").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without all but the smallest doc_id of each group: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data in the texts replaced by its kind."""
    return pii.redact_documents(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece, with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The first and the fourth stage are trained models, so there is no SQL for the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{i}-{name}") if i + 1 < len(STAGES) else out
    return docs
