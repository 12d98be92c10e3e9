"""From raw documents to packed sequences: five stages, each a table of its own.

Rejected texts go, one document of each group of near-duplicates stays, documents that hold benchmark passages go, live secrets are
masked, and what is left is packed into sequences. All stages but the last return the columns of documents. A stage reads all rows of
the stage before from its table, so a lost executor costs no earlier stage.

An empty table passes through all stages; what a stage does with nulls, ties and repeated rows is told by its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import decontaminate, neardup, packing, quality, secrets
from flowloom.llm.common import table
from flowloom.llm.queries import tokenizer_path
from flowloom.session import shared_dir, temporary_stages


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learned weights, alignments and tokens are beyond SQL; tests hold every stage against step-by-step models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/flowloom-pipeline-{uuid.uuid4().hex}/{k}"
        with temporary_stages(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
