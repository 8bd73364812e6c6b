"""From raw documents to a training mix.

Each stage applies one operator to what the stage before it kept:

1. ``language_id``: documents whose language is rejected go (null texts and texts without a letter among them)
2. ``ngram_join``: of each group of near duplicates the document with the smallest id stays
3. ``decontamination``: documents with a benchmark passage go
4. ``secrets``: secrets are replaced by ``[secret]``; every document stays
5. ``mixing``: the documents that the mix takes, with their size, their source's size and target, the words taken and the
   shard of each time a document is taken; columns of ``documents`` with these names give way

Extra columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.common import stored, table
from hearthline.llm.decontamination import remove_contaminated
from hearthline.llm.language_id import drop_rejected
from hearthline.llm.mixing import mixed_documents
from hearthline.llm.ngram_join import keep_one
from hearthline.llm.secrets import redact_secrets

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

# Language models, MinHash and the order of draws over texts changed before are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
