"""What the stages of the pipeline leave on disk."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from hearthline.llm import language_id
from hearthline.llm.common import stored, table
from hearthline.llm.decontamination import find_hits, remove_contaminated
from hearthline.llm.language_id import drop_rejected, identify
from hearthline.session import run_folder


def written(spark) -> int:
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(run_folder(spark)) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("stage", ["language_id", "decontamination"])
def test_stages_write_no_copy_of_the_documents(spark, monkeypatch, stage):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 5)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=4000)), "en" if k % 2 else "de", rng.randbytes(2000)) for k in range(200)]
    before = written(spark)
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, extra binary"), "test-docs")
    own, before = written(spark) - before, written(spark)
    benchmark = spark.createDataFrame([(1, " ".join(rows[0][1].split()[50:70]))], "item_id bigint, text string")
    left = drop_rejected(docs) if stage == "language_id" else remove_contaminated(docs, benchmark)
    assert left.count() in range(150, 200 + (stage == "language_id"))
    assert written(spark) - before < own / 4


def test_stages_keep_what_the_operators_let_pass(spark):
    docs = table(spark, SF, "documents").limit(150)
    odd = [(7001, None, "en", None, 0), (7002, "", None, None, 0), (7003, "... 12", "de", "key", 6), (None, "Съешь же ещё этих мягких", "en", "key", 24)]
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame(odd, docs.schema)).withColumn("key", F.col("source"))
    docs = stored(docs, "test-docs")
    benchmark = spark.createDataFrame([(1, " ".join(docs.where("n_chars > 500").first()["text"].split()[3:20]))], "item_id bigint, text string")
    for mine, theirs in (
        (drop_rejected(docs), identify(docs, docs.columns).where("NOT rejected").select("kept.*")),
        (remove_contaminated(docs, benchmark), find_hits(docs, benchmark, carry=docs.columns).where("NOT contaminated").select("kept.*")),
    ):
        assert mine.columns == docs.columns and 0 < mine.count() < docs.count()
        assert mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0
