"""Every operator and stage on odd rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from hearthline.llm.common import table
from hearthline.llm.decontamination import find_hits, remove_contaminated
from hearthline.llm.language_id import drop_rejected, identify
from hearthline.llm.licenses import find_licenses
from hearthline.llm.mixing import MIXED, mix
from hearthline.llm.ngram_join import keep_one, near_duplicates
from hearthline.llm.quality_rules import judge
from hearthline.llm.resampling import resample
from hearthline.llm.secrets import find_secrets, redact_secrets
from hearthline.llm.substring_dedup import remove_repeated

LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(60_000))


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, ties, repeated rows and extra columns whose names operators use inside."""
    extra = "row string, words string, kept string, spans string, size bigint, n bigint, stratum string, clean string, block bigint, shard int, target double, bands string, hash bigint, _id string, _text_hash string, id bigint, tie int, shards int, turn int, at bigint, name string, number int, line int, hits int, run string, first int"
    rows = [
        (1, "Plain words stand here, one after the other, and nothing else happens in them.", "en", "a"),
        (1, "Plain words stand here, one after the other, and nothing else happens in them.", "en", "a"),
        (2, "Plain words stand here, one after the other, and nothing else happens in them.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "de", "b"), (6, "...", "de", ""), (None, "A text without id, which has some words nevertheless.", "en", None),
        (None, None, None, None), (7, LONG, "en", "b"), (8, "é\u0000ß İ \U0001f600 ok", "fr", "ä"), (9, "x", "en", "Z"),
        (10, "MIT licence text follows.\nReleased under the MIT License.\nSome prose.\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.", "en", "a"),
        (11, "\u0301\u0302 \u0301", "en", "a"),
    ]
    rows = [(*r, 0 if r[1] is None else len(r[1]), "r", "w", "k", "s", 1, 2, "t", "c", 3, 4, 5.0, "b", 6, "i", "h", 7, 8, 9, 10, 11, "n", 12, 13, 14, "u", 15) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + extra)



def operators(spark):
    benchmark = table(spark, SF, "benchmark")
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 0), (None, 1, 0), (9, None, 0)], LABELS)
    return {
        "licenses": find_licenses, "mix": mix, "hits": lambda d: find_hits(d, benchmark), "dedup": remove_repeated, "rules": lambda d: judge(d, labels),
        "language": identify, "resample": lambda d: resample(d, labels), "near": near_duplicates, "secrets": find_secrets,
    }


NAMES = ["licenses", "mix", "hits", "dedup", "rules", "language", "resample", "near", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_a_result_for_every_odd_row(spark, odd, name):
    out = operators(spark)[name](odd)
    assert sorted((r[0] for r in out.select("doc_id").collect()), key=str) == sorted((r[0] for r in odd.select("doc_id").collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    assert operators(spark)[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "mixing"], ids=lambda s: s[0])
def test_stages_keep_the_columns(spark, odd, stage):
    out = stage[1](spark, odd, SF)
    assert out.columns == odd.columns and out.schema["text"].dataType == odd.schema["text"].dataType
    assert out.count() <= odd.count()
    assert stage[1](spark, odd.limit(0), SF).count() == 0


def test_mixing_stage(spark, odd):
    out = corpus_pipeline.mixing(spark, odd, SF)
    assert out.columns == [c for c in odd.columns if c not in MIXED] + MIXED
    assert all(r.taken == r["size"] * len(r.shards) > 0 for r in out.collect())


def test_defined_results(spark, odd):
    near = {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (None, None, 0)} <= near
    assert sorted(str(r.doc_id) for r in keep_one(odd).collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "11", "None", "None"])
    languages = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in identify(odd).collect()}
    assert languages[3] == languages[4] == languages[6] == languages[11] == ("und", 0.0, True)
    assert 3 not in {r.doc_id for r in drop_rejected(odd).collect()}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated(odd).where("doc_id IS NOT NULL").collect()}
    assert removed[1] == (14, 0) and removed[2] == (14, 14) and removed[3] == (0, 0) and removed[7] == (60_000, 0)
    kept = {r.doc_id: r.kept for r in judge(odd, spark.createDataFrame([], LABELS)).collect()}
    assert not kept[3] and not kept[9] and kept[7]
    assert {r.doc_id: r.sampled for r in resample(odd, spark.createDataFrame([], LABELS)).where("doc_id IN (1, 3, 4, 9)").collect()} == {1: True, 3: False, 4: False, 9: False}


def test_empty_benchmark_hits_nothing(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_hits(odd, none).where("contaminated").count() == 0
    null = spark.createDataFrame([(1, None), (None, "..."), (None, "x")], "item_id bigint, text string")
    hits = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in find_hits(odd, null).collect()}
    assert hits[9] == (1, 1, True) and hits[4] == (0, 0, False)


def test_redaction_and_spans(spark):
    docs = spark.createDataFrame([(1, 'see token = "abcdef123456" here', 31), (2, None, 0), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in redact_secrets(docs).collect()}
    assert out == {1: ('see [secret]" here', 18), 2: (None, 0), 3: ("clean", 5)}
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! After"), (2, "nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    assert {r.doc_id: r.text for r in remove_contaminated(docs, bench, remove="spans").collect()} == {1: "Before! After", 2: "nothing here"}
    assert [r.doc_id for r in remove_contaminated(docs, bench).collect()] == [2]


def test_hash_set_in_slices(spark):
    """A benchmark of more windows than one broadcast holds gives the same hits; no words and no documents are broadcast or keyed by null."""
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    a = find_hits(docs, bench).select("doc_id", "n_words", "n_hit", "items_sha256")
    b = find_hits(docs, bench, slice_windows=150).select("doc_id", "n_words", "n_hit", "items_sha256")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.where("n_hit > 0").count() > 0


def test_rows_without_id_come_near_their_targets(spark):
    docs = table(spark, SF, "documents").withColumn("doc_id", F.lit(None).cast("bigint"))
    docs = docs.unionByName(spark.range(60).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the very same words again").alias("text"), F.lit("en").alias("lang"), F.lit("copies").alias("source"), F.lit(25).cast("bigint").alias("n_chars")))
    rows = mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("own"), F.max("source_size").alias("source_size")).collect()
    assert all(abs(r.taken - r.target) <= r.most and r.own == r.source_size for r in rows) and "copies" in {r.source for r in rows}
    one, two = (mix(d).groupBy("source", "size", "taken").count().collect() for d in (docs, docs.repartition(5)))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_pipeline_stages_act(spark):
    docs = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark").limit(1)
    text = bench.first()["text"]
    extra = spark.createDataFrame([(10_001, f"Some words before. {text} Some words after.", "en", "src0", 1)], docs.schema)
    after = corpus_pipeline.decontamination(spark, docs.unionByName(extra), SF)
    assert 10_001 not in {r.doc_id for r in after.select("doc_id").collect()}
    assert after.join(docs, "doc_id").count() > 0.9 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    per_source = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.t - r.target) <= r.most for r in per_source)
    assert out.where("taken > 3 * size").count() == 0
