"""Substring search over an inverted index of trigrams.

Every distinct text is folded once (lower case, without accents)
and cut into its distinct runs of three characters; the index is a table of
(trigram, key of a text) and one of (key of a text, key of a row), each committed as a whole and dealt into
partitions, so a search opens a few of them and reads the row groups of its trigrams. Rows with a text that has
all trigrams of the wanted text are candidates; the exact test runs on these rows only. Texts shorter than a trigram find
their candidates nowhere, so the caller tests all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.functions.exprs import strip_accents
from hearthline.operators.listings import text_search
from hearthline.operators.suggest import place_labels, suggest_from
from hearthline.session import cut_lineage
from hearthline.sources.manifest import CommittedTable

SCHEMA, ROWS_SCHEMA = "trigram string, key bigint, bucket int", "text bigint, key bigint, bucket int"
#: Partitions of the index, parts of each that are sorted apart, and trigrams of a text that are looked up at most: more of them hardly thin out the candidates.
BUCKETS, SPREAD, LOOKED_UP = 32, 8, 6
COLUMNS = ["title", "locality_text", "resolved_region_name", "location_region", "district", "municipality", "quarter"]


def folded(text: Column) -> Column:
    return strip_accents(F.lower(text))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a folded text."""

    def runs(one: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(one) - 2, F.lit(1)))
        return F.when(F.length(one) >= 3, F.array_distinct(F.transform(places, lambda k: F.substring(one, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))

    # the text is an argument of a function, so it is folded once and not for each of its characters
    return F.element_at(F.transform(F.array(text), runs), 1)


def bucket_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` of one ``by`` stand together, so a search skips the row groups of the others; a hot one is spread over tasks. Dealt by hash, because bounds would need all rows made twice."""
    rows = rows.withColumn("bucket", bucket_of(by))
    return rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("bucket", by, "key")


class TrigramIndex:
    """The index of one text table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table, self.rows = spark, CommittedTable(spark, path, SCHEMA, ("bucket",)), CommittedTable(spark, f"{path.rstrip('/')}/rows", ROWS_SCHEMA, ("bucket",))

    def build(self, rows: DataFrame, key: str, columns: list[str]) -> None:
        """Index the ``columns`` of ``rows``; a trigram does not reach from one column into the next. Many rows share a place name, so a text goes by its hash:
        two texts of one hash only add candidates."""
        found = cut_lineage(rows.select(F.col(key).cast("bigint").alias("key"), F.array_compact(F.array_distinct(F.array(*columns))).alias("texts")), "indexed-texts")
        each = found.select("key", F.explode("texts").alias("text"))
        self.rows.replace(dealt(each.select(F.xxhash64("text").alias("text"), "key"), "text"))
        texts = each.select("text").distinct()
        self.table.replace(dealt(texts.select(F.xxhash64("text").alias("key"), F.explode(trigrams(folded(F.col("text")))).alias("trigram")).select("trigram", "key"), "trigram"))

    def postings(self, text: str) -> DataFrame | None:
        """Index rows of the text's trigrams (some of them, if it has many); None if it has none."""
        words = self.spark.range(1).select(trigrams(folded(F.lit(text))).alias("t")).select(F.slice("t", 1, LOOKED_UP).alias("t"))
        wanted = words.select("t", F.transform("t", bucket_of).alias("b")).first()  # at most LOOKED_UP values
        if not wanted["t"]:
            return None
        return self.table.read().where(F.col("bucket").isin(sorted(set(wanted["b"]))) & F.col("trigram").isin(wanted["t"])).withColumn("of", F.lit(len(wanted["t"])))

    def candidates(self, text: str) -> DataFrame | None:
        """``key`` of the rows of which one text has all these trigrams; a row with several of them comes as often."""
        found = self.postings(text)
        if found is None:
            return None
        texts = found.groupBy("key").agg(F.count_distinct("trigram").alias("n"), F.max("of").alias("of")).where("n = of").select(F.col("key").alias("text"))
        return self.rows.read().join(texts.withColumn("bucket", bucket_of("text")), ["bucket", "text"], "left_semi").select("key")


def search_listings(index: TrigramIndex, joined: DataFrame, text: str) -> DataFrame:
    """Rows of ``joined`` (see ``joined_listings``) that contain ``text``: those that the index names, tested exactly."""
    found = index.candidates(text.strip())
    rows = joined if found is None else joined.join(found.withColumnRenamed("key", "found_key"), F.col("id") == F.col("found_key"), "left_semi")
    return rows.where(text_search(text))


class PlaceIndex:
    """Place names for suggestions, stored once with their trigrams; a suggestion reads neither listings nor places."""

    def __init__(self, spark: SparkSession, path: str):
        self.labels = CommittedTable(spark, f"{path}/labels", "key bigint, label string, source int")
        self.index = TrigramIndex(spark, f"{path}/trigrams")

    def build(self, listing: DataFrame, location: DataFrame, active_only: bool = True) -> None:
        named = place_labels(listing, location, active_only).withColumn("key", F.xxhash64("label", "source")).select("key", "label", "source")
        self.labels.replace(named)
        self.index.build(self.labels.read(), "key", ["label"])

    def suggest(self, query: str, limit: int = 15, kind_quota: int = 5) -> DataFrame:
        found, labels = self.index.candidates(query.strip()), self.labels.read()
        return suggest_from(labels if found is None else labels.join(found, "key", "left_semi"), query, limit, kind_quota)
