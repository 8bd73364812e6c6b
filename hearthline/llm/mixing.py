"""Mixing sources to target weights (operator 2). DataFrame functions only.

Every source is dealt into blocks by a hash of the document. A source gives
as many whole passes as fit its target and, of a last pass, blocks in
permuted order as long as they fit, and of the smallest block left over
documents in permuted order. The blocks of all sources are shared among the
output shards by a splitting tree: each node halves its shards and draws how
many blocks of each source go left as from an urn without putting back
(multivariate hypergeometric), so shard sizes are exact in blocks and each
source spreads at random. A source's permuted blocks are then handed out in
order, each to one shard. The shards are written: a shuffle deals the documents out at random, and every file of a
shard is in random order. What the mix has taken is counted from the files.

All draws come from hashes of (seed, source, pass, block), so reruns agree.

* null text has size 0; documents of size 0 are never taken
* a null source is a source of its own, after all others
* rows are known by id, text and, where these are equal, by their number among the equal rows of a source; null and repeated ids are no exception
* sources whose size is 0 have target 0; without any word nothing is taken
* extra columns stand in a struct of their own in the shards, whatever their names; an empty table gives an empty result
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from hearthline.session import shared_folder

from .common import discard, shuffle_files_removed, stored

BLOCKS = 1024  # per source: a boundary block holds a thousandth of a source
SHARDS = 16
MOST_PASSES = 3
MIXED = ["size", "source_size", "target", "taken", "shards"]
FILLS = 4  # rounds in which blocks that still fit are looked for


def text_size(text: Column) -> Column:
    """Number of words: pieces between blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("bigint")


def draw(*parts: Column | str) -> Column:
    """Pseudo-random integer below 2^52 from the given values; the same in every SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code-point order weigh ``weights``, repeating. All share the
    total by weight; nobody gets more than ``most`` times its size, and what is
    over goes to the others by weight. In order of size / weight the first
    sources are held back, so one running sum finds the common factor.
    """
    total = Window.partitionBy()
    sizes = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sizes = sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights)).cast("bigint")).withColumn("bound", F.col("source_size") * most)
    tight = Window.orderBy((F.col("bound") / F.col("weight")).asc(), "place")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("spent", F.coalesce(F.sum("bound").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sizes = sizes.withColumn("factor", (F.sum("source_size").over(total) - F.col("spent")) / F.col("open")).withColumn("free", F.col("bound") >= F.col("factor") * F.col("weight"))
    common = F.min(F.when(F.col("free"), F.struct("spent", "factor"))).over(total)["factor"]
    return sizes.select("source", "source_size", "place", F.coalesce(F.least(F.col("bound").cast("double"), common * F.col("weight")), F.lit(0.0)).alias("target"))


def draw_source(seed: str, level: int):
    """Step of a multivariate hypergeometric draw: of one source's blocks in the urn, how many go left."""

    def step(acc: Column, x: Column) -> Column:
        def one(a: Column, j: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["place"], j), F.lit(1 << 30)) / float(1 << 30)
            left = F.when(u * a["n"] < a["left"], 1).otherwise(0).cast("bigint")
            return F.struct((a["n"] - 1).alias("n"), (a["left"] - left).alias("left"), (a["got"] + left).alias("got"))

        urn = F.struct(acc["n"].alias("n"), acc["left"].alias("left"), F.lit(0).cast("bigint").alias("got"))
        done = F.when(x["k"] > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(x["k"], F.lit(1).cast("bigint"))), urn, one)).otherwise(urn)
        return F.aggregate(F.array(done), acc, lambda a, d: F.struct(d["n"].alias("n"), d["left"].alias("left"), F.concat(a["taken"], F.array(d["got"])).alias("taken")))

    return step


def shard_quotas(blocks: DataFrame, shards: int, seed: str) -> DataFrame:
    """Splitting tree over ``place, blocks`` (blocks that each source gives): ``place, ends``, where
    ``ends[s]`` blocks of the source go to shards 0 to s."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = blocks.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", F.col("blocks").cast("bigint").alias("k")))).alias("urn")).select(F.lit(0).alias("node"), "urn")
    levels = shards.bit_length() - 1
    for level in range(levels):
        held = F.aggregate("urn", F.lit(0).cast("bigint"), lambda a, x: a + x["k"])
        nodes = nodes.withColumn("all", held)
        # blocks go to 2^(levels - level) shards, sizes differing by one at most; the left half gets the larger share
        start = F.struct(F.col("all").alias("n"), F.ceil(F.col("all") / 2).alias("left"), F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("taken"))
        nodes = nodes.withColumn("taken", F.aggregate("urn", start, draw_source(seed, level))["taken"])
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("urn", "taken", lambda x, t: F.struct(x["place"].alias("place"), t.alias("k"))).alias("urn")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("urn", "taken", lambda x, t: F.struct(x["place"].alias("place"), (x["k"] - t).alias("k"))).alias("urn")),
        )
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.*")
    flat = nodes.select("node", F.explode("urn").alias("x")).select("node", F.col("x.place").alias("place"), F.col("x.k").alias("k"))
    ends = flat.withColumn("end", F.sum("k").over(Window.partitionBy("place").orderBy("node")))
    return ends.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def fill(blocks: DataFrame, rounds: int) -> DataFrame:
    """Adds ``part`` (all, some or none of a block go into the last pass) and ``room``, the words still to fill after the whole blocks.

    In each round the blocks that fit the room are taken in permuted order as
    far as they go; the smallest block left is taken in part.
    """
    source, order = Window.partitionBy("place"), Window.partitionBy("place").orderBy("key", "block")
    blocks = blocks.withColumn("room", F.col("rest")).withColumn("whole", F.lit(False))
    for _ in range(rounds):
        blocks = blocks.withColumn("fits", ~F.col("whole") & (F.col("words") <= F.col("room")))
        blocks = blocks.withColumn("now", F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("words"))).over(order) <= F.col("room")))
        blocks = blocks.withColumn("room", F.col("room") - F.coalesce(F.sum(F.when(F.col("now"), F.col("words"))).over(source), F.lit(0))).withColumn("whole", F.col("whole") | F.col("now"))
    first = F.row_number().over(source.orderBy("whole", "words", "key", "block")) == 1
    part = F.when(F.col("whole"), "all").when(first & (F.col("room") > 0), "some").otherwise("none")
    return blocks.withColumn("part", part).drop("key", "fits", "now", "whole")


def numbered(sized: DataFrame) -> DataFrame:
    """Adds ``number``, from 1 among rows with equal source and name, in no particular order. Equal rows are counted for each stored
    partition first, so many of them are numbered by many tasks."""
    part = F.shiftright("row", 33)
    own = ["source", "name", "part"]
    rows = sized.withColumn("part", part)
    per_part = rows.groupBy(*own).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # where a task has the only rows of a name nothing is before them
    starts = per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before > 0")
    starts = starts.select(F.col("source").alias("s_source"), F.col("name").alias("s_name"), F.col("part").alias("s_part"), "before")
    same = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("name") == F.col("s_name")) & (F.col("part") == F.col("s_part"))
    inside = F.row_number().over(Window.partitionBy(*own).orderBy("row"))
    out = rows.withColumn("inside", inside).join(starts, same, "left")
    return out.withColumn("number", F.col("inside") + F.coalesce("before", F.lit(0))).drop("part", "inside", "before", "s_source", "s_name", "s_part")


def plan_mix(sized: DataFrame, shards: int, blocks: int, seed: str, weights: tuple[int, ...]) -> DataFrame:
    """From ``row, doc_id, source, size, name`` to ``row, doc_id, source, size, source_size, target`` and ``shards``, the shard of each time that a row is taken."""
    key = F.concat_ws("|", "name", "number")
    keyed = numbered(sized).withColumn("block", F.pmod(draw(F.lit(seed), key), F.lit(blocks)).cast("int")).withColumn("turn_key", draw(F.lit(seed), F.lit("doc"), key))
    keyed = stored(keyed.drop("name", "number"), "op2-keys")

    per_block = keyed.groupBy("source", "block").agg(F.sum("size").alias("words"))
    targets = source_targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    named = per_block.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # whole passes, then the blocks of one more pass in permuted order
    named = named.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    named = named.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    named = fill(named.withColumn("key", draw(F.lit(seed), F.col("place"), F.col("passes"), F.col("block"))), FILLS)
    named = stored(named.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), "op2-blocks")

    # each time that a block is taken, numbered in permuted order within its source
    last = F.col("passes") - F.when(F.col("part") == "none", 1).otherwise(0)
    turns = named.where("passes > 0 OR part <> 'none'").select("place", "b", F.explode(F.sequence(F.lit(0), last)).alias("turn"))
    order = Window.partitionBy("place").orderBy("turn", draw(F.lit(seed), F.col("place"), F.col("turn"), F.col("b")), "b")
    turns = turns.withColumn("number", F.row_number().over(order))
    quotas = shard_quotas(turns.groupBy("place").agg(F.count("*").alias("blocks")), shards, seed)
    turns = turns.join(quotas, "place").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("number"))))
    given = turns.groupBy("place", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("given"))

    # where the rest ends inside a block: documents in permuted order, the last one if more than half of it fits
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    split = keyed.join(named.where("part = 'some'").select("s", "b", "place", "room"), same).groupBy("place", "b", "room", "turn_key").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("place", "b").orderBy("turn_key")
    split = split.withColumn("before", F.sum("words").over(order) - F.col("words")).where(F.col("before") + F.col("words") / 2 <= F.col("room"))
    cuts = split.groupBy("place", "b").agg(F.max("turn_key").alias("cut"))

    plan = named.join(given, ["place", "b"], "left").join(cuts, ["place", "b"], "left").select("s", "b", "source_size", "target", "passes", "part", "cut", "given")
    whole = (F.col("part") != "some") | F.coalesce(F.col("turn_key") <= F.col("cut"), F.lit(False))
    none = F.expr("CAST(array() AS ARRAY<INT>)")
    taken = F.when(F.col("given").isNull() | (F.col("size") == 0), none).when(whole, F.col("given")).otherwise(F.slice("given", F.lit(1), F.col("passes")))
    return keyed.join(plan, same).select("row", "doc_id", "source", "size", "source_size", "target", taken.alias("shards"))


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS, blocks: int = BLOCKS, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), carry: list[str] | None = None) -> DataFrame:
    """Write the mix below ``path``: a folder for each shard, with a row for each time that a document is taken (``row, turn, size, source_size, target, shards``
    and ``kept``, a struct of the columns named in ``carry``, all if None). Returns what is known of every row of ``docs``: ``row, doc_id, source, size, source_size, target``."""
    columns = docs.columns if carry is None else list(carry)
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    kept = F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(0).alias("none")])
    sized = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", source.alias("source"), text_size(text).alias("size"), name.alias("name"), kept.alias("kept"))
    sized = stored(sized, "op2-sized", compression="zstd")
    plan = stored(plan_mix(sized.drop("kept"), shards, blocks, seed, weights), "op2-plan")
    takes = plan.where(F.size("shards") > 0).select(F.col("row").alias("of"), "size", "source_size", "target", "shards")
    # joined by shuffle on the row number: every task gets documents from all over the corpus
    each = sized.select("row", "kept").join(takes.hint("merge"), F.col("row") == F.col("of")).select("*", F.posexplode("shards").alias("turn", "shard")).drop("of")
    each = each.withColumn("at", F.xxhash64(F.lit(seed), "row", "turn")).sortWithinPartitions("shard", "at").drop("at")
    with shuffle_files_removed(docs.sparkSession):
        each.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    discard(sized)
    return plan.drop("shards")


def read_shards(spark: SparkSession, path: str, plan: DataFrame, kept: StructType | None = None) -> DataFrame:
    """The written mix, with ``shard``; ``kept`` is the type of the carried columns, without it they are not read."""
    fields = [plan.schema[c] for c in ("row", "size", "source_size", "target")] + [StructField("shards", ArrayType(IntegerType())), StructField("turn", IntegerType()), StructField("shard", IntegerType())]
    return spark.read.schema(StructType(fields + ([StructField("kept", kept)] if kept else []))).parquet(path)


def mix(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target`` and, counted from the written shards (below ``path``), ``shards`` (the shard of each
    time that the mix takes the document; empty if it does not) and ``taken`` (the words so taken). ``options`` as in ``write_mix``."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "op2-shards")
    plan = write_mix(docs, path, **options)
    found = read_shards(spark, path, plan).groupBy("row").agg(F.sum("size").alias("taken"), F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("at"))
    found = found.select(F.col("row").alias("of"), "taken", F.transform("at", lambda x: x["shard"]).alias("shards"))
    none = F.expr("CAST(array() AS ARRAY<INT>)")
    out = plan.join(found, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("shards", none).alias("shards"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The documents that the mix takes, as its shards have them: the columns of ``docs``, then ``size, source_size, target, taken, shards``, which
    take the place of columns with these names."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "op2-shards")
    plan = write_mix(docs, path, **options)
    rows = read_shards(spark, path, plan, docs.schema).where("turn = 0")
    columns = [c for c in docs.columns if c not in MIXED]
    return rows.select(*[F.col(f"kept.`{c}`") for c in columns], "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
