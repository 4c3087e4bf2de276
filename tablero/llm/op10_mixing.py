"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Targets: the whole corpus' words are shared by source weight; a target stops at ``most`` times its source's
words and the excess is reshared by weight (water-filling, in closed form over sources sorted by
words per weight). Schedule: a full period of van der Corput points (bit-reversed counters) goes
through the cumulative slot counts of the sources, so every prefix of the schedule is close to the
weights and a whole period meets them exactly. The slots of a source are ranked; rank r takes block
r mod m of its m blocks of equal length, cut from its documents in shuffled order. The last slot of a source is trimmed to its target.

Defined cases: null text or text without words has size 0 and takes 0; null is a source of its own,
ordered last; repeated rows are separate documents; a null doc_id is an ordinary document; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
MOST = 3
SEED = "mix-1"
SLOT_CHUNK = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_no, weight, source_size, target, stream (whole words to take)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # the windows below see one row per source
    per = per.withColumn("source_no", F.row_number().over(by_name))
    per = per.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    )
    cap = F.col("source_size") * most
    lean = Window.orderBy((cap / F.col("weight")).asc(), F.col("source_no"))
    before = lean.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("left_words", left_words).withColumn("left_weight", left_weight)
    per = per.withColumn("capped", cap * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    level = F.min(F.when(~F.col("capped"), F.struct("source_no_in_order", "left_words", "left_weight"))).over(everything)
    per = per.withColumn("source_no_in_order", F.row_number().over(lean)).withColumn("level", level)
    share = F.col("weight") * F.col("level.left_words").cast("double") / F.col("level.left_weight")
    return per.select(
        "source", "source_no", "weight", "source_size",
        F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"),
    ).withColumn("stream", F.least(F.floor("target"), F.col("source_size") * most))


def shuffled_starts(sized: DataFrame, buckets: int) -> DataFrame:
    """Add ``start``: words of the same source before the row in shuffled order (md5 of the id).

    Two levels: buckets of neighbouring digests, so that a source with very many documents is spread.
    """
    order = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.withColumn("mixed", order).withColumn(
        "bucket", F.floor(F.conv(F.substring("mixed", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24))
    )
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("mixed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (
        rows.join(bases, ["source_no", "bucket"])
        .withColumn("start", F.col("base") + F.col("inner"))
        .drop("base", "inner", "bucket", "mixed")
    )


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The slots in order: slot, source_no, rank, epoch, block, words (the last slot of a source is trimmed)."""
    blocks = F.ceil(F.col("source_size") / block)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("stream") / F.col("source_size"))).otherwise(0)
    rest = F.col("stream") - rounds * F.col("source_size")
    need = plan.withColumn("blocks", blocks).withColumn("slots", rounds * blocks + F.ceil(rest / block))
    need = need.withColumn("hi", F.sum("slots").over(Window.orderBy("source_no")))
    need = need.withColumn("lo", F.col("hi") - F.col("slots")).where("slots > 0")
    n = need.agg(F.max("hi")).first()[0] or 0
    bits = max(1, (int(n) - 1).bit_length())
    grid = max(1, (1 << bits) >> 12)
    points = spark.range(1 << bits if n else 0).select(
        F.col("id").alias("slot"),
        F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long").alias("point"),
    )
    points = points.where(F.col("point") < n).withColumn("cell", F.floor(F.col("point") / grid))
    cells = need.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / grid), F.floor((F.col("hi") - 1) / grid))))
    slots = points.join(cells, "cell").where("point >= lo and point < hi")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranked"))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    slots = slots.withColumn("in_chunk", F.row_number().over(within)).join(counts, ["source_no", "chunk"])
    slots = slots.withColumn("rank", F.col("ranked") + F.col("in_chunk") - 1)
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("stream") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    return slots.select("slot", "source_no", "rank", "epoch", "block", F.least(length, left).alias("words"), length.alias("length"))


def mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source, ...)."""
    spark = docs.sparkSession
    sized = staged(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    plan = staged(targets(sized, weights, most))
    takes = schedule(spark, plan, block).groupBy("source_no", "block").agg(
        F.count(F.when(F.col("words") == F.col("length"), 1)).alias("whole"),
        F.coalesce(F.max(F.when(F.col("words") < F.col("length"), F.col("words"))), F.lit(0)).alias("trimmed"),
    )
    named = sized.join(plan.drop("weight", "stream"), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = staged(shuffled_starts(named, 4 * shuffle_partitions(spark)))
    pieces = placed.where("size > 0").select(
        "source_no", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    got = (hi - lo) * F.col("whole") + F.greatest(F.least(hi, F.col("trimmed")) - lo, F.lit(0))
    taken = pieces.join(takes, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(got).alias("got"))
    # (source_no, start) names a document with words: starts are distinct where sizes are positive
    keyed = placed.withColumn("key", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.abs(F.hash("doc_id")).cast("long")))
    return keyed.join(taken.withColumnRenamed("start", "key"), ["source_no", "key"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (one row per doc_id) as often as the mix takes them.

    A document taken k times in full comes k times; one whose stream ends inside it adds a copy cut after the
    words taken. Rows that the mix takes no word of are left out.
    """
    picked = mix(docs, **how).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    rows = docs.join(picked, F.col("doc_id").eqNullSafe(F.col("__id")))
    rows = rows.withColumns({"__whole": F.floor(F.col("__taken") / F.col("__size")), "__rest": F.col("__taken") % F.col("__size")})
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__whole") + F.when(F.col("__rest") > 0, 1).otherwise(0))))
    whole = F.col("__copy") <= F.col("__whole")
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("__rest").cast("int")), " ")
    out = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
