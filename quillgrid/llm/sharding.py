"""Shards by jump consistent hashing, in DataFrame functions only.

Jump consistent hashing needs no table of the ring: a key's shard follows from a short chain of
pseudo-random jumps, and when shards are appended a key either stays or moves to a new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import checkpointed, shuffle_partitions

# Fixed values of the published algorithm: its linear congruential step.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key.

    The chain of jumps is a fold over at most `shards` steps; a step that finds the chain
    already past the last shard leaves it alone. Products of 64-bit words fit decimal(38).
    """
    unsigned = key.cast("decimal(20,0)")
    unsigned = F.when(key < 0, unsigned + F.lit(str(WORD)).cast("decimal(20,0)")).otherwise(unsigned)
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
        unsigned.cast("decimal(20,0)").alias("key"),
    )

    def step(state: Column, _: Column) -> Column:
        product = (state["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)")
        key = ((product + F.lit(1)) % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(key / F.lit(1 << 33)).cast("double") + 1.0
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / high))
        moved = F.struct(
            state["next"].alias("shard"), jump.cast("long").alias("next"), key.alias("key")
        )
        return F.when(state["next"] < shards, moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda state: state["shard"].cast("int"))


def assign_shards(
    df: DataFrame, key_col: str, text_col: str, shards: int, overhead: int = 8
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot and grown_shard.

    The law is `key`: the hash of the key and the number of shards decide the shard, so equal
    keys (and repeated rows) share one, and one more shard (`grown_shard`) takes rows only into
    itself. A missing key has a shard like any other key. `size` is the UTF-8 length of the text
    (0 if missing) plus `overhead`; `text_crc32` is that of its bytes, missing text as empty.
    `slot` numbers the rows of a shard from 0 without gaps, in the order of key, checksum and
    size; identical rows are numbered as they come. Other columns are ignored, and an empty
    table gives an empty result.

    Numbering needs no shard in one task: rows are dealt by ranges of the key (a repeated key
    is split by a row number), counted by range and shard, and numbered within those pieces.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    key = F.col(f"`{key_col}`")
    rows = df.select(
        key.alias("key"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("line"),
    )
    order = ["key", "text_crc32", "size", "line"]
    dealt = (
        rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("mixed", F.xxhash64("key"))
    )
    placed = checkpointed(
        dealt.select(
            *order, "piece",
            jump_shard(F.col("mixed"), shards).alias("shard"),
            jump_shard(F.col("mixed"), shards + 1).alias("grown_shard"),
        )
    )
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        "shard", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "piece").orderBy(*order)
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(firsts, ["shard", "piece"]).select(
        F.col("key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard",
    )
