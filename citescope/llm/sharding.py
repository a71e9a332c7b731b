"""Shards of near equal size from indivisible groups of documents.

Groups of equal texts stay together.  The few groups that hold a large share of all bytes
are items by themselves; all others are put by hash into parcels of texts of about the same
size.  Each size class has as many parcels as keep their average to a small part of a shard's
bytes.  So the number of items is bounded by parameters, whatever the number of documents,
and best-fit-decreasing packs them on the driver: items by decreasing size enter the
shard with the least remaining capacity that has room, found in a balanced tree.  The
smallest capacity that needs no more than the given shards is found by halving; small
parcels come last and level out what large ones leave.

Places in a shard come from counts per (shard, slice): slices are bounded parts of a shard,
so no task holds a whole shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm.bins import best_fit_decreasing
from citescope.llm.shared import Scratch

#: Least parcels per class of text sizes, and the share of a shard that makes a group an item.
PARCELS, LARGE = 64, 64
#: The share of a shard that parcels of a class have on average at most.
FINE = 256


def pack(sizes: list[int], shards: int) -> list[int]:
    """A shard of each item, with as small a largest shard as best-fit-decreasing finds."""
    low = max([1, -(-sum(sizes) // shards), *sizes])
    high = 2 * low
    best = best_fit_decreasing(sizes, high)
    while max(best, default=0) >= shards:
        high *= 2
        best = best_fit_decreasing(sizes, high)
    while high - low > low >> 20:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if max(tried, default=0) < shards:
            high, best = middle, tried
        else:
            low = middle + 1
    return best


def shard_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    parcels: int = PARCELS,
    large: int = LARGE,
    fine: int = FINE,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row for each row of ``docs``.

    ``size`` is the UTF-8 bytes of the text, none for null, plus 8.  Rows of equal text are
    in one shard, null and empty texts alike.  Shards are near equal in bytes: as long as no
    group is larger than a shard's share, they differ by about the smallest parcels, none of
    which has much more than a shard's ``fine``-th part on average, however similar the sizes.
    ``slot`` numbers the rows of a shard from 0 without gaps, by slice, then number.

    Rows may repeat and numbers may be null; each row has a slot of its own.  Other columns
    are not read.  An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    rows = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            # Equal texts have equal hashes; different texts of one hash are one group.
            F.xxhash64(text).alias("text_hash"),
            F.xxhash64(text, F.lit(7)).alias("parcel_hash"),
            F.floor(F.log2(size.cast("double"))).cast("int").alias("class"),
        ),
        "rows",
    )
    classes = rows.groupBy("class").agg(F.sum("size").alias("bytes")).collect()
    total = sum(r.bytes for r in classes)
    # On average a parcel holds at most this much, so there are at most shards * fine and
    # ``parcels`` for each class.
    most = max(1, total // (shards * fine))
    of_class = spark.createDataFrame(
        [(r["class"], max(parcels, -(-r.bytes // most))) for r in classes], "class int, parcels long"
    )
    least = max(1, math.ceil(total / (shards * large)))
    # A group is an item of its own if it holds this much, so there are at most shards * large.
    heavy = [
        (r.text_hash, r.bytes)
        for r in rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") >= least).collect()
    ]
    heavy_table = spark.createDataFrame([(h,) for h, _ in heavy], "text_hash long")
    parcel = F.concat_ws(".", "class", F.pmod("parcel_hash", "parcels"))
    named = (
        rows.join(F.broadcast(of_class), "class")
        .join(F.broadcast(heavy_table.withColumn("own", F.lit("group"))), "text_hash", "left")
        .withColumn("item", F.when(F.col("own").isNotNull(), F.concat(F.lit("="), "text_hash")).otherwise(parcel))
    )
    items = sorted((r.item, r.bytes) for r in named.groupBy("item").agg(F.sum("size").alias("bytes")).collect())
    places = pack([b for _, b in items], shards)
    of_item = spark.createDataFrame(
        [(name, place) for (name, _), place in zip(items, places)], "item string, shard int"
    )
    slices = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    placed = scratch.save(
        named.join(F.broadcast(of_item), "item")
        .select("doc_id", "size", "text_crc32", "shard", F.pmod(
                F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise((F.rand(seed=1) * 2**40).cast("long")),
                F.lit(slices),
            ).cast("int").alias("slice"),
        ),
        "placed",
    )
    scratch.drop("rows")
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"))
    )
