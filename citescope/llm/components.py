"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.shared import Scratch


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row.n, row.x or 0


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, component)`` for every node that stands in a link.

    ``links`` has the columns ``u`` and ``v``.  A component is named by its smallest node.
    Each round gives every node the smallest neighbour known so far: a grouped minimum that
    is combined before the shuffle, and a join on the node that may be split where a node
    has very many neighbours.  Paths shorten by a constant factor in each round, and links
    never outnumber those given.  Null ends are left out; loops and repeats do no harm."""
    edges = scratch.save(
        links.where("u IS NOT NULL AND v IS NOT NULL")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    nodes = edges
    seen, step = _checksum(edges), 0
    while True:
        both = edges.where("u <> v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Down-links of each node, and the smallest of them, to which all the others move.
        large = large.distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        step += 1
        after = scratch.save(small, f"{name}-{step}")
        now = _checksum(after)
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        edges = after
        if now == seen:
            break
        seen = now
    known = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    rest = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    out = rest.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    result = scratch.save(out, f"{name}-components")
    scratch.drop(f"{name}-0", f"{name}-{step}")
    return result
