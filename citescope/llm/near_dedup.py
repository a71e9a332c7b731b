"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

1. A pass over the texts makes, per document, the set of its word shingles as 64-bit
   hashes, a fingerprint of the set, and a one-permutation MinHash: the hash range is cut
   into ``bands * rows`` bins, each bin keeps its smallest hash, and an empty bin takes the
   value of the first filled bin in a random order of its own (optimal densification).
2. Documents of equal sets become one class, so copies cost nothing from here on.
3. Each band of a class is a bucket.  The member that shares most buckets with others is
   the bucket's hub, and only (member, hub) pairs are candidates: a bucket gives as many
   pairs as it has members.
4. Pairs are confirmed on the full sets; components of the links follow by alternating stars.
5. Members that their hub did not link are the only ones that can still have a link that is
   not known: any two members of a bucket were tried against the same hub.  For each hub,
   these are held against all members of other components, in blocks of bounded size whose
   rows are the documents, not the pairs.  So no link between members of a bucket is lost.

With the default 32 bands of 5 rows, two sets of similarity 0.8 share no bucket with a
probability of 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.components import components
from citescope.llm.shared import Scratch, keyed

#: Members of other components, and members without a link to the hub, in one block.
BLOCK_MEMBERS, BLOCK_LEFT = 512, 64
#: As many numbers of documents, 32 MB, may be sent to the tasks; more are joined by a shuffle.
SENT_NUMBERS = 4_000_000


@lru_cache(maxsize=4)
def _bins(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of k equal parts of the hash range; for each bin its order of others."""
    low = np.array([(i << 64) // k for i in range(k)], dtype=W.U64)
    order = np.argsort(W.mix(np.arange(k * k), seed=5).reshape(k, k), axis=1)
    return low, order


def minhash(hashes: np.ndarray, k: int) -> np.ndarray:
    """k values of a non-empty set of hashes, sorted or not; equal sets give equal values."""
    low, order = _bins(k)
    hashes = np.sort(W.mix(hashes, seed=9))
    at = np.append(np.searchsorted(hashes, low), len(hashes))
    filled = at[:-1] < at[1:]
    values = hashes[np.minimum(at[:-1], len(hashes) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        donor = order[empty, np.argmax(filled[order[empty]], axis=1)]
        values = values.copy()
        values[empty] = values[donor]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a MinHash; equal hashes of different bands never meet."""
    table = values.reshape(bands, rows)
    out = np.arange(bands, dtype=W.U64)
    for r in range(rows):
        out = W.mix(out + table[:, r], seed=20 + r)
    return out


def _sketches(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, a, b, keys = [], [], [], []
            for s in W.shingle_sets(batch.column("text"), n):
                size.append(len(s))
                a.append(int(W.mix(s, 31).sum(dtype=W.U64)))
                b.append(int(W.mix(s, 32).sum(dtype=W.U64)))
                keys.append(
                    band_keys(minhash(s, bands * rows), bands, rows).view(np.int64) if len(s) else None
                )
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [0 if k is None else bands for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(a, dtype=W.U64).view(np.int64)),
                    pa.array(np.array(b, dtype=W.U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "fp_a", "fp_b", "keys"],
            )

    return run


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, fp_a, fp_b, keys``: size and fingerprint of each set, and its bands."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketches(n, bands, rows),
        "doc_id long, n_shingles long, fp_a long, fp_b long, keys array<long>",
    )


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for non-empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(n: int, percent: int):
    """Keeps the pairs that are similar; the rows of one hub mostly come one after another.

    A set is made anew where the text of the hub changes, not its number: a number may stand
    in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub_set = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("hub_text")
            changed = np.ones(batch.num_rows, dtype=bool)
            changed[0] = hub_set is None or texts[0].as_py() != last
            changed[1:] = pc.not_equal(texts.slice(1), texts.slice(0, batch.num_rows - 1)).fill_null(True)
            last = texts[batch.num_rows - 1].as_py()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, member in enumerate(W.shingle_sets(batch.column("text"), n)):
                if changed[i]:
                    hub_set = next(W.shingle_sets(texts.slice(i, 1), n))
                keep[i] = similar(member, hub_set, percent)
            rows = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), batch.column("hub").take(pa.array(rows))],
                names=["u", "v"],
            )

    return run


def _blocks(n: int, percent: int):
    """Links between the unlinked and the other members of one block of one hub."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        sets = list(W.shingle_sets(pa.array(block["text"], pa.large_string()), n))
        label = block["label"].tolist()
        ids = block["doc_id"].tolist()
        left = [i for i, is_left in enumerate(block["is_left"]) if is_left]
        other = [i for i, is_left in enumerate(block["is_left"]) if not is_left]
        found = []
        for x in left:
            known = {label[x]}
            for y in other:
                if label[y] not in known and similar(sets[x], sets[y], percent):
                    known.add(label[y])
                    found.append((ids[x], ids[y]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Words stand between white space, A-Z count as a-z.  A document's set has its distinct
    runs of ``n`` words; a shorter text counts as one run.  Documents are linked if their
    sets have a similarity of at least ``percent`` per cent, and a component has all that
    can be reached over links; its smallest number names it, and the row of that number
    is the one kept.

    Null and empty texts and texts of white space have no shingles, link with nothing and
    stay.  Numbers should be unique.  Where one repeats, its rows are one node of the links,
    and each row takes the component of the rows whose set equals its own.  A row without a
    number links with nothing, has no component and stays.
    Columns besides the two named are not read.  An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    source = keyed(docs, id_col, text_col)
    sketch = scratch.save(sketches(source, n, bands, rows), "sketches")
    fp = ["fp_a", "fp_b", "n_shingles"]
    linked = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(linked.groupBy(*fp).agg(F.min("doc_id").alias("rep")), "classes")

    # Bucket members: the bands of one document of each class, where two classes meet.
    # A number may stand in several rows, so it may represent several classes.
    own = linked.join(
        classes.select(*[F.col(c).alias(f"c_{c}") for c in fp], "rep"),
        (F.col("doc_id") == F.col("rep")) & (F.col("fp_a") == F.col("c_fp_a")) & (F.col("fp_b") == F.col("c_fp_b")) & (F.col("n_shingles") == F.col("c_n_shingles")),
        "left_semi",
    )
    bucketed = own.select("doc_id", F.explode("keys").alias("key"))
    shared = bucketed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch.save(bucketed.join(shared, "key"), "members")
    rank = members.groupBy("doc_id").agg(F.sum("members").alias("popularity"))
    ranked = members.join(rank, "doc_id")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("popularity", (-F.col("doc_id")).alias("minus"))).alias("top"))
    stars = scratch.save(
        members.join(hubs, "key")
        .select("doc_id", (-F.col("top.minus")).alias("hub"))
        .distinct(),
        "stars",
    )
    wanted = scratch.save(stars.select("doc_id").distinct(), "wanted")
    sent = F.broadcast(wanted) if wanted.count() <= SENT_NUMBERS else wanted
    texts = scratch.save(source.join(sent, "doc_id", "left_semi"), "texts")
    scratch.drop("members", "wanted")

    # Sorted joins bring the rows of one hub together, so its set is made once.
    pairs = stars.where("doc_id <> hub")
    links = scratch.save(
        pairs.join(texts.hint("merge"), "doc_id")
        .join(texts.hint("merge").select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub")
        .select("doc_id", "hub", "text", "hub_text")
        .mapInArrow(_confirm(n, percent), "u long, v long"),
        "links",
    )
    label = components(links, scratch, "first")
    labelled = stars.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "hub", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    hub_label = label.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    sides = scratch.save(
        labelled.join(hub_label, "hub", "left").select(
            "hub",
            "doc_id",
            "label",
            (F.col("label") != F.coalesce("hub_component", "hub")).alias("is_left"),
        ).where("doc_id <> hub"),
        "sides",
    )
    more = scratch.save(_rest(sides, texts, n, percent), "more")
    if not more.isEmpty():
        label = components(links.unionByName(more), scratch, "second")

    of_class = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        *fp, F.coalesce("component", "rep").alias("component")
    )
    out = sketch.select("doc_id", *fp).join(of_class, fp, "left")
    result = out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    scratch.drop("links", "more", "texts", "stars", "sides")
    return result


def _rest(sides: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of members that their hub did not link, with members of other components."""
    counts = (
        sides.groupBy("hub")
        .agg(
            F.count_if("is_left").alias("left"),
            F.count_if(~F.col("is_left")).alias("linked"),
            (F.min("label") != F.max("label")).alias("open"),
        )
        .where("left > 0 AND open")
        .select(
            "hub",
            F.ceil(F.col("left") / BLOCK_LEFT).cast("int").alias("left_blocks"),
            F.ceil((F.col("left") + F.col("linked")) / BLOCK_MEMBERS).cast("int").alias("blocks"),
        )
    )
    each = sides.join(counts, "hub")
    place = F.xxhash64("doc_id")
    unlinked = each.where("is_left").select(
        "hub", "doc_id", "label", F.lit(True).alias("is_left"),
        F.pmod(place, "left_blocks").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"),
    )
    others = each.select(
        "hub", "doc_id", "label", F.lit(False).alias("is_left"),
        F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks").cast("int").alias("j"),
    )
    return (
        unlinked.unionByName(others)
        .join(texts, "doc_id")
        .groupBy("hub", "i", "j")
        .applyInPandas(_blocks(n, percent), "u long, v long")
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component; same columns, whatever their names.

    Rows that share a number go only if no row of that number is kept; rows without a number
    stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = (
        found.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.bool_or("kept").alias("kept"))
        .where("NOT kept")
        .select(F.col("doc_id").alias("gone"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(gone, F.col(f"doc.`{id_col}`").cast("long") == F.col("gone"), "left_anti").select("doc.*")
