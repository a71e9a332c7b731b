"""A toxicity score from FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct words, pairs of neighbouring words and pairs with one
word between, hashed into ``2 ** bits`` slots; A-Z count as a-z.  Training takes a bounded
sample of the labelled rows.  It is dealt to a few shards, each of which runs FTRL over its
rows one after another, with a learning rate for each slot and an L1 threshold that keeps
most weights at zero; after each pass the states of the shards are averaged (by Spark, slot
range by slot range) and passed on.  The weights that are not zero are small enough to send
to every task, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

#: Slots that one row of a shard's state carries.
RANGE = 1 << 14


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the texts of a piece, with repeats, and the text each belongs to."""
    for low, high in W.pieces(column):
        raw, ends = W.utf8(column.slice(low, high - low))
        starts, stops, firsts = W.word_spans(raw, ends, W.ALNUM_WORD)
        h = W.word_hashes(raw, starts, stops)
        text = np.searchsorted(firsts, np.arange(len(h)), side="right") - 1 + low
        parts = [(W.mix(h, 50), text)]
        for gap in (1, 2):
            pair = W.mix(W.mix(h[:-gap], 50 + gap) + h[gap:], 53)
            same = text[:-gap] == text[gap:]
            parts.append((pair[same], text[:-gap][same]))
        yield (
            np.concatenate([p for p, _ in parts]) >> W.U64(64 - bits),
            np.concatenate([t for _, t in parts]),
        )


def _rows(bits: int):
    """Distinct slots of each text, with its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots: list = [[]] * batch.num_rows
            for found, text in features(batch.column("text"), bits):
                both = np.unique(text.astype(np.int64) << bits | found.astype(np.int64))
                own = both >> bits
                for part in np.split(both, np.flatnonzero(np.diff(own)) + 1):
                    if len(part):
                        slots[part[0] >> bits] = (part & ((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("place"), batch.column("label"), pa.array(slots, pa.list_(pa.int32()))],
                names=["shard", "place", "label", "slots"],
            )

    return run


class Ftrl:
    """State of FTRL-proximal: sums of gradients and of their squares for each slot."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = z, n
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[slots]
        after = n + error * error
        self.z[slots] += error - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = after


def _epoch(bits: int, z: np.ndarray, n: np.ndarray, rates: tuple[float, ...]):
    """One pass over the rows of a shard, from the state all shards share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Ftrl] = {}
        for batch in batches:
            shard, label = batch.column("shard").to_pylist(), batch.column("label").to_pylist()
            slots = batch.column("slots")
            for i in range(batch.num_rows):
                if shard[i] not in models:
                    models[shard[i]] = Ftrl(z.copy(), n.copy(), *rates)
                # The last slot stands in every row, for the intercept.
                own = np.append(slots[i].values.to_numpy(zero_copy_only=False), 1 << bits)
                models[shard[i]].learn(own, label[i])
        for model in models.values():
            for low in range(0, (1 << bits) + 1, RANGE):
                state = np.concatenate([model.z[low : low + RANGE], model.n[low : low + RANGE]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low], pa.int32()), pa.array([state.astype("<f4").tobytes()], pa.binary())], names=["low", "state"]
                )

    return run


def _mean(part: pd.DataFrame) -> pd.DataFrame:
    """The mean of the shards' states over one range of slots; there are few shards."""
    state = np.mean([np.frombuffer(s, dtype="<f4") for s in part["state"]], axis=0)
    return pd.DataFrame({"low": part["low"].iloc[:1], "state": [state.astype("<f4").tobytes()]})


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    *,
    bits: int = 19,
    sample: int = 16_000,
    shard_rows: int = 4_000,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 0.5,
) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose weights are not zero, and the weights; slot ``2 ** bits`` is the intercept.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``label``; only
    labels that are not null and rows of ``usable`` count.  About ``sample`` of them are
    taken, by a hash of their number, the only bound on what is learned from, and dealt to
    shards of about ``shard_rows``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(
        usable & F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    count = marked.count()
    shards = max(1, -(-min(count, sample) // shard_rows))
    place = F.xxhash64("doc_id", F.lit(8))
    # At most ``sample`` small rows, give or take chance, so they may be sent to every task.
    chosen = marked.where(F.pmod(place, F.lit(max(count, 1))) < sample)
    rows = scratch.save(
        docs.join(F.broadcast(chosen), "doc_id")
        .select(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(shards)).cast("int").alias("shard"), place.alias("place"), "label", "text")
        .mapInArrow(_rows(bits), "shard int, place long, label double, slots array<int>"),
        "rows",
    )
    # One shard for each task: a hash of so few numbers would put several into one.
    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
    # Kept between the epochs; what an executor loses is made from the written rows again.
    dealt.persist(StorageLevel.DISK_ONLY)
    z, n = np.zeros((1 << bits) + 1, dtype=np.float32), np.zeros((1 << bits) + 1, dtype=np.float32)
    rates = (alpha, beta, l1, l2)

    for _ in range(epochs):
        states = (
            dealt.mapInArrow(_epoch(bits, z, n, rates), "low int, state binary")
            .groupBy("low")
            .applyInPandas(_mean, "low int, state binary")
            .collect()
        )
        for r in states:
            both = np.frombuffer(r.state, dtype="<f4")
            half = len(both) // 2
            z[r.low : r.low + half], n[r.low : r.low + half] = both[:half], both[half:]
    dealt.unpersist()
    scratch.drop("rows")
    weights = Ftrl(z, n, *rates).weights()
    slots = np.flatnonzero(weights)
    return slots, weights[slots].astype(np.float32)


def _scores(bits: int, slots: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1, dtype=np.float32)
        dense[slots] = weights
        for batch in batches:
            total = np.full(batch.num_rows, float(dense[-1]))
            for found, text in features(batch.column("text"), bits):
                # Distinct slots count once; those of weight zero never need to be told apart.
                some = dense[found] != 0
                both = np.unique(text[some].astype(np.int64) << bits | found[some].astype(np.int64))
                np.add.at(total, both >> bits, dense[both & ((1 << bits) - 1)])
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*[c for name, c in zip(batch.schema.names, batch.columns) if name != "text"], pa.array(score)],
                names=[*[name for name in batch.schema.names if name != "text"], "score"],
            )

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    usable: Column | None = None,
    bits: int = 19,
    **options,
) -> DataFrame:
    """``doc_id, score, predicted``: one row for each row of ``docs``.

    The score, from 0 to 1, is higher where label 1 is likelier; ``predicted`` is 1 from 0.5
    on.  ``usable`` tells by ``doc_id`` which labels may be learned from.  Null and empty
    texts have no words and get the score of the intercept, and so does every text if no
    label may be used (then 0.5).  Numbers may be null or repeat: each row is scored by its
    own text.  Columns besides the two named are not read."""
    source = keyed(docs, id_col, text_col)
    slots, weights = train(source, labels, label, F.lit(True) if usable is None else usable, bits=bits, **options)
    return source.select("doc_id", "text").mapInArrow(_scores(bits, slots, weights), "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", usable: Column | None = None, bits: int = 19, **options
) -> DataFrame:
    """``docs`` without the rows that ``toxicity`` predicts as 1; same columns, any names."""
    slots, weights = train(
        keyed(docs, id_col, text_col), labels, label, F.lit(True) if usable is None else usable, bits=bits, **options
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc"]]).add("score", T.DoubleType())
    return rows.mapInArrow(_scores(bits, slots, weights), schema).where("score < 0.5").select("doc.*")
