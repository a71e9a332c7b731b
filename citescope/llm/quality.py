"""A quality score from random Fourier features of document statistics.

Each text becomes a row of statistics, in one pass.  Random Fourier features, cosines of
random projections of the standardised statistics, approximate a Gaussian kernel, so ridge
regression on them is kernel ridge regression at a fixed size.  Every partition of the
training rows sums its part of the normal equations, the parts are added block by block, and
the driver solves one system whose size is a parameter.  Scores of training rows that the
regression did not see are then made a probability by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

_ALL = np.arange(256)
#: Kinds of bytes whose share of a text is a statistic.
KINDS = {
    "lower": (_ALL >= 0x61) & (_ALL <= 0x7A),
    "upper": (_ALL >= 0x41) & (_ALL <= 0x5A),
    "digit": (_ALL >= 0x30) & (_ALL <= 0x39),
    "space": W.SPACE,
    "line end": _ALL == 0x0A,
    "beyond ASCII": _ALL >= 0x80,
    "full stop": _ALL == 0x2E,
    "comma": _ALL == 0x2C,
    "other sign": ((_ALL > 0x20) & (_ALL < 0x7F))
    & ~W.ALNUM_WORD
    & ~np.isin(_ALL, [0x2E, 0x2C]),
}
NAMES = (
    *KINDS,
    "log words", "mean word", "spread of word length", "long words", "short words",
    "distinct words", "distinct pairs", "word like the one before", "words without a letter",
    "words in capitals", "words with capital first", "mean line", "short lines", "repeated lines",
)


def _share(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Mean of the values of each text, 0 for a text without any."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return (sums[firsts[1:]] - sums[firsts[:-1]]) / np.maximum(1, np.diff(firsts))


def _distinct(keys: np.ndarray, text: np.ndarray, firsts: np.ndarray, count: int) -> np.ndarray:
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=count) / np.maximum(1, np.diff(firsts))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; a text without words has zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for low, high in W.pieces(column):
        raw, ends = W.utf8(column.slice(low, high - low))
        n = high - low
        starts, stops, firsts = W.word_spans(raw, ends, W.SPACED_WORD)
        text = np.repeat(np.arange(n), np.diff(firsts))
        hashes = W.word_hashes(raw, starts, stops)
        size = (stops - starts).astype(np.float64)
        one = [_share(kind[raw], ends) for kind in KINDS.values()]
        per = {k: np.concatenate([[0], np.cumsum(kind[raw])]) for k, kind in KINDS.items()}

        def inside(*kinds: str) -> np.ndarray:
            return sum(per[k][stops] - per[k][starts] for k in kinds)

        letters = inside("lower", "upper", "beyond ASCII")
        mean = _share(size, firsts)
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        pair_text = text[:-1][text[1:] == text[:-1]]
        pairs = W.mix(hashes[:-1] * W.U64(3) + hashes[1:])[text[1:] == text[:-1]]
        pair_firsts = np.searchsorted(pair_text, np.arange(n + 1))
        line = np.zeros(256, dtype=bool)
        line[:] = True
        line[0x0A] = False
        l_starts, l_stops, l_firsts = W.word_spans(raw, ends, line)
        l_text = np.repeat(np.arange(n), np.diff(l_firsts))
        l_size = (l_stops - l_starts).astype(np.float64)
        first_upper = KINDS["upper"][raw[starts]] if len(starts) else np.zeros(0, dtype=bool)
        out[low:high] = np.stack(
            [
                *one,
                np.log1p(np.diff(firsts)),
                np.log1p(mean),
                np.sqrt(np.maximum(0, _share(size**2, firsts) - mean**2)) / (1 + mean),
                _share(size > 12, firsts),
                _share(size <= 3, firsts),
                _distinct(hashes, text, firsts, n),
                _distinct(pairs, pair_text, pair_firsts, n),
                _share(same, firsts),
                _share(letters == 0, firsts),
                _share((inside("upper") >= 2) & (inside("lower") == 0), firsts),
                _share(first_upper, firsts),
                np.log1p(_share(l_size, l_firsts)),
                _share(l_size < 20, l_firsts),
                1 - _distinct(W.word_hashes(raw, l_starts, l_stops), l_text, l_firsts, n),
            ],
            axis=1,
        )
        out[low:high][np.diff(firsts) == 0] = 0.0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = statistics(batch.column("text"))
        ends = pa.array(np.arange(0, table.size + 1, len(NAMES), dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(table.ravel()))], names=["doc_id", "x"]
        )


class Model(NamedTuple):
    """Standardisation, random projection, ridge weights, and steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turn + self.shift) * np.sqrt(2.0 / len(self.shift))
        return np.hstack([waves, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


#: Rows of the normal equations that travel together, and blocks that one task adds.
BLOCK, ADDED = 64, 32


def _normal(model: Model):
    """A partition's part of the normal equations, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = _matrix(batch), batch.column("label").to_numpy()
            for low in range(0, len(x), 2048):
                a = model.features(x[low : low + 2048])
                part = a.T @ np.hstack([a, y[low : low + 2048, None]])
                total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            for low in range(0, len(total), BLOCK):
                block = total[low : low + BLOCK].astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([low], pa.int32()), pa.array([task], pa.int32()), pa.array([block], pa.binary())],
                    names=["low", "task", "part"],
                )

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of at most ``ADDED`` blocks."""
    total = sum(np.frombuffer(data.as_buffer(), dtype="<f8") for data in table.column("part"))
    task = table.column("task")[0].as_py() // ADDED
    return pa.table({"low": table.column("low")[:1], "task": pa.array([task], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def summed(parts: DataFrame, many: int) -> DataFrame:
    """``low, part``: the sums of blocks of ``many`` tasks, so many at a time in each round."""
    while True:
        parts = parts.groupBy("low", F.expr(f"task div {ADDED}")).applyInArrow(_added, "low int, task int, part binary")
        many = -(-many // ADDED)
        if many <= 1:
            return parts.select("low", "part")


def isotonic(counts: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``means`` with weights ``counts``."""
    stack: list[list[float]] = []
    for n, m in zip(counts, means):
        stack.append([n, m, 1])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            n2, m2, k2 = stack.pop()
            n1, m1, k1 = stack.pop()
            stack.append([n1 + n2, (n1 * m1 + n2 * m2) / (n1 + n2), k1 + k2])
    return np.repeat([m for _, m, _ in stack], [k for _, _, k in stack])


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(model.raw(_matrix(batch)))], names=["label", "raw"]
            )

    return run


def train(
    measured: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    scratch: Scratch,
    *,
    waves: int = 384,
    width: float = 6.0,
    ridge: float = 1e-3,
    bins: int = 512,
) -> Model | None:
    """The model of all usable labels that are not null; nothing if there are none.

    ``measured`` has ``doc_id`` and the statistics ``x``.  One labelled row in five, by a
    hash of its number, is kept from the regression for the calibration."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where(
        usable & F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    rows = scratch.save(
        measured.join(marked, "doc_id").select(
            "x", "label", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("aside")
        ),
        "labelled",
    )
    at = [F.element_at("x", i + 1) for i in range(len(NAMES))]
    found = rows.agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in at]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in at]).alias("scale"),
    ).first()
    if not found.n:
        return None
    rng = np.random.Generator(np.random.PCG64(5))
    scale = np.array(found.scale)
    model = Model(
        np.array(found.mean),
        np.where(scale > 1e-9, scale, 1.0),
        rng.standard_normal((len(NAMES), waves)) / width,
        rng.uniform(0, 2 * np.pi, waves),
        np.zeros(0),
        np.zeros(0),
        np.zeros(0),
    )
    learned = rows.where("NOT aside").mapInArrow(_normal(model), "low int, task int, part binary")
    parts = summed(learned, learned.rdd.getNumPartitions()).collect()
    size = waves + len(NAMES) + 1
    total = np.zeros((size, size + 1))
    for r in parts:
        block = np.frombuffer(r.part, dtype="<f8").reshape(-1, size + 1)
        total[r.low : r.low + len(block)] = block
    weights = np.linalg.solve(total[:, :-1] + ridge * max(1.0, total[-1, -2]) * np.eye(size) / size, total[:, -1])
    model = model._replace(weights=weights)
    raw = rows.where("aside").mapInArrow(_raw(model), "label double, raw double")
    binned = (
        raw.withColumn("bin", F.floor(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * (bins / 3)))
        .groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.avg("raw").alias("raw"))
        .orderBy("bin").toPandas()
    )
    scratch.drop("labelled")
    if not len(binned):
        return model._replace(knots=np.array([0.0, 1.0]), values=np.array([0.0, 1.0]))
    values = isotonic(binned["n"].to_numpy(), binned["mean"].to_numpy())
    # A slight slope keeps the order of scores on a step.
    knots = binned["raw"].to_numpy()
    return model._replace(knots=knots, values=0.998 * values + 0.002 * np.clip((knots + 1) / 3, 0, 1))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    usable: Column | None = None,
    **options,
) -> DataFrame:
    """``doc_id, score, predicted``: one row for each row of ``docs``.

    The score, from 0 to 1, is higher where label 1 is likelier; ``predicted`` is 1 from 0.5
    on.  ``usable`` tells by ``doc_id`` which labels may be learned from; labels of numbers
    that repeat count for each row.  Null and empty texts have statistics of zero and get
    the score of these; without any usable label all scores are 0.5.  Columns besides the
    two named are not read."""
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(
        keyed(docs, id_col, text_col).mapInArrow(_measure, "doc_id long, x array<double>"), "measured"
    )
    model = train(measured, labels, label, F.lit(True) if usable is None else usable, scratch, **options)
    return measured.mapInArrow(_score(model), "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
