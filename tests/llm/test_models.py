"""Trained models against slow and plain versions of their parts."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, prose

from citescope.llm import quality, toxicity


def test_ftrl_is_the_scalar_rule():
    rng = random.Random(3)
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.5
    size = 40
    model = toxicity.Ftrl(np.zeros(size, np.float64), np.zeros(size, np.float64), alpha, beta, l1, l2)
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        slots = rng.sample(range(size - 1), rng.randint(0, 12)) + [size - 1]
        label = float(rng.random() < 0.3 + 0.4 * (0 in slots))
        model.learn(np.array(slots), label)
        w = {i: weight(i) for i in slots}
        error = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in slots:
            sigma = (math.sqrt(n[i] + error**2) - math.sqrt(n[i])) / alpha
            z[i] += error - sigma * w[i]
            n[i] += error**2
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(), [weight(i) for i in range(size)])


def test_each_shard_is_learned_by_itself(spark):
    """Two epochs over shards equal those of a loop over the same rows in the same order."""
    bits = 10
    texts = [(k, " ".join(random.Random(k).choices(["bad", "good", "fine", "word", "so"], k=9))) for k in range(300)]
    labels = spark.createDataFrame([(k, int("bad bad" in t or k % 7 == 0)) for k, t in texts], "doc_id long, toxic int")
    docs = documents(spark, texts)
    from pyspark.sql import functions as F

    rates = {"alpha": 1.0, "beta": 1.0, "l1": 0.05, "l2": 0.5}
    slots, weights = toxicity.train(docs, labels, "toxic", F.lit(True), bits=bits, sample=10_000, shard_rows=80, epochs=2, **rates)
    keys = spark.createDataFrame([(k,) for k, _ in texts], "doc_id long").selectExpr(
        "doc_id", "xxhash64(doc_id, 8) AS place", "CAST(pmod(xxhash64(doc_id, 9), 4) AS int) AS shard"
    ).collect()
    target = {r.doc_id: r.toxic for r in labels.collect()}
    by_shard = {}
    for r in sorted(keys, key=lambda r: r.place):
        by_shard.setdefault(r.shard, []).append(r.doc_id)
    found = {}
    for k, t in texts:
        for f, text in toxicity.features(pa.array([t]), bits):
            found[k] = np.unique(f).astype(np.int64)
    size = (1 << bits) + 1
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for _ in range(2):
        states = []
        for shard in sorted(by_shard):
            model = toxicity.Ftrl(z.copy(), n.copy(), *rates.values())
            for k in by_shard[shard]:
                model.learn(np.append(found[k], size - 1), target[k])
            states.append((model.z, model.n))
        z = np.mean([s[0] for s in states], axis=0).astype(np.float32)
        n = np.mean([s[1] for s in states], axis=0).astype(np.float32)
    expected = toxicity.Ftrl(z, n, *rates.values()).weights()
    mine = np.zeros(size)
    mine[slots] = weights
    assert np.allclose(mine, expected, atol=1e-4) and (expected != 0).sum() > 20


@pytest.mark.parametrize("added", [2, 32])
def test_summed_equations_are_the_dense_ones(spark, monkeypatch, added):
    monkeypatch.setattr(quality, "ADDED", added)
    rng = np.random.default_rng(4)
    width = len(quality.NAMES)
    x, y = rng.normal(size=(500, width)), rng.integers(0, 2, 500).astype(float)
    waves = 20
    model = quality.Model(
        x.mean(axis=0), x.std(axis=0), rng.standard_normal((width, waves)) / 6, rng.uniform(0, 6, waves), np.zeros(0), np.zeros(0), np.zeros(0)
    )
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(9)
    parts = rows.mapInArrow(quality._normal(model), "low int, task int, part binary")
    total = {r.low: np.frombuffer(r.part) for r in quality.summed(parts, 9).collect()}
    size = waves + width + 1
    found = np.concatenate([total[k] for k in sorted(total)]).reshape(size, size + 1)
    a = model.features(x)
    assert a.shape == (500, size)
    assert np.allclose(found, a.T @ np.hstack([a, y[:, None]]))



def test_statistics_of_a_text_are_plain_counts():
    texts = ["One two two.\nTHREE 44 4", prose(1, 50), "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    (out,) = list(quality._measure(iter([batch])))
    found = [dict(zip(quality.NAMES, x)) for x in out.column("x").to_pylist()]
    for text, stats in zip(texts, found):
        raw = (text or "").encode()
        share = lambda test: sum(map(test, raw)) / max(1, len(raw))
        assert math.isclose(stats["upper"], share(lambda b: 0x41 <= b <= 0x5A), abs_tol=1e-9)
        assert math.isclose(stats["lower"], share(lambda b: 0x61 <= b <= 0x7A), abs_tol=1e-9)
        assert math.isclose(stats["digit"], share(lambda b: 0x30 <= b <= 0x39), abs_tol=1e-9)
