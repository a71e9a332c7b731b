"""Registered corpus queries against their SQL, over whole tables."""

from __future__ import annotations

import zlib

import pytest
from compare import connect, differences

from citescope.llm.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), CHECKS[name]) == []


def held_out(spark, name, sf, target, mod, remainder):
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % mod == remainder)
        assert 0 <= r.score <= 1
    wanted = {i: v for i, v in target.items() if rows[i].held_out and v is not None}
    return rows, wanted


@pytest.mark.parametrize(
    "name,label,mod,remainder,least",
    [("op5_quality", "quality", 3, 1, 0.95), ("op8_toxicity", "toxic", 5, 0, 0.9)],
)
def test_held_out_labels(spark, name, label, mod, remainder, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    rows, wanted = held_out(spark, name, sf, {r.doc_id: r[label] for r in labels}, mod, remainder)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())
    right = sum(rows[i].predicted == v for i, v in wanted.items()) / len(wanted)
    assert right >= least


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows, wanted = held_out(spark, "op7_language", sf, {r.doc_id: r.lang for r in docs}, 4, 2)
    assert sum(rows[i].lang_pred == v for i, v in wanted.items()) / len(wanted) >= 0.98


def test_shards(spark):
    rows = QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    shard_of, slots, size = {}, {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= 1.01 * min(size.values())


def test_sequences(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from citescope.llm.bins import best_fit_decreasing

    sf = "/root/testdata/sf0.001"
    pieces = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    lengths = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc.pop(r.doc_id), key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(-(-len(ids) // 2048)))
        for p in own:
            cut = ids[p.start : p.start + p.length]
            assert p.start == 2048 * p.piece and len(cut) == min(2048, len(ids) - p.start) == p.length
            assert p.ids_crc32 == zlib.crc32(np.array(cut, dtype="<u4").tobytes())
            lengths.append(p.length)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) == max(best_fit_decreasing(lengths, 2048)) + 1
