"""The corpus pipeline as a whole against brute force, from what its first stage keeps."""

from __future__ import annotations

import zlib

import numpy as np
from cases import prose
from test_llm_operators import lines_by_force, near_by_force, windows_by_force

import corpus_pipeline
from citescope.llm.bins import best_fit_decreasing
from citescope.llm.shared import Scratch

SF = "/root/testdata/sf0.001"


def test_all_stages(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    line = "A line that many of these documents have, and that is long enough."
    near = prose(90, 200).split()
    passage = max((t for _, t in items), key=lambda t: len(t or ""))
    texts = [f"{prose(100 + k, 20)}\n{line}\n{prose(200 + k, 20)}" for k in range(7)]
    texts += [line, None, "", " ".join(near), " ".join(near[:-2]), f"{line}\n" + " ".join(near)]
    texts += [passage, f"{prose(91, 10)} {passage}", f"{prose(92, 3000)} {passage}", prose(93, 9000)]
    made = [(10**6 + k, t, "en", "made", -1) for k, t in enumerate(texts)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    docs.select(columns).unionByName(spark.createDataFrame(made, schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    seen = []
    scratch = Scratch(spark, "seen")

    def watched(stage):
        def run(*given):
            out = scratch.save(stage(*given), f"stage-{len(seen)}")
            seen.append(out.collect())
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(seen) == 5
    first = {r.doc_id: r for r in seen[0]}
    assert len(first) == len(seen[0]) and 0 < docs.count() + len(made) - len(first)

    def rows(stage):
        return sorted((tuple(r[c] for c in columns) for r in seen[stage]), key=repr)

    lines = {i: (dropped, kept) for i, _, dropped, kept in lines_by_force([(r.doc_id, r.text) for r in seen[0]], 40, 5)}
    kept = {}
    for i, r in first.items():
        dropped, text = lines[i]
        kept[i] = (i, text, r.lang, r.source, len(text)) if dropped else tuple(r[c] for c in columns)
    assert sum(d > 0 for d, _ in lines.values()) >= 7
    assert rows(1) == sorted(kept.values(), key=repr)

    component = near_by_force([(i, k[1]) for i, k in kept.items()], 5, 80)
    single = {i: k for i, k in kept.items() if component[i][1] == i}
    assert len(single) < len(kept)
    assert rows(2) == sorted(single.values(), key=repr)

    bad = {d for d, n, h, _ in windows_by_force([(i, k[1]) for i, k in single.items()], items, 13) if h and 20 * h >= n}
    clean = {i: k for i, k in single.items() if i not in bad}
    assert bad
    assert rows(3) == sorted(clean.values(), key=repr)

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    wanted, lengths = [], []
    for i, k in clean.items():
        ids = [*tokenizer.encode(k[1] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            wanted.append((i, piece, start, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
            lengths.append(len(cut))
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(wanted)
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 2048 and len(sequences) == max(best_fit_decreasing(lengths, 2048)) + 1


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    from cases import TEXTS, documents, empty

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for docs, count in ((documents(spark), len(TEXTS)), (empty(spark), 0)):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            before = rows.count()
            rows = Scratch(spark, "stage").save(out, "rows")
            assert rows.count() <= before
        left = [(r.doc_id, r.text) for r in rows.collect()]
        assert len(left) <= count
        if count:
            for awkward in ((6, None), (None, None), (7, ""), (8, " \n\t")):
                assert awkward in left
        pieces = corpus_pipeline.packed(spark, rows, str(tmp_path)).collect()
        assert sum(p.piece == 0 for p in pieces) == len(left)
