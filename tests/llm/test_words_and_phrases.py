"""Spelling variants, collocations and mixed sequences against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import TEXTS, documents, empty, prose

from citescope.llm import bloom, collocations, mixture, spelling
from citescope.llm import words as W
from citescope.llm.byte_ids import ByteIds

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_long_words_and_long_texts_have_the_hash_of_short_ones():
    rng = random.Random(3)
    some = ["".join(rng.choices("abcDé", k=rng.randint(1, 9))) for _ in range(30_000)]
    long = ["ab" * 50_000, "a" * W.CHUNK_BYTES, "a" * (W.CHUNK_BYTES + 1), "ba" * 50_000]
    raw, ends = W.utf8(pa.array([" ".join([*some[:9000], *long, *some[9000:]]), *long, *some]))
    starts, stops, firsts = W.word_spans(raw, ends, W.SPACED_WORD)
    for seed in (0, 1):
        found = W.word_hashes(raw, starts, stops, seed).tolist()
        words = [lower(bytes(raw[a:b]).decode()) for a, b in zip(starts, stops)]
        same = {}
        assert all(same.setdefault(w, h) == h for w, h in zip(words, found))
        assert len(set(same.values())) == len(same)
    assert W.strings(raw, starts, stops).to_pylist() == [bytes(raw[a:b]).decode() for a, b in zip(starts, stops)]


def test_a_filter_holds_its_members(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 20_000)
    rows = spark.createDataFrame([(int(k), i % 3) for i, k in enumerate(keys)], "key long, shard int")
    counts = {0: 6667, 1: 6667, 2: 6666}
    for limit in (bloom.MAX_BYTES, 4096):
        made = bloom.build(rows, counts, lambda c: (c[1], c[0]), limit)
        assert made.blocks.nbytes <= limit
        for shard in range(3):
            assert made.holds(keys[shard::3], shard).all()
        assert not made.holds(keys, 7).any()
        strange = made.holds(rng.integers(-(2**63), 2**63, 20_000), 1).mean()
        assert strange < 0.01 if limit == bloom.MAX_BYTES else strange > 0.5


# --- spelling variants


def forms_by_force(rows, least, min_count, ratio, typo_every):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            if typo_every:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % typo_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= min_count}
    letters = sorted(set("".join(n)))

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return (out - {w}) & n.keys()

    neighbours = {w: near(w) for w in n}
    form = {}
    for w, found in neighbours.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(neighbours[w]), n[form[w]] if form[w] else None) for w in n)


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def noisy(seed, words, times):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(3, 9))) for _ in range(words)]
    out = []
    for k, w in enumerate(base):
        out += [w] * (times * (k % 5 + 1))
        for _ in range(3):
            i = rng.randrange(len(w))
            other = rng.choice([w[:i] + w[i + 1 :], w[:i] + "f" + w[i:], w[:i] + "g" + w[i + 1 :]])
            out += [other] * rng.randint(1, 4)
            out += [other + "h"] * rng.randint(0, 1)
    rng.shuffle(out)
    return [" ".join(out[k::40]) for k in range(40)]


@pytest.mark.parametrize("typo_every,limit", [(None, bloom.MAX_BYTES), (7, bloom.MAX_BYTES), (7, 256)])
def test_spelling_matches_brute_force(spark, typo_every, limit):
    texts = [(100 + k, t) for k, t in enumerate(noisy(4, 120, 12))]
    texts += [*TEXTS, (50, "x" * 3000 + " " + "y" * 200), (51, "ÀÉÎ ÀÉÎÕ×÷ " * 9), (52, "abcdef-abcdef'abcdef_ABCDEF1abcdef " * 3)]
    docs = documents(spark, texts)
    found = spelling.spelling_variants(docs, min_length=3, min_count=2, ratio=2, typo_every=typo_every, filter_bytes=limit)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = forms_by_force(texts, 3, 2, 2, typo_every)
    assert answers(found) == sorted(expected, key=repr)
    assert any(r[1] and r[2] != r[1] for r in expected)


def test_crc32_of_spans():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(5000))
    starts = np.array([0, 0, 10, 100, 7, 4999, 5000])
    stops = np.array([0, 5000, 74, 165, 8, 5000, 5000])
    before = np.array([zlib.crc32(b"12:" * k) for k in range(7)], dtype=np.uint32)
    expected = [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(starts, stops, before)]
    assert spelling.crc32_of(np.frombuffer(data, np.uint8), starts, stops, before).tolist() == expected


def test_spelling_of_nothing(spark):
    for docs in (empty(spark), documents(spark, [(1, None), (2, ""), (3, "12 34 ab")])):
        assert spelling.spelling_variants(docs).collect() == []


# --- collocations


def phrases_by_force(rows, max_words, min_count, percent, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner = p[i : i + size]
                    if 100 * a >= percent * f[inner]:
                        gone.add(inner)
        found = []
        for p, a in candidates.items():
            if p in gone:
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)  # noqa: E741
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_words,top", [(2, 2000), (3, 25), (4, 2000)])
def test_collocations_match_brute_force(spark, max_words, top):
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "new", "york", "times", "é", "Ünited", "a|b", "x y", "\x1c"]
    texts = []
    for k in range(60):
        words = []
        for _ in range(rng.randint(0, 80)):
            words += ["new", "york", "times"] if rng.random() < 0.1 else [rng.choice(vocabulary)]
            words[-1] += rng.choice(["", "", "", ",", ". ", "\n", ";", "\t", "?!"])
        texts.append((k, " ".join(words)))
    texts += TEXTS + [(900, "the " * 20_000), (901, "., ;:\n"), (902, "w" * 100_000 + " the of the")]
    docs = documents(spark, texts)
    found = collocations.collocations(docs, max_words=max_words, min_count=4, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [(r.text, r.lang) for r in docs.collect()]
    expected = phrases_by_force(rows, max_words, 4, 50, top)
    assert answers(found) == expected
    assert {len(e[2].split(" ")) for e in expected} >= {2, max_words}


def test_a_prefix_with_very_many_words_is_cut(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_SHARE", 50)
    monkeypatch.setattr(collocations, "SHARE", 1000)
    monkeypatch.setattr(collocations, "HELD", 300)
    monkeypatch.setattr(collocations, "BLOCKS", 7)
    rng = random.Random(9)
    texts = [(k, " ".join(f"the w{rng.randrange(60)}" if rng.random() < 0.7 else f"w{rng.randrange(5)}" for _ in range(200))) for k in range(40)]
    docs = documents(spark, texts)
    found = collocations.collocations(docs, min_count=3)
    assert answers(found) == phrases_by_force([(r.text, r.lang) for r in docs.collect()], 3, 3, 50, 2000)


def test_large_counts_are_exact(spark):
    big = 4_000_000_000
    counts = {
        1: spark.createDataFrame([(1, big), (2, big - 1)], "w1 long, n long"),
        2: spark.createDataFrame([(1, 2, big - 7)], "w1 long, w2 long, n long"),
    }
    row = collocations._scored(counts, 2).first()
    assert row.score == 1_000_000 * (big - 7) ** 2 // (big * (big - 1))


def test_collocations_of_nothing(spark):
    for docs in (empty(spark), documents(spark, [(1, None), (2, ""), (3, "one two")])):
        assert collocations.collocations(docs).collect() == []


# --- mixed sequences


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_by_rank_are_the_tokenizers(tokenizer_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "don't", "I'll", "é", "ß", "12", "3.5", "!", "<|endoftext|>", " ", " "]
    parts += ["\u0085", "\x1c", "中", "😀", "　", "Ꟁ", "Д", "​", "<|end", "word", " word", "\x0b", "İ", "\x00", "“", "—"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(chr(rng.randrange(1, 0xD800)) + rng.choice(" a1!\n") for _ in range(60)) for _ in range(200)]
    tokenizer, ids = Tokenizer.from_file(tokenizer_path), ByteIds(tokenizer_path)
    assert ids.ranked is not None
    for t in texts:
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_are_asked():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    ids = ByteIds(path)
    assert ids.ranked is None
    assert ids("Some words, été").tolist() == Tokenizer.from_file(path).encode("Some words, été", add_special_tokens=False).ids


def served(tokens, weights, quantum):
    """Deficit round-robin, one unit after another: (queue, unit) in order."""
    made = mixture.plan(tokens, weights, quantum, 128)
    due = [int(s) for s in made.steps]
    unit, out = [0] * len(tokens), []
    while any(u < n for u, n in zip(unit, made.units)):
        q = min((q for q in range(len(tokens)) if unit[q] < made.units[q]), key=lambda q: (due[q], q))
        out.append((q, unit[q]))
        unit[q] += 1
        due[q] += 2 * int(made.steps[q])
    return made, out


def test_places_are_those_of_serving_one_by_one():
    rng = random.Random(7)
    for trial in range(100):
        tokens = [rng.choice([0, 5, rng.randint(0, 3000)]) for _ in range(rng.randint(1, 6))]
        weights = [(t or 1) / max(1, sum(tokens)) if trial % 2 else rng.random() + 0.01 for t in tokens]
        made, order = served(tokens, weights, 16)
        queue, unit = (np.array([x[k] for x in order], dtype=np.int64) for k in (0, 1))
        assert made.places(queue, unit).tolist() == list(range(len(order)))


def test_deficits_stay_small_until_a_queue_ends():
    tokens, weights = [160_000, 16_000, 32_000, 8_000], [0.5, 0.1, 0.3, 0.1]
    made, order = served(tokens, weights, 16)
    got = [0] * 4
    for k, (q, _) in enumerate(order, 1):
        got[q] += 1
        if all(g < u for g, u in zip(got, made.units)):
            assert max(abs(k * w - g) for w, g in zip(weights, got)) < 2


def check_sequences(pieces, texts, tokenizer_path, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(own, key=lambda p: p.start):
            cut = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, len(cut)) == (at, len(ids), p.length) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(cut, dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    lengths = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths.append(at)
    short = [n for n in lengths if n != capacity]
    assert all(n <= capacity and n & (n - 1) == 0 for n in short) and len(short) == len(set(short))
    return by_sequence


def test_mixed_sequences(spark, tokenizer_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    more = [(10**6, None, None), (10**6 + 1, "", "src0"), (10**6 + 2, prose(3, 9000), None), (10**6 + 3, "x<|endoftext|>y", "")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5)
    rows = docs.collect()
    texts, source = {r.doc_id: r.text for r in rows}, {r.doc_id: r.source for r in rows}
    pieces = mixture.pack_mixture(docs, tokenizer=tokenizer_path).collect()
    assert all(p.source == source[p.doc_id] for p in pieces)
    by_sequence = check_sequences(pieces, texts, tokenizer_path)
    total = collections.Counter()
    for p in pieces:
        total[p.source] += p.length
    for own in by_sequence.values():
        mix = collections.Counter()
        for p in own:
            mix[p.source] += p.length
        if sum(mix.values()) == 2048:
            assert all(abs(mix[s] - 2048 * n / sum(total.values())) <= 3 * 64 for s, n in total.items())


def test_targets_are_met_while_all_sources_last(spark, tokenizer_path):
    rows = [(k, prose(k, 400), "abc"[k % 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = mixture.pack_mixture(docs, tokenizer=tokenizer_path, targets={"a": 0.5, "b": 0.3, "c": 0.2}, quantum=32, capacity=512).collect()
    by_sequence = check_sequences(pieces, {i: t for i, t, _ in rows}, tokenizer_path, 512)
    for sequence in range(20):
        mix = collections.Counter()
        for p in by_sequence[sequence]:
            mix[p.source] += p.length
        assert all(abs(mix[s] - 512 * w) <= 64 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_many_sources_share_queues_and_sums_are_joined(spark, tokenizer_path, monkeypatch):
    monkeypatch.setattr(mixture, "QUEUES", 4)
    monkeypatch.setattr(mixture, "SHARED", 3)
    monkeypatch.setattr(mixture, "SENT_ROWS", 0)
    rows = [(k, prose(k, 50), f"s{k}" if k % 3 else "hot") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    pieces = mixture.pack_mixture(docs, tokenizer=tokenizer_path).collect()
    check_sequences(pieces, {i: t for i, t, _ in rows}, tokenizer_path)


def test_mixed_sequences_of_awkward_rows(spark, tokenizer_path):
    docs = documents(spark)
    pieces = mixture.pack_mixture(docs, tokenizer=tokenizer_path, source_col="lang", capacity=256, quantum=256).collect()
    assert sum(p.length for p in pieces) == sum(len(ByteIds(tokenizer_path)(t or "")) + 1 for _, t in TEXTS)
    assert sum(p.start == 0 for p in pieces) == len(TEXTS)
    ends = collections.Counter()
    for p in pieces:
        ends[p.sequence_id] += p.length
    assert sorted(p.offset for p in pieces if p.offset == 0) == [0] * len(ends)
    assert mixture.pack_mixture(empty(spark), tokenizer=tokenizer_path, source_col="lang").collect() == []
    with pytest.raises(ValueError):
        mixture.pack_mixture(docs, tokenizer=tokenizer_path, source_col="lang", capacity=2048, quantum=60)


def test_registered_mixture(spark, tokenizer_path):
    from citescope.llm.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_sequences(QUERIES["op13_mixture_packing"](spark, SF).collect(), texts, tokenizer_path)


# --- licences


def test_minima_of_parts():
    from citescope.llm import license_scan

    hashes = np.array([5, 3, 2**63, 2**63 + 9, 2**62, 7, 3], dtype=np.uint64)
    assert license_scan.minima(hashes, 4).tolist() == [3, 2**62, 2**63]
    assert license_scan.minima(hashes[:0], 4).tolist() == []
    assert license_scan.minima(hashes, 2).tolist() == [3, 2**63]


def test_long_templates_and_near_copies_of_them_are_all_retrieved(spark):
    """Every pair with at least four fifths of a template in common is found, wherever it stands."""
    from citescope.llm import license_scan

    rng = random.Random(12)
    templates, texts = [], []
    for k in range(24):
        words = prose(700 + k, rng.choice([9, 20, 60, 300, 2000, 5000])).split()
        templates.append((f"t{k}", " ".join(words)))
        near = [w if rng.random() > 0.01 else "changed" for w in words]
        templates.append((f"t{k}-near", " ".join(near)))
        cuts = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.choice([1, 2, 3]))))
        pieces = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        shuffled = pieces[1:] + pieces[:1]
        texts.append(" ".join([prose(900 + k, 80), *[" ".join(p) + " " + prose(1000 + 7 * k + i, 400) for i, p in enumerate(pieces)]]))
        texts.append(" ".join(" ".join(p) + " " + prose(2000 + 7 * k + i, 30) for i, p in enumerate(shuffled)))
        texts.append(" ".join(words[: int(len(words) * rng.choice([0.75, 0.85]))]))
    texts += [" ".join(t for _, t in templates), "", None, prose(5, 20_000)]
    frame = spark.createDataFrame(templates, "template_id string, text string")
    found = license_scan.license_scan(documents(spark, list(enumerate(texts))), frame).collect()
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in templates)}
    pairs = 0
    for r in found:
        words = (texts[r.doc_id] or "").split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        expected = {i: 100 * len(s & own) // len(s) for i, s in sets.items() if 100 * len(s & own) >= 80 * len(s)}
        assert {m.template_id: m.per_cent for m in r.matches} == expected
        pairs += len(expected)
    assert pairs > 100
