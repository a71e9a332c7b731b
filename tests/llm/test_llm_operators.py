"""Corpus operators against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import BASE, LINE, TEXTS, documents, empty, prose

from citescope.llm import bins, decontaminate, exact_dedup, language, license_scan, line_dedup, near_dedup, packing, quality, sharding, toxicity
from citescope.llm import words as W
from citescope.llm.components import components
from citescope.llm.shared import Scratch


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- words


def test_words_match_a_regular_expression():
    texts = [t or "" for _, t in TEXTS] + ["a", " a", "a ", "é\n b", "x" * 50]
    for kind, pattern in (
        (W.SPACED_WORD, r"[^\x20\x09-\x0D]+"),
        (W.ALNUM_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        raw, ends = W.utf8(pa.array(texts, pa.string()))
        starts, stops, firsts = W.word_spans(raw, ends, kind)
        found = [bytes(raw[a:b]).decode() for a, b in zip(starts, stops)]
        if kind is W.ALNUM_WORD:
            expected = [re.findall(pattern, lower(t)) for t in texts]
            found = [lower(w) for w in found]
        else:
            expected = [re.findall(pattern, t) for t in texts]
        assert [found[a:b] for a, b in zip(firsts, firsts[1:])] == expected
        hashes = W.word_hashes(raw, starts, stops)
        same = {}
        for w, h in zip(found, hashes.tolist()):
            assert same.setdefault(lower(w), h) == h
        assert len(set(same.values())) == len(same)


def test_slices_of_a_column_are_read_where_they_begin():
    column = pa.array(["abc def", None, "gh", "ij kl"])
    whole = list(W.shingle_sets(column, 1))
    part = list(W.shingle_sets(column.slice(2), 1))
    assert [x.tolist() for x in whole[2:]] == [x.tolist() for x in part]
    assert not len(whole[1])


# --- components and near duplicates


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (500, 500), (1, 0)]
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == union_find({x for p in links for x in p}, links)


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_by_force(texts, n, percent):
    sets = {i: shingle_set(t, n) for i, t in texts}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c) for i, c in union_find(sets, links).items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    texts = [(i, t) for i, t in TEXTS if i is not None and i not in (18, 19)]
    # A hub with many edited copies, most of which link only to the hub, and a chain.
    rng = random.Random(5)
    hub = prose(50, 150).split()
    for k in range(60):
        w = list(hub)
        for p in rng.sample(range(150), rng.randint(1, 9)):
            w[p] = f"edit{k}x{p}"
        texts.append((200 + k, " ".join(w)))
    texts.append((190, " ".join(hub)))
    chain = prose(51, 100).split()
    for k in range(12):
        texts.append((300 + k, " ".join(chain[3 * k :] + [f"tail{j}" for j in range(3 * k)])))
    rows = near_dedup.near_duplicates(documents(spark, texts), n=n, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_by_force(texts, n, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_awkward_rows(spark):
    rows = near_dedup.near_duplicates(documents(spark), n=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 18} == {18}
    assert near_dedup.near_duplicates(empty(spark)).collect() == []
    kept = near_dedup.drop_near_duplicates(documents(spark), n=2)
    assert kept.columns == documents(spark).columns
    assert {1, 6, 7, 9, None} <= {r.doc_id for r in kept.collect()}
    assert not {2, 3, 4, 10} & {r.doc_id for r in kept.collect()}


def test_a_hub_number_with_several_texts_is_confirmed_with_each():
    first, second = prose(60, 80), prose(61, 80)
    rows = [(2, 1, first, first), (2, 1, first, second), (3, 1, second, first), (3, 1, second, second), (4, 1, second, None), (5, 6, second, second)]
    columns = dict(zip(("doc_id", "hub", "text", "hub_text"), zip(*rows)))
    batch = pa.RecordBatch.from_pydict(columns)
    for batches in ([batch], [batch.slice(k, 1) for k in range(len(rows))], [batch.slice(0, 3), batch.slice(3)]):
        found = [(r["u"], r["v"]) for b in near_dedup._confirm(5, 80)(iter(batches)) for r in b.to_pylist()]
        assert found == [(2, 1), (3, 1), (5, 6)]


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    same = np.mean(near_dedup.minhash(a, 4096) == near_dedup.minhash(b, 4096))
    assert abs(same - 320 / 480) < 0.08
    one = near_dedup.minhash(a[:1], 64)
    assert len(set(one.tolist())) == 1


# --- lines


def lines_by_force(rows, min_length, min_docs):
    strip = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(strip))
            if i is not None and len(key) >= min_length:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [
            i is not None and len(k) >= min_length and len(holders[k]) >= min_docs and i != max(holders[k])
            for k in (lower(x.strip(strip)) for x in lines)
        ]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_line_dedup(spark, partitions):
    rng = random.Random(9)
    pool = [f"Shared line number {k} that is certainly long enough" for k in range(20)]
    rows = TEXTS + [
        (100 + d, "\n".join(rng.choice([*pool, pool[0], pool[0], "short", prose(rng.randrange(10**6), 9)]) for _ in range(8)))
        for d in range(150)
    ]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = line_dedup.cleaned(documents(spark, rows), min_length=40, min_docs=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text or "") for r in got), key=repr)
    assert found == lines_by_force(rows, 40, 5)


def test_line_dedup_columns(spark):
    out = line_dedup.drop_repeated_lines(documents(spark))
    assert out.columns == documents(spark).columns
    assert LINE not in {r.doc_id: r.text for r in out.collect()}[12]
    assert {r.doc_id: r.text for r in out.collect()}[6] is None
    assert line_dedup.drop_repeated_lines(empty(spark)).collect() == []


# --- exact duplicates


def test_exact_duplicates(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = exact_dedup.exact_duplicates(documents(spark)).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    expected = []
    for i, t in TEXTS:
        own = groups[norm(t)]
        least = min((x for x in own if x is not None), default=None)
        expected.append((i, least, len(own), i == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == []


def test_fingerprints_combine():
    rng = np.random.default_rng(2)
    for a, b in [(0, 5), (3, 4096), (5000, 9000), (4096, 1), (20_000, 0)]:
        left, right = rng.integers(0, 256, a).astype(np.uint8), rng.integers(0, 256, b).astype(np.uint8)
        raw = np.concatenate([left, right])
        parts = exact_dedup.polynomials(raw, np.array([0, a, a + b]))
        whole = exact_dedup.polynomials(raw, np.array([0, a + b]))[0]
        assert exact_dedup.combine(parts[0], parts[1], b).tolist() == whole.tolist()
        slow = [0] * 4
        for byte in raw.tolist():
            slow = [(h * int(p) + byte) % exact_dedup.PRIME for h, p in zip(slow, exact_dedup.POINTS)]
        assert whole.tolist() == slow


def test_equal_fingerprints_are_compared():
    schema = ["n_bytes", "fp_a", "fp_b", "salt", "chunk", "doc_id", "data"]
    rows = [(1, 1, 1, 0, 0, d, x) for d, x in [(1, b"x"), (2, b"x"), (3, b"y"), (4, b"y"), (5, b"x")]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=schema)
    out = [r for b in exact_dedup._compare(True)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["like_doc"]) for r in out if r["kind"] == exact_dedup.DIFFERS] == [(3, 3), (4, 3)]
    assert [(r["doc_id"], r["data"]) for r in out if r["kind"] == exact_dedup.HEAD] == [(1, b"x"), (3, b"y")]


# --- decontamination


def windows_by_force(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wanted = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else []:
            wanted.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in texts:
        w = split(t)
        hit, found = set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                own = wanted.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_decontamination(spark, block_bytes):
    passage = prose(70, 40)
    items = [("1", passage), ("10", prose(71, 14)), ("2", "Short, item"), ("3", None), ("4", ""), (None, passage), ("5", passage), ("6", "word")]
    w = passage.split()
    texts = TEXTS + [
        (50, prose(72, 50) + " " + passage + " " + prose(73, 50)),
        (51, " ".join(w[5:17])),
        (52, " ".join(w[5:18]) + " x " + " ".join(w[10:30]).upper()),
        (53, "a short ITEM, a short; item"),
        (54, " ".join(w[:20]) + "\n" + " ".join(w[20:])),
        (55, " ".join(w[20:33]) + " " + " ".join(w[0:13]) * 2),
    ]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.scan(documents(spark, texts), benchmark, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr) == windows_by_force(texts, items, 13)
    longest = {r.doc_id: r.longest for r in rows}
    assert (longest[50].words, longest[50].doc_word, longest[50].item_word) == (40, 50, 0)
    kept = decontaminate.decontaminate(documents(spark, texts), benchmark, block_bytes=block_bytes)
    assert kept.columns == documents(spark).columns
    bad = {d for d, n, h, _ in windows_by_force(texts, items, 13) if h and 20 * h >= n}
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - bad


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert all(r.n_hit == 0 for r in decontaminate.scan(documents(spark), none).collect())
    assert decontaminate.scan(empty(spark), none).collect() == []


# --- licences


def test_license_scan(spark):
    notice = "Permission is granted to use this text for any purpose whatsoever without fee or further notice at all"
    templates = spark.createDataFrame([("long", notice), ("five", "Released under some fine licence"), ("none", None), ("short", "only two")], "template_id string, text string")
    w = notice.split()
    texts = TEXTS + [
        (60, prose(80, 33) + " " + notice.upper() + ", " + prose(81, 70)),
        (61, " ".join(w[:-2])),
        (62, " ".join(w[:-6])),
        (63, "x released under SOME fine: licence y"),
        (64, "only two"),
        (65, " ".join(w[:9]) + " " + prose(82, 40) + " " + " ".join(w[9:])),
    ]
    rows = {r.doc_id: {m.template_id: (m.per_cent, m.first, m.last) for m in r.matches} for r in license_scan.license_scan(documents(spark, texts), templates).collect()}
    assert rows[60] == {"long": (100, 33, 33 + len(w) - 1)}
    assert rows[61] == {"long": (85, 0, len(w) - 3)}
    assert rows[62] == {} and rows[65] == {} and rows[1] == {} and rows[6] == {}
    assert rows[63] == {"five": (100, 1, 5)}
    assert rows[64] == {"short": (100, 0, 4)}
    assert license_scan.license_scan(empty(spark), templates).collect() == []


def shares_by_force(text, notices, n=5):
    """For each notice the share of its runs of words anywhere in the text, and the shortest stretch."""
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] * bool(w)

    own, out = runs(text), {}
    for i, notice in notices:
        wanted = set(runs(notice))
        found = wanted & set(own)
        if 100 * len(found) >= 80 * len(wanted):
            at = [p for p, r in enumerate(own) if r in found]
            _, first, last = min((b - a, a, b) for a in at for b in at if a <= b and found <= set(own[a : b + 1]))
            out[i] = (100 * len(found) // len(wanted), first, last + n - 1)
    return out


def test_license_notices_with_words_inserted(spark):
    from citescope.llm.checks import NOTICES

    rng = random.Random(9)
    texts = []
    for i, notice in NOTICES:
        w = notice.split()
        for before in (0, 25, 31, rng.randrange(200)):
            for inserted in (0, 15, 40, 300):
                cut = rng.randint(1, len(w) - 1) if before > 31 else len(w) // 2
                middle = [prose(rng.randrange(10**6), inserted)] if inserted else []
                start = [prose(rng.randrange(10**6), before)] if before else []
                texts.append(" ".join([*start, *w[:cut], *middle, *w[cut:]]))
    texts.append(" ".join([NOTICES[8][1], prose(1, 60), NOTICES[8][1], NOTICES[0][1], "under", NOTICES[1][1]]))
    templates = spark.createDataFrame(NOTICES, "template_id string, text string")
    for block_bytes in (100, 8 << 20):
        found = license_scan.license_scan(documents(spark, list(enumerate(texts))), templates, block_bytes=block_bytes)
        rows = {r.doc_id: {m.template_id: (m.per_cent, m.first, m.last) for m in r.matches} for r in found.collect()}
        assert rows == {k: shares_by_force(t, NOTICES) for k, t in enumerate(texts)}
    permission = [rows[8 * 16 + k] for k in range(12)]
    assert all(r["mit-permission"][0] == (100 if k % 4 == 0 else 84) for k, r in enumerate(permission))


# --- models


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_scores_of_awkward_rows(spark):
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(1, 24)] + [(5, None, None), (None, 1, 1), (999, 1, 1)])
    nothing = labels_of(spark, [])
    for run in (toxicity.toxicity, quality.quality):
        rows = run(documents(spark), labels).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        by_text = {}
        for r in rows:
            if r.doc_id in (6, 7):
                by_text.setdefault("", set()).add(r.score)
        assert len(by_text[""]) == 1
        assert {r.score for r in run(documents(spark), nothing).collect()} == {0.5}
        assert run(empty(spark), labels).collect() == []
    out = toxicity.drop_toxic(documents(spark), nothing)
    assert out.columns == documents(spark).columns


def test_toxic_words_are_learned(spark):
    texts = [(i, prose(i, 30) + (" nasty word" if i % 5 == 0 else " kind word")) for i in range(400)]
    labels = labels_of(spark, [(i, int(i % 5 == 0), 1) for i in range(300)])
    rows = toxicity.toxicity(documents(spark, texts), labels).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in rows)
    left = toxicity.drop_toxic(documents(spark, texts), labels)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in texts if i % 5}


def test_isotonic():
    rng = random.Random(1)
    y = [rng.random() + i / 40 for i in range(60)]
    n = [rng.randint(1, 5) for _ in y]
    fit = quality.isotonic(np.array(n), np.array(y))
    # The minimax formula of isotonic regression.
    mean = lambda a, b: sum(p * q for p, q in zip(n[a:b], y[a:b])) / sum(n[a:b])
    slow = [max(min(mean(a, b) for b in range(k + 1, 61)) for a in range(k + 1)) for k in range(60)]
    assert np.allclose(fit, slow)


def test_languages_of_awkward_rows(spark):
    rows = language.languages(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (6, 7, 8, 21))
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language.languages(documents(spark).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert language.languages(empty(spark)).collect() == []


def test_runs_of_bytes():
    texts = ["a", "", "Ab 1c", "é", "..", "word"]
    got = {}
    for _, _, values, owner in language.runs(pa.array(texts)):
        for v, o in zip(values.tolist(), owner.tolist()):
            got.setdefault(o, []).append(v.to_bytes(4, "big"))
    for i, t in enumerate(texts):
        folded = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t.lower().encode())
        padded = b"  " + folded + b" "
        slow = [padded[k : k + 4] for k in range(len(padded) - 3) if padded[k + 2] != 32]
        assert got.get(i, []) == slow


def test_many_languages(spark):
    texts = [(i, f"only{i:03d}x".translate(str.maketrans("0123456789", "qwertyuiop")) * 3) for i in range(70)]
    docs = documents(spark, texts).selectExpr("doc_id", "text", "cast(doc_id AS string) AS lang")
    rows = language.languages(docs).collect()
    assert sum(r.lang_pred == str(r.doc_id) for r in rows) == 70


# --- bins, shards, sequences


def test_bins():
    rng = random.Random(4)
    for _ in range(50):
        limit = rng.randint(5, 60)
        sizes = [rng.randint(1, limit) for _ in range(rng.randint(0, 60))]
        rooms, expected = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
            b = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(limit)
            rooms[b] -= sizes[i]
            expected.append((i, b))
        assert bins.best_fit_decreasing(sizes, limit) == [b for _, b in sorted(expected)]
        runs = packing.best_fit_runs(Counter(sizes), limit)
        used = {}
        for s, n in Counter(sizes).items():
            own = sorted(r for r in runs if r[0] == s)
            for j in range(n):
                _, first_rank, first_bin, each, at = [r for r in own if r[1] <= j][-1]
                used.setdefault(first_bin + (j - first_rank) // each, []).append((at + (j - first_rank) % each * s, s))
        assert len(used) == len(rooms)
        for own in used.values():
            at = 0
            for start, s in sorted(own):
                assert start == at
                at += s
            assert at <= limit


def test_room_tree():
    rng = random.Random(6)
    tree, plain = bins.RoomTree(40), Counter()
    for _ in range(400):
        r = rng.randint(0, 40)
        if plain[r] and rng.random() < 0.5:
            plain[r] -= 1
            tree.add(r, -1)
        else:
            plain[r] += 1
            tree.add(r, 1)
        s = rng.randint(0, 45)
        assert tree.tightest(s) == min((k for k in plain if plain[k] and k >= s), default=None)


def test_shards_of_awkward_rows(spark):
    rows = sharding.shard_groups(documents(spark), shards=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.size == 8}) == 1
    assert sharding.shard_groups(empty(spark)).collect() == []


def test_shards_of_texts_of_similar_length(spark):
    from pyspark.sql import functions as F

    for low, high in ((2990, 3010), (2100, 4000)):
        texts = spark.range(0, 100_000, 1, 8).select(
            F.col("id").alias("doc_id"),
            F.rpad(F.col("id").cast("string"), low + F.pmod(F.xxhash64("id"), F.lit(high - low)).cast("int"), F.lit("x")).alias("text"),
        )
        rows = sharding.shard_groups(texts, shards=24)
        size = {r.shard: (r.bytes, r.n) for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        assert len(size) == 24 and sum(n for _, n in size.values()) == 100_000
        assert max(b for b, _ in size.values()) <= 1.01 * min(b for b, _ in size.values())


def test_sequences_of_awkward_rows(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_sequences(documents(spark), tokenizer=path, capacity=64).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= 64
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in TEXTS)
    assert packing.pack_sequences(empty(spark), tokenizer=path).collect() == []


def test_ids_are_the_tokenizers():
    import public_tokenizers

    ids = packing.Ids(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} A{chr(c)}1" for c in [*range(1, 0x400), *range(0x1E00, 0x2100), 0x3000, 0x4E00, 0x1F600]]
    texts += ["<|endoftext|> don't", "H̱ ΑΣ Σ", BASE, "", " \n "]
    for t in texts:
        assert ids(t) == ids._whole(t), repr(t)


def test_new_words_of_a_text_are_encoded_together(monkeypatch):
    import public_tokenizers

    ids = packing.Ids(str(public_tokenizers.path("word_bpe_49k.json")))
    asked = []
    word = ids._word
    monkeypatch.setattr(ids, "_word", lambda w: asked.append(w) or word(w))
    texts = [BASE, "don't xqzv-xqzv, a.b\nÄöß 12", "Xqzv " * 3 + "x" * 500 + ",ab", "word," * 300, "=" * 300 + " a"]
    for t in texts:
        assert ids(t) == ids._whole(t), repr(t)
    assert all(len(w) > packing.LONGEST for w in asked if w not in ("ab", ","))
    assert max(map(len, ids.known)) <= packing.LONGEST
    monkeypatch.setattr(packing, "RUNS", 2)
    ids.room = -1
    assert [ids(t) for t in texts] == list(map(ids._whole, texts))
    ids.ranked, ids.room = None, -1
    assert [ids(t) for t in texts] == list(map(ids._whole, texts))
