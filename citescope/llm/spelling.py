"""Spelling variants: words one edit apart, and the common form that each rare one leads to.

1. Words are counted: tasks cut texts into runs of letters and combine equal ones.
2. Each word's neighbourhood is generated: every deletion of a letter, and every replacement by
   a letter that sorts behind it.  Deletions of the longer word stand for insertions into the
   shorter one, and the smaller word of two stands for both replacements; so each pair of near
   words is generated once, and each edit is a change of one term of a polynomial hash.
3. Edits are probed in broadcast Bloom filters, one shard for each word length.  What a shard
   holds is bounded: a larger vocabulary is cut by hash into slices, one pass for each.
4. Only positives become words and are joined with the vocabulary, which removes those that the filter
   let pass by mistake.  A word has at most as many near words as edits, so no group is large.
5. Forms are followed to their last by pointer doubling.  Each form is several times as
   frequent as the one before, so there are no cycles and only a few rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm import bloom
from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

_ALL = np.arange(256)
_ASCII_LETTER = ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
#: Letters of the words that can replace another: a-z, and U+00C0 to U+00FF.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint8)
#: Words that a task holds before it hands on their counts; edits probed at a time.
HELD, PROBES = 1 << 18, 1 << 19
#: Longer runs have their crc32 computed one by one.
_STEPS = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def crc32_of(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span of bytes, continued from that of what stands before it."""
    size = stops - starts
    out = before.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_STEPS, side="left"))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : stops[i]], int(before[i]))
    order = order[long:]
    state, at, size = ~out[order], starts[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, side="left"))
        s = state[:k]
        state[:k] = _CRC[(s ^ raw[at[:k] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


def _words_of(ids: list[int | None], texts: pa.Array, least: int, typo_every: int | None) -> pa.Array:
    """The words of at least ``least`` letters, with repeats."""
    raw, ends = W.utf8(texts)
    two = raw == 0xC3  # and a second byte: U+00C0 to U+00FF
    letter = _ASCII_LETTER[raw] | two
    letter[1:] |= two[:-1]
    starts, stops, firsts = W.spans(letter, ends)
    seconds = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) == 0x80, out=seconds[1:])
    length = stops - starts - (seconds[stops] - seconds[starts])
    keep = length >= least
    text = np.repeat(np.arange(len(ids)), np.diff(firsts))[keep]
    starts, stops, length = starts[keep], stops[keep], length[keep]
    lowered = W.LOWER[raw]
    if typo_every is None:
        return W.strings(lowered, starts, stops)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    crc = crc32_of(lowered, starts, stops, before[text])
    hit = crc % np.uint32(typo_every) == 0
    changed = []
    for low, high, n, h in zip(starts[hit].tolist(), stops[hit].tolist(), length[hit].tolist(), crc[hit].tolist()):
        if n > least:
            word = bytes(lowered[low:high]).decode()
            changed.append(word[: h % n] + word[h % n + 1 :])
    rest = W.strings(lowered, starts[~hit], stops[~hit])
    return pa.concat_arrays([rest, pa.array(changed, pa.large_string())])


def _counted(least: int, typo_every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            table = merged()
            yield from pa.table({"word": table.column("word").cast(pa.string()), "n": table.column("n")}).combine_chunks().to_batches()

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for low, high in W.pieces(texts):
                words = _words_of(ids[low:high], texts.slice(low, high - low), least, typo_every)
                counted = pa.table({"word": words}).group_by("word").aggregate([([], "count_all")])
                held.append(counted.rename_columns(["word", "n"]))
                if sum(t.num_rows for t in held) >= 2 * HELD or sum(t.nbytes for t in held) >= 32 << 20:
                    held = [merged()]
                    if held[0].num_rows >= HELD or held[0].nbytes >= 16 << 20:
                        yield from out()
                        held = []
        if held:
            yield from out()

    return run


_BASE = W.U64(0x9E3779B97F4A7C15)
_VALUE = W.mix(_ALL, seed=81)


def _letters(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of equal length together: the length, which rows they are, and their letters."""
    strings = words.to_pylist()
    length = np.array([len(w) for w in strings], dtype=np.int64)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        data = "".join([strings[i] for i in rows.tolist()]).encode("latin-1")
        yield n, rows, np.frombuffer(data, dtype=np.uint8).reshape(-1, n)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=W.U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters), dtype=W.U64)
    for k, power in enumerate(_powers(letters.shape[1])):
        out += _VALUE[letters[:, k]] * power
    return out


def _slice(keys: np.ndarray, slices: int) -> np.ndarray:
    return (W.mix(keys, seed=83) % W.U64(slices)).astype(np.int64)


def _members(slices: int):
    def keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words = pa.array(columns[0], pa.string())
        length, key = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=W.U64)
        for n, rows, letters in _letters(words):
            length[rows], key[rows] = n, _hashes(letters)
        return length, key.view(np.int64)

    return keys


def _in_slice(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=np.int64)
            for _, rows, letters in _letters(batch.column("word")):
                part[rows] = _slice(_hashes(letters), slices)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["word", "n", "part"])

    return run


def _probe(filters, alphabet: np.ndarray, least: int, slices: int, part: int):
    """``word, n, near``: edits that the filters let pass."""

    def positives(known: bloom.Filter, letters: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        n = letters.shape[1]
        power, whole, head = _powers(n), _hashes(letters), np.zeros(len(letters), dtype=W.U64)
        inverse = W.U64(pow(int(_BASE), -1, 2**64))

        def passed(keys: np.ndarray, length: int) -> np.ndarray:
            found = known.holds(keys.view(np.int64), length)
            return found & (_slice(keys, slices) == part) if slices > 1 else found

        for i in range(n):
            here = _VALUE[letters[:, i]] * power[i]
            if n > least:
                # Of a run of equal letters only the last is deleted; the others give the same.
                rows = np.flatnonzero(letters[:, i] != letters[:, i + 1]) if i + 1 < n else np.arange(len(letters))
                rows = rows[passed((head + (whole - head - here) * inverse)[rows], n - 1)]
                if len(rows):
                    cut = np.delete(letters[rows], i, axis=1)
                    yield rows, [bytes(w).decode("latin-1") for w in cut]
            edits = (whole - here)[:, None] + _VALUE[alphabet] * power[i]
            row, letter = np.nonzero(alphabet > letters[:, i : i + 1])
            fits = passed(edits[row, letter], n)
            row, letter = row[fits], letter[fits]
            if len(row):
                other = letters[row].copy()
                other[:, i] = alphabet[letter]
                yield row, [bytes(w).decode("latin-1") for w in other]
            head = head + here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        many = max(1, PROBES // len(alphabet)) if len(alphabet) else 1
        for batch in batches:
            for n, rows, letters in _letters(batch.column("word")):
                each = max(1, min(many, (4 << 20) // n))
                for low in range(0, len(rows), each):
                    for found, near in positives(known, letters[low : low + each]):
                        which = pa.array(rows[low + found])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("word").take(which), batch.column("n").take(which), pa.array(near, pa.string())],
                            names=["word", "n", "near"],
                        )

    return run


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for words with a form, by pointer doubling."""
    now = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.save(
            now.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            f"roots-{step}",
        )
        moved = not after.where("moved").isEmpty()
        now = after.select("word", "root")
        if not moved:
            return now


def spelling_variants(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    typo_every: int | None = None,
    filter_bytes: int = bloom.MAX_BYTES,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row for each word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF of which A-Z are lowered; those of at least
    ``min_length`` letters that occur at least ``min_count`` times make up the vocabulary, and
    ``n`` is how often.  Two words are near if one insertion, deletion or replacement of a
    letter makes one the other; ``n_near`` counts the near words.  A word's ``form`` is the most
    frequent of these, of equal ones the first by code points, if that occurs at least
    ``ratio`` (2 or more) times as often: ``form_n`` times; else null.  ``root`` is the last of its form's
    forms, or the word itself.

    With ``typo_every``, a letter is deleted from a run of a document where that number divides
    the crc32 of ``<number of the document>:<run>``: the one at that crc32 modulo the length.  A document
    without a number has an empty one there.

    Null and empty texts have no words; repeated rows count each time; a single very long run
    is one word.  Other columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    counted = keyed(docs, id_col, text_col).mapInArrow(_counted(min_length, typo_every), "word string, n long")
    vocabulary = scratch.save(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "vocabulary")

    lengths = {r.length: r.k for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("k")).collect()}
    used = {r.c for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r.c}
    alphabet = np.array([c for c in ALPHABET.tolist() if chr(c) in used], dtype=np.uint8)
    # As many passes as keep the filters within their bound.
    slices = max(1, -(-sum(lengths.values()) * bloom.BITS_PER_KEY // (8 * filter_bytes)))
    parted = scratch.save(vocabulary.mapInArrow(_in_slice(slices), "word string, n long, part long"), "slices") if slices > 1 else None
    found = None
    for part in range(slices):
        own = parted.where(F.col("part") == part).select("word", "n") if slices > 1 else vocabulary
        counts = {n: -(-k // slices) for n, k in lengths.items()}
        filters = spark.sparkContext.broadcast(bloom.build(own.select("word"), counts, _members(slices), filter_bytes))
        near = vocabulary.mapInArrow(_probe(filters, alphabet, min_length, slices, part), "word string, n long, near string")
        near = near.join(own.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        found = near if found is None else found.unionByName(near)
    both = found.select(
        F.explode(
            F.array(
                F.struct("word", F.col("near").alias("near"), F.col("near_n").alias("k")),
                F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("k")),
            )
        ).alias("e")
    ).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("minus"), "near")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    rows = scratch.save(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        ),
        "rows",
    )
    roots = _roots(rows.where("form IS NOT NULL"), scratch)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
