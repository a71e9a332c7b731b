"""Collocations: phrases whose words stand together more often than apart, by stripes.

The stripe of a first word counts what comes next: for each next word, or next two, how often.
Tasks make stripes of what they read, blocks of stripes meet by a sort, and stripes of
one word are merged element by element.  From this one structure come the counts of phrases (extensions),
those of their parts (prefixes), and for each phrase the most frequent longer one with it inside
(subsumption): the largest element that continues it, and the largest that ends in it.

The text is read once for each length.  The empty prefix has the stripe of all words; a longer
phrase can only be frequent if the two phrases it overlaps are, so entries without both are
left out before they are sorted or shuffled.  Tasks know these by a Bloom filter of bounded
size, whose strangers only add entries that a merged count later drops.

A first word may stand for a third of all words.  The stripe of one with more than its share
is cut by the hash of what follows, so its parts go to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescope.llm import bloom
from citescope.llm import words as W
from citescope.llm.shared import Scratch

#: Bytes at which a piece of a text ends; words do not reach over them.
PIECE_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
PIECE_WORD = ~(PIECE_END | np.isin(np.arange(256), [0x20, 0x09]))
#: Entries that a task holds before it sorts and merges them.
HELD = 1 << 20
#: A prefix has more than its share when it has more than this part of all words; so there
#: are at most as many such prefixes.
SHARE, LEAST_SHARE = 1 << 16, 1 << 20
#: Stripes travel in blocks of first words: at least so many, and of so many words at most.
BLOCKS, BLOCK_WORDS = 1 << 13, 1 << 18
#: First cut of the words of a language before the last one.
SALTS = 64


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each row the number of its language, the languages, and a hash of each."""
    column = column.cast(pa.large_string()).fill_null("und").dictionary_encode()
    names = column.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names]
    return column.indices.to_numpy().astype(np.int64), names, np.array(hashes, dtype=W.U64)


def _keys(words: np.ndarray, language: np.ndarray) -> np.ndarray:
    """A word of a language as one number."""
    return W.mix(words + language, seed=52)


class _Words:
    """Words of a piece of a batch: their spans, languages, and whether the next one follows."""

    def __init__(self, texts: pa.Array, languages: np.ndarray):
        self.raw, ends = W.utf8(texts)
        self.starts, self.stops, firsts = W.word_spans(self.raw, ends, PIECE_WORD)
        self.language = np.repeat(languages, np.diff(firsts))
        cut = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.cumsum(PIECE_END[self.raw], out=cut[1:])
        n = len(self.starts)
        self.followed = np.zeros(n, dtype=bool)
        if n > 1:
            self.followed[:-1] = cut[self.stops[:-1]] == cut[self.starts[1:]]
            last = firsts[1:-1] - 1
            self.followed[last[last >= 0]] = False

    def strings(self) -> pa.Array:
        return W.strings(W.LOWER[self.raw], self.starts, self.stops)


def _vocabulary(seed: int):
    """Words of each language with counts, combined as far as a task can hold them."""

    def emit(held: list[pa.Table], names: list[str], hashes: list[int]) -> pa.RecordBatch:
        merged = pa.concat_tables(held).group_by(["language", "word"]).aggregate([("n", "sum")]).combine_chunks()
        language = merged.column("language").to_numpy()
        word = merged.column("word").combine_chunks()
        raw, ends = W.utf8(word)
        keys = _keys(W.word_hashes(raw, ends[:-1], ends[1:], seed), np.array(hashes, dtype=W.U64)[language])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64)),
                pa.array(names, pa.string()).take(pa.array(language)),
                word.cast(pa.string()),
                merged.column("n_sum").combine_chunks().cast(pa.int64()),
            ],
            names=["key", "lang", "word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        hashes: list[int] = []
        held: list[pa.Table] = []
        for batch in batches:
            of_row, names, name_hashes = _languages(batch.column("lang"))
            for name, h in zip(names, name_hashes.tolist()):
                if number.setdefault(name, len(number)) == len(hashes):
                    hashes.append(h)
            of_row = np.array([number[n] for n in names], dtype=np.int64)[of_row] if len(names) else of_row
            for low, high in W.pieces(batch.column("text")):
                found = _Words(batch.column("text").slice(low, high - low), of_row[low:high])
                table = pa.table({"language": pa.array(found.language), "word": found.strings()})
                counted = table.group_by(["language", "word"]).aggregate([([], "count_all")])
                held.append(counted.rename_columns(["language", "word", "n"]))
                if sum(t.num_rows for t in held) >= HELD // 2 or sum(t.nbytes for t in held) >= 32 << 20:
                    if len(held) > 1:
                        held = [pa.concat_tables(held).group_by(["language", "word"]).aggregate([("n", "sum")]).rename_columns(["language", "word", "n"])]
                    if held[0].num_rows >= HELD // 4 or held[0].nbytes >= 16 << 20:
                        yield emit(held, list(number), hashes)
                        held = []
        if held:
            yield emit(held, list(number), hashes)

    return run


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where in ordered columns a new combination begins."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _counted(columns: list[np.ndarray], n: np.ndarray | None = None) -> list[np.ndarray]:
    """Equal entries as one, ordered, with their number, or the sum of ``n``, behind them."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(_starts(columns))
    if n is None:
        sums = np.diff(np.append(first, len(order)))
    else:
        sums = np.add.reduceat(n[order], first) if len(order) else n
    return [*[c[first] for c in columns], sums]


def _names(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def _block_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each block and part, from entries ordered by ``block, part, w1, w2 .., n``."""
    block, part, *entries = columns
    first = np.flatnonzero(_starts([block, part]))
    ends = pa.array(np.append(first, len(block)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[first]), pa.array(part[first].astype(np.int32)), *[pa.ListArray.from_arrays(ends, pa.array(c)) for c in entries]],
        names=["block", "part", *_names(len(entries) - 1), "n"],
    )


def phrase_key(columns: list[np.ndarray]) -> np.ndarray:
    """Several words as one number, for the filter only."""
    if len(columns) == 1:
        return columns[0]
    out = np.zeros(len(columns[0]), dtype=W.U64)
    for k, c in enumerate(columns):
        out = W.mix(out + c.view(W.U64), seed=60 + k)
    return out.view(np.int64)


def _members(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = phrase_key(columns)
    return np.zeros(len(key), dtype=np.int64), key


def _stripes(size: int, frequent, hot: tuple[np.ndarray, np.ndarray], blocks: int, seed: int):
    """Stripes of all first words, in blocks, from the phrases that the filter lets pass."""
    hot_keys, hot_parts = hot

    def merged(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(c) for c in zip(*held)]
        block = (W.mix(words[0].view(W.U64), seed=71) % W.U64(blocks)).astype(np.int64)
        part = np.zeros(len(block), dtype=np.int64)
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, words[0]), len(hot_keys) - 1)
            many = hot_keys[at] == words[0]
            after = phrase_key([c[many] for c in words[1:]]).view(W.U64)
            block[many] = -1 - at[many]
            part[many] = (W.mix(after, seed=70) % hot_parts[at[many]].astype(W.U64)).astype(np.int64)
        return _block_rows(_counted([block, part, *words]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        held: list[list[np.ndarray]] = []
        for batch in batches:
            of_row, _, hashes = _languages(batch.column("lang"))
            of_row = hashes[of_row] if len(hashes) else of_row.astype(W.U64)
            for low, high in W.pieces(batch.column("text")):
                found = _Words(batch.column("text").slice(low, high - low), of_row[low:high])
                keys = _keys(W.word_hashes(found.raw, found.starts, found.stops, seed), found.language).view(np.int64)
                # Where phrases of ``size`` words begin that may be frequent.
                begin = len(keys) - size + 1
                if begin < 2:
                    continue
                may = known.holds(phrase_key([keys[k : begin + k] for k in range(size)]))
                for k in range(size - 1):
                    may &= found.followed[k : begin + k]
                at = np.flatnonzero(may[:-1] & may[1:] & found.followed[size - 1 : begin + size - 2])
                held.append([keys[at + k] for k in range(size + 1)])
                if sum(len(h[0]) for h in held) >= HELD:
                    yield merged(held)
                    held = []
        if held:
            yield merged(held)

    return run


def _merge(size: int, least: int):
    """Merges stripes of equal block and part, which come one after another.

    Entries below ``least`` are dropped once they are whole.  The block that reaches over a
    batch is carried on."""
    names = _names(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.zeros(0, dtype=np.int64)] * (size + 4)

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keep = columns[-1] >= least
            if keep.any():
                yield _block_rows([c[keep] for c in columns])

        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("n").value_lengths().to_numpy()
            keys = [np.repeat(batch.column(c).to_numpy().astype(np.int64), times) for c in ("block", "part")]
            entries = [*keys, *[batch.column(c).flatten().to_numpy() for c in (*names, "n")]]
            columns = [np.concatenate(pair) for pair in zip(carried, entries)]
            columns = _counted(columns[:-1], columns[-1])
            last = (columns[0] == columns[0][-1:]) & (columns[1] == columns[1][-1:])
            carried = [c[last] for c in columns]
            yield from done([c[~last] for c in columns])
        yield from done(carried)

    return run


def _hot(words: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with more than their share, and into how many parts the stripe of each is cut."""
    share = max(LEAST_SHARE, total // SHARE)
    rows = words.where(F.col("n") > share).select("w1", "n").collect()
    keys = np.array([r.w1 for r in rows], dtype=np.int64)
    parts = np.array([-(-r.n // share) for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], parts[order]


def _scored(counts: dict[int, DataFrame], size: int) -> DataFrame:
    """``w1.., a, l, r, score`` of all candidates of ``size`` words, in whole numbers of 38 digits."""
    names = _names(size)
    rows = counts[size].withColumnRenamed("n", "a")
    cuts = []
    for k in range(1, size):
        first = counts[k].select(*[f"w{i}" for i in range(1, k + 1)], F.col("n").alias(f"l{k}"))
        rest = counts[size - k].select(*[F.col(f"w{i}").alias(f"w{i + k}") for i in range(1, size - k + 1)], F.col("n").alias(f"r{k}"))
        rows = rows.join(first, names[:k]).join(rest, names[k:])
        score = F.expr(
            f"(1000000 * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0)))"
        )
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    # The smallest score, and of equal ones the first cut.
    return rows.select(*names, "a", F.array_min(F.array(*cuts)).alias("cut")).select(*names, "a", "cut.l", "cut.r", "cut.score")


def _without_subsumed(rows: DataFrame, longer: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates without a longer one by a word, on either side, that has most of their places.

    A still longer one is not more frequent than the one between."""
    names = _names(size)
    on_right = longer.select(*names, F.col("n").alias("longer"))
    on_left = longer.select(*[F.col(c).alias(n) for c, n in zip(_names(size + 1)[1:], names)], F.col("n").alias("longer"))
    most = on_right.unionByName(on_left).groupBy(*names).agg(F.max("longer").alias("longer"))
    return rows.join(most, names, "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = 3,
    min_count: int = 10,
    subsumed_percent: int = 50,
    top: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A-Z count as a-z.  Texts end pieces at ``. , ; : ! ?`` and at line ends, tabulators of
    lines and pages; the words of a piece stand between spaces and tabulators.  A candidate is
    a phrase of 2 to ``max_words`` words that stands at least ``min_count`` times within pieces
    of its language, overlapping places included: ``a`` times.  Cut in two, the parts stand
    ``l`` and ``r`` times; its score is the floor of 1,000,000 a a / (l r) at the cut where
    that is smallest, of equal ones the first.  A candidate inside a longer one that has at
    least ``subsumed_percent`` per cent of its places is dropped.  ``n`` counts the words of
    the language.  The order is by score and ``a``, largest first, then by the bytes of the
    phrase, so there are no ties.

    A null text is empty and has no words; a null language is ``und``; a language with no
    candidate has no row.  Repeated rows count each time.  A very long text is cut into arrays
    as one; no other column is read, and an empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    for seed in range(16):
        # Words are numbers from here on; two words that share one are given others.
        vocabulary = scratch.save(
            source.mapInArrow(_vocabulary(seed), "key long, lang string, word string, n long")
            .groupBy("key")
            .agg(F.min(F.struct("lang", "word")).alias("it"), F.max(F.struct("lang", "word")).alias("other"), F.sum("n").alias("n")),
            f"vocabulary-{seed}",
        )
        if vocabulary.where("it <> other").isEmpty():
            break
    totals = vocabulary.groupBy("it.lang").agg(F.sum("n").alias("words"))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0

    counts = {1: scratch.save(vocabulary.where(F.col("n") >= min_count).select(F.col("key").alias("w1"), "n", "it.*"), "words")}
    hot = _hot(counts[1], total)
    blocks = max(BLOCKS, total // BLOCK_WORDS)
    for size in range(1, max_words):
        known = counts[size].select(*_names(size))
        frequent = bloom.build(known, {0: known.count()}, _members)
        columns = ["block long, part int", *[f"{c} array<long>" for c in (*_names(size + 1), "n")]]
        made = source.mapInArrow(_stripes(size, spark.sparkContext.broadcast(frequent), hot, blocks, seed), ", ".join(columns))
        stripes = scratch.save(
            made.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_merge(size, min_count), made.schema),
            f"stripes-{size}",
        )
        entry = F.explode(F.arrays_zip(*_names(size + 1), "n")).alias("e")
        counts[size + 1] = stripes.select(entry).select("e.*")

    found = None
    for size in range(2, max_words + 1):
        each = _scored(counts, size)
        if size < max_words:
            each = _without_subsumed(each, counts[size + 1], size, subsumed_percent)
        for k in range(1, size + 1):
            word = counts[1].select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"s{k}"), *(["lang"] if k == 1 else []))
            each = each.join(word, f"w{k}")
        each = each.select("lang", F.concat_ws(" ", *[f"s{k}" for k in range(1, size + 1)]).alias("phrase"), "a", "l", "r", "score")
        found = each if found is None else found.unionByName(each)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each language are among the first of each of its parts.
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    first = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("k", F.row_number().over(part)).where(F.col("k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
