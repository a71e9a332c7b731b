"""Documents that contain passages of benchmark items, found with suffix arrays.

The training texts are cut into shards, pieces of a partition of bounded size.  In each, the
words become numbers of the benchmark's vocabulary (0 for any other word), and the suffixes
that can begin a window are sorted into a suffix array: a window needs a run of known words,
so all other suffixes are left out of it, which changes no result.  Every test suffix, the
run of words that starts at each word of an item, is looked up by binary search, which gives
all its places at once; each place is then followed to the longest verbatim match.

The benchmark is read in blocks of bounded size.  Each block is one more pass over a row, in
place, that adds to what earlier blocks found in it; no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescope.llm import words as W

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20


class TestBlock(NamedTuple):
    """Items of one block: their words as numbers, one after another, with a 0 after each."""

    vocabulary: np.ndarray
    words: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_ids: list[str]
    window: int


def test_block(items: list[tuple[str, str | None]], window: int) -> TestBlock:
    """Windows of items: each run of ``window`` words, or all words of a shorter item."""
    ids, words, item, starts, lengths = [], [], [], [], []
    at = 0
    column = pa.array([text or "" for _, text in items], pa.large_string())
    raw, ends = W.utf8(column)
    begin, stop, firsts = W.word_spans(raw, ends, W.ALNUM_WORD)
    hashes = W.word_hashes(raw, begin, stop)
    for k, (item_id, _) in enumerate(items):
        own = hashes[firsts[k] : firsts[k + 1]]
        ids.append(item_id)
        count = max(1, len(own) - window + 1) if len(own) else 0
        starts.append(at + np.arange(count))
        lengths.append(np.full(count, min(window, len(own))))
        item.append(np.full(count, k))
        words += [own, np.zeros(1, dtype=W.U64)]
        at += len(own) + 1
    flat = np.concatenate(words) if words else np.zeros(0, dtype=W.U64)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, flat).astype(np.uint32) + np.uint32(1)
    breaks = np.cumsum([len(w) for w in words[::2]]) + np.arange(len(items)) if items else []
    numbers[np.asarray(breaks, dtype=np.int64)] = 0
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return TestBlock(vocabulary, numbers, join(item), join(starts), join(lengths), ids, window)


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 and up for words of the vocabulary, 0 for others."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.uint32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)


def _suffixes(numbers: np.ndarray, at: np.ndarray, depth: int, fill: np.ndarray | None = None) -> np.ndarray:
    """The first ``depth`` words at each place as byte strings that sort like the words."""
    padded = np.concatenate([numbers, np.zeros(depth, dtype=np.uint32)])
    table = np.empty((len(at), depth), dtype=">u4")
    for k in range(depth):
        table[:, k] = padded[at + k]
        if fill is not None:  # beyond a shorter window: all zeros or all ones
            beyond = fill[:, 0] <= k
            table[beyond, k] = fill[beyond, 1]
    return table.view(f"S{4 * depth}").ravel()


def matches(numbers: np.ndarray, firsts: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Places in a shard, and for each the window of the block that stands there.

    ``numbers`` are the shard's words, ``firsts`` the first word of each text and the end."""
    none = np.zeros(0, dtype=np.int64)
    if not len(block.starts) or not len(numbers):
        return none, none
    known = numbers > 0
    # Length of the run of known words from each word on, within its text.
    stop = np.concatenate([np.flatnonzero(~known), firsts[1:]])
    stop = np.unique(stop)
    at = np.flatnonzero(known)
    run = stop[np.searchsorted(stop, at, side="right")] - at
    at = at[run >= block.lengths.min()]
    if not len(at):
        return none, none
    # A 0 between texts ends every suffix there.
    texts = np.searchsorted(firsts, at, side="right") - 1
    spaced = np.zeros(len(numbers) + len(firsts), dtype=np.uint32)
    spaced[np.arange(len(numbers)) + np.searchsorted(firsts, np.arange(len(numbers)), side="right") - 1] = numbers
    suffixes = _suffixes(spaced, at + texts, block.window)
    order = np.argsort(suffixes, kind="stable")
    array = suffixes[order]
    # Only test suffixes whose first word begins a suffix of the shard can be found.
    present = np.zeros(len(block.vocabulary) + 1, dtype=bool)
    present[numbers[at]] = True
    tests = np.flatnonzero(present[block.words[block.starts]])
    starts, lengths = block.starts[tests], block.lengths[tests]
    low_key = np.stack([lengths, np.zeros_like(lengths)], axis=1)
    high_key = np.stack([lengths, np.full_like(lengths, 2**32 - 1)], axis=1)
    low = np.searchsorted(array, _suffixes(block.words, starts, block.window, low_key), side="left")
    high = np.searchsorted(array, _suffixes(block.words, starts, block.window, high_key), side="right")
    count = high - low
    window = np.repeat(tests, count)
    place = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return at[order[place]], window


def _longest(numbers: np.ndarray, stop: np.ndarray, place: np.ndarray, begin: np.ndarray, length: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words from each place on that agree with the item from the window on."""
    length = length.copy()
    going = np.arange(len(place))
    while len(going):
        p, q = place[going] + length[going], begin[going] + length[going]
        fits = p < stop[going]
        fits[fits] = numbers[p[fits]] == words[q[fits]]
        fits &= words[np.minimum(q, len(words) - 1)] > 0
        going = going[fits]
        length[going] += 1
    return length


def _ints(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType() if n == "item_id" else T.IntegerType()) for n in names])


_FOUND = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("spans", T.ArrayType(_ints("start", "stop")))
    .add("items", T.ArrayType(T.StringType()))
    .add("longest", _ints("words", "item_id", "doc_word", "item_word"))
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_LONGEST = pa.struct([("words", pa.int32()), ("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32())])


def _scan(block: TestBlock):
    """Adds what a block finds to the rows ``doc, text, n_words, spans, items, longest``."""
    item_first = np.zeros(len(block.item_ids) + 1, dtype=np.int64)
    item_first[1:] = np.flatnonzero(block.words == 0) + 1
    ids = np.array(block.item_ids, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in W.pieces(batch.column("text"), SHARD_BYTES):
                part = batch.slice(low, high - low)
                raw, ends = W.utf8(part.column("text"))
                begin, stop, firsts = W.word_spans(raw, ends, W.ALNUM_WORD)
                numbers = _numbers(W.word_hashes(raw, begin, stop), block.vocabulary)
                place, window = matches(numbers, firsts, block)
                spans, items, longest = (part.column(c).to_pylist() for c in ("spans", "items", "longest"))
                spans, items = [x or [] for x in spans], [x or [] for x in items]
                text = np.searchsorted(firsts, place, side="right") - 1
                by_text = np.argsort(text, kind="stable")
                size = _longest(numbers, firsts[text + 1], place, block.starts[window], block.lengths[window], block.words)
                for own in np.split(by_text, np.flatnonzero(np.diff(text[by_text])) + 1) if len(place) else []:
                    k = int(text[own[0]])
                    hit = np.zeros(firsts[k + 1] - firsts[k] + 1, dtype=np.int32)
                    at = place[own] - firsts[k]
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + block.lengths[window[own]], -1)
                    for span in spans[k]:
                        hit[span["start"]] += 1
                        hit[span["stop"]] -= 1
                    inside = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
                    edge = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
                    spans[k] = [{"start": s, "stop": e} for s, e in zip(edge[::2], edge[1::2])]
                    which = np.unique(block.item[window[own]])
                    items[k] = sorted({*items[k], *ids[which].tolist()})
                    best = own[np.argmax(size[own])]
                    i = int(block.item[window[best]])
                    if longest[k] is None or longest[k]["words"] < size[best]:
                        longest[k] = {
                            "words": int(size[best]),
                            "item_id": ids[i],
                            "doc_word": int(place[best] - firsts[k]),
                            "item_word": int(block.starts[window[best]] - item_first[i]),
                        }
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        part.column("text"),
                        pa.array(np.diff(firsts)),
                        pa.array(spans, _SPANS),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(longest, _LONGEST),
                    ],
                    names=["doc", "text", *_FOUND.names],
                )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks whose texts have about ``block_bytes`` bytes together."""
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def _scanned(docs: DataFrame, carried: list[str], text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
        F.col(text_col).cast("string").alias("text"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in _FOUND],
    )
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        rows = rows.mapInArrow(_scan(test_block(block, window)), rows.schema)
    return rows


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, longest``: one row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of any characters above U+007F, with A-Z
    as a-z.  A window is ``window`` consecutive words of an item, or all words of a shorter
    one.  ``n_hit`` counts the document's words that lie inside a window's occurrence,
    ``spans`` are these stretches in words, ``items`` the sorted ids of items with a window
    in the document, and ``longest`` the longest verbatim match that begins with a window,
    with both places.

    Null and empty texts have no words and are never hit; items that are null, without words
    or without an id have no window.  Rows and items may repeat.  Other columns are not
    read.  An empty table of documents gives an empty result, an empty benchmark no hits."""
    found = _scanned(docs, [id_col], text_col, benchmark, item_col, item_text_col, window, block_bytes)
    return found.select(
        F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), "n_words", _hits().alias("n_hit"), "items", "spans", "longest"
    )


def _hits() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))


def contaminated(per_cent: int = 5) -> Column:
    """Rule over the columns of ``scan``: some words are hit, and at least this share."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= per_cent * F.col("n_words"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    per_cent: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without contaminated rows; same columns, whatever their names."""
    found = _scanned(
        docs, [c for c in docs.columns if c != text_col], text_col, benchmark, item_col, item_text_col, window, block_bytes
    )
    return found.withColumn("n_hit", _hits()).where(~contaminated(per_cent)).select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    )
