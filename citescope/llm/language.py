"""The language of a text from Bloom filters whose slots are bit masks of languages.

All runs of ``n`` bytes of the training texts (A-Z as a-z, whatever is no letter as a space)
are counted per language.  A run belongs to each language in which it is not much rarer than
where it is most frequent, so passages in another language, names and stray labels do not
count.  One filter serves all languages: a slot holds one bit per language, and the masks of
a run's slots, taken together, give at once every language that contains it.

For a text, the bits are counted per language over its runs.  From each count goes what
false positives add, known from how full the language's bits are; the largest rest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

N = 4
#: Distinct runs that a task gathers before it passes their counts on.
GATHERED = 1 << 20
_FOLD = np.where(
    W.ALNUM_WORD & ~np.isin(np.arange(256), np.arange(0x30, 0x3A)), W.LOWER, np.uint8(0x20)
).astype(np.uint8)


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a column: its rows, runs as 32-bit numbers, and the row of each run.

    A run lies within one text, with two spaces before and one after it, and the last but
    one of its bytes belongs to a letter."""
    for low, high in W.pieces(column):
        raw, ends = W.utf8(column.slice(low, high - low))
        count = high - low
        # Texts one after another, two spaces before each and after the last.
        laid = np.full(len(raw) + 2 * count + N, 0x20, dtype=np.uint32)
        laid[np.arange(len(raw)) + 2 * np.repeat(np.arange(1, count + 1), np.diff(ends))] = _FOLD[raw]
        owner = np.repeat(np.arange(count), np.diff(ends) + 2)
        values = np.zeros(len(owner), dtype=np.uint32)
        for k in range(N):
            values = values << np.uint32(8) | laid[k : k + len(owner)]
        letter = laid[N - 2 : N - 2 + len(owner)] != 0x20
        # The last byte of a run is at most the first space after its text.
        space = (ends[1:] + 2 * np.arange(1, count + 1))[owner]
        fits = letter & (np.arange(len(owner)) + N - 1 <= space)
        yield low, high, values[fits], owner[fits] + low


def _count(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array((keys & W.U64(0xFFFFFFFF)).astype(np.int64)),
                pa.array((keys >> W.U64(32)).astype(np.int32)),
                pa.array(counts),
            ],
            names=["run", "language", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.uint64)
            for _, _, values, owner in runs(batch.column("text")):
                keys, counts = np.unique(of[owner] << W.U64(32) | values.astype(W.U64), return_counts=True)
                kept.append((keys, counts))
                size += len(keys)
                if size > GATHERED:
                    kept = [packed(kept)]
                    size = len(kept[0][0])
                    if size > GATHERED // 2:
                        yield rows(*kept[0])
                        kept, size = [], 0
        if kept:
            yield rows(*packed(kept))

    return run


class Filter(NamedTuple):
    """Slots of language bits, 64 languages to a slice; how full each language's bits are."""

    languages: list[str]
    slices: np.ndarray
    full: np.ndarray
    hashes: int


def _slots(values: np.ndarray, size: int, k: int) -> np.ndarray:
    return (W.mix(values.astype(W.U64), 60 + k) & W.U64(size - 1)).astype(np.int64)


def train(
    docs: DataFrame,
    usable: Column,
    *,
    share: float = 0.2,
    hashes: int = 3,
    slots_per_run: int = 8,
    most_slots: int = 1 << 22,
) -> Filter:
    """The filter of all usable texts of ``docs`` (``doc_id, text, lang``) with a language.

    A run belongs to a language if its rate there is at least ``share`` of its highest rate.
    The filter has about ``slots_per_run`` slots for each run, ``most_slots`` at most: it can
    be sent to every task, and a filter that is fuller corrects for more false positives."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    usable_docs = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    languages = sorted(r.lang for r in usable_docs.select("lang").distinct().collect())
    if not languages:
        return Filter([], np.zeros((0, 1), dtype=W.U64), np.zeros(0), hashes)
    counted = scratch.save(
        usable_docs.mapInArrow(_count(languages), "run long, language int, n long")
        .groupBy("run", "language")
        .agg(F.sum("n").alias("n")),
        "counted",
    )
    totals = {r.language: r.n for r in counted.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(languages))]), F.col("language") + 1)
    rated = counted.withColumn("rate", rate)
    highest = rated.groupBy("run").agg(F.max("rate").alias("highest"))
    members = scratch.save(
        rated.join(highest, "run").where(F.col("rate") >= share * F.col("highest")).select("run", "language"), "members"
    )
    distinct = highest.count()
    size = 1 << min(most_slots.bit_length() - 1, max(10, (slots_per_run * distinct).bit_length()))
    places = members.mapInArrow(_places(size, hashes), "slice int, slot int, mask long")
    found = places.groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    slices = np.zeros((-(-len(languages) // 64), size), dtype=np.int64)
    slices[found["slice"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy()
    slices = slices.view(W.U64)
    full = np.array(
        [np.count_nonzero(slices[i // 64] >> W.U64(i % 64) & W.U64(1)) / size for i in range(len(languages))]
    )
    scratch.drop("counted", "members")
    # No more bytes than the languages need are sent to the tasks.
    narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(64, len(languages)))
    return Filter(languages, slices.astype(narrow), full, hashes)


def _places(size: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("run").to_numpy()
            language = batch.column("language").to_numpy()
            slot = np.concatenate([_slots(values, size, k) for k in range(hashes)])
            language = np.tile(language, hashes)
            mask = (W.U64(1) << (language % 64).astype(W.U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array((language // 64).astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(mask)],
                names=["slice", "slot", "mask"],
            )

    return run


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _predict(model: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = len(model.languages)
        names = np.array([*model.languages, "und"], dtype=object)
        false = model.full**model.hashes
        for batch in batches:
            best = np.full(batch.num_rows, known)
            score = np.zeros(batch.num_rows)
            for low, high, values, owner in runs(batch.column("text")) if known else []:
                slots = [_slots(values, model.slices.shape[1], k) for k in range(model.hashes)]
                total = np.bincount(owner - low, minlength=high - low)
                hits = np.zeros((known, high - low))
                for s, slots_of in enumerate(model.slices):
                    mask = slots_of[slots[0]]
                    for more in slots[1:]:
                        mask = mask & slots_of[more]
                    for i in range(64 * s, min(known, 64 * s + 64)):
                        bit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                        hits[i] = np.bincount(owner - low, bit, minlength=high - low)
                true = np.maximum(0.0, (hits - total * false[:, None]) / np.maximum(1e-9, 1 - false[:, None]))
                best[low:high] = np.argmax(true, axis=0)
                score[low:high] = np.max(true, axis=0) / np.maximum(1e-9, true.sum(axis=0))
            texts = batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if not text or not has_letter(text):
                    best[i], score[i] = known, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    usable: Column | None = None,
    **options,
) -> DataFrame:
    """``doc_id, lang_pred, score``: one row for each row of ``docs``.

    The filter is trained on all rows with a text, a language and ``usable`` (a column over
    ``doc_id``).  ``lang_pred`` is a learned language, or ``und`` if the text is null or has
    no letter, or nothing could be learned.  ``score``, from 0 to 1, is the share of the
    decided language among the corrected counts of all.  Equal counts go to the language
    first in order.  Numbers may be null or repeat; other columns are not read."""
    source = keyed(docs, id_col, text_col)
    labelled = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model = train(labelled, F.lit(True) if usable is None else usable, **options)
    return source.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
