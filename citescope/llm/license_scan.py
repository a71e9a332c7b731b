"""Licence notices in texts: MinHash bands of windows retrieve templates, exact containment decides.

A one-permutation MinHash cuts the hash range into ``bands`` parts; each part's smallest hash
is a band by itself, and a part without a hash has none.  A text is read in windows of as many
shingles as the template's class of sizes, each overlapping the next by half, and a window
retrieves the templates with which it shares a band.  With 1,024 bands a window of similarity
``j`` to a template misses it with a probability of at most (1 - j)^1024, which is 2e-5 at a
similarity of 0.01; of three shingles of a short notice each is the smallest of its part
in a window of sixteen with a probability of 0.99, and each stands in two windows.  So half a notice, or one cut into many pieces, is
retrieved all the same.

A window can only share a band if one of its shingles is a band of a template, so only
windows around such shingles are formed, and texts without any cost one search.

What is retrieved is verified in the whole text: its distinct shingles that stand in the
template are counted exactly, wherever they stand and whatever is inserted between them.

The templates are read in blocks of bounded size, each one more pass over a row in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescope.llm import words as W

BLOCK_BYTES = 8 << 20
#: Parts of the hash range, and the shortest window in shingles; both powers of two.
BANDS, LEAST_WINDOW = 1 << 10, 16


class Templates(NamedTuple):
    ids: list[str]
    #: Distinct shingles of each template.
    sizes: np.ndarray
    #: Sorted shingles of all templates; those of number k have ``owners[firsts[k] : firsts[k + 1]]``.
    known: np.ndarray
    firsts: np.ndarray
    owners: np.ndarray
    #: The same for bands, and the length of the windows that can retrieve each template.
    bands: np.ndarray
    band_firsts: np.ndarray
    band_owners: np.ndarray
    windows: np.ndarray
    parts: int


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers of all sets, where the sets of each begin, and these sets."""
    every = np.concatenate(sets) if sets else np.zeros(0, W.U64)
    order = np.argsort(every, kind="stable")
    known, firsts = np.unique(every[order], return_index=True)
    return known, np.append(firsts, len(every)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]


def minima(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The smallest hash of each part of the hash range that has any, in order."""
    hashes = np.unique(hashes)
    part = hashes >> W.U64(64 - (parts - 1).bit_length())
    return hashes[np.diff(part, prepend=~part[:1]) != 0]


def template_block(rows: list[tuple[str, str]], n: int, parts: int = BANDS) -> Templates:
    column = pa.array([text for _, text in rows], pa.large_string())
    sets = list(W.shingle_sets(column, n, W.ALNUM_WORD))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    windows = np.array([max(LEAST_WINDOW, 1 << int(max(1, k) - 1).bit_length()) for k in sizes.tolist()], dtype=np.int64)
    bands = [minima(W.mix(s, seed=90), parts) for s in sets]
    return Templates([i for i, _ in rows], sizes, *_index(sets), *_index(bands), windows, parts)


def _retrieved(shingles: np.ndarray, templates: Templates) -> np.ndarray:
    """Templates that share a band with a window of the text, as numbers in order."""
    hashes = W.mix(shingles, seed=90)
    at = np.minimum(np.searchsorted(templates.bands, hashes), len(templates.bands) - 1)
    places = np.flatnonzero(templates.bands[at] == hashes)
    if not len(places):
        return places
    owners, which = _expanded(at[places], templates.band_firsts, templates.band_owners)
    length, place = templates.windows[owners], places[which]
    # Each place stands in two windows, which begin at multiples of half their length.
    found = []
    for back in (0, 1):
        number = place // (length // 2) - back
        order = np.lexsort([number, length])
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(length[order]) != 0) | (np.diff(number[order]) != 0)
        for own in np.split(order, np.flatnonzero(new)[1:]):
            if number[own[0]] < 0:
                continue
            begin, size = int(number[own[0]] * (length[own[0]] // 2)), int(length[own[0]])
            shared = minima(hashes[begin : begin + size], templates.parts)
            found.append(owners[own[np.isin(hashes[place[own]], shared)]])
    return np.unique(np.concatenate(found))


def _expanded(numbers: np.ndarray, firsts: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners of these numbers of an index, and for each entry which of the given it is."""
    low, count = firsts[numbers], firsts[numbers + 1] - firsts[numbers]
    which = np.repeat(np.arange(len(numbers)), count)
    return owners[np.arange(len(which)) + np.repeat(low - np.cumsum(count) + count, count)], which


def _shortest(places: list[int], numbers: list[int], wanted: int) -> tuple[int, int]:
    """First and last place of the shortest stretch, of equal ones the first, with all numbers."""
    held: dict[int, int] = {}
    best, low = (places[0], places[-1]), 0
    for place, number in zip(places, numbers):
        held[number] = held.get(number, 0) + 1
        while held[numbers[low]] > 1:
            held[numbers[low]] -= 1
            low += 1
        if len(held) == wanted and place - places[low] < best[1] - best[0]:
            best = (places[low], place)
    return best


def _found(shingles: np.ndarray, templates: Templates, per_cent: int) -> dict[str, tuple[int, int, int]]:
    """For each template in a text: share found, first and last place of these shingles."""
    out: dict[str, tuple[int, int, int]] = {}
    retrieved = _retrieved(shingles, templates)
    if not len(retrieved):
        return out
    at = np.minimum(np.searchsorted(templates.known, shingles), len(templates.known) - 1)
    places = np.flatnonzero(templates.known[at] == shingles)
    at = at[places]
    numbers = np.unique(at)
    owners, which = _expanded(numbers, templates.firsts, templates.owners)
    chosen = np.isin(owners, retrieved)
    owners, which = owners[chosen], which[chosen]
    order = np.argsort(owners, kind="stable")
    near, starts, counts = np.unique(owners[order], return_index=True, return_counts=True)
    enough = 100 * counts >= per_cent * templates.sizes[near]
    for i, start, count in zip(near[enough].tolist(), starts[enough].tolist(), counts[enough].tolist()):
        share = 100 * count // int(templates.sizes[i])
        best = out.get(templates.ids[i])
        if best is None or share > best[0]:
            own = np.isin(at, numbers[which[order[start : start + count]]])
            out[templates.ids[i]] = (share, *_shortest(places[own].tolist(), at[own].tolist(), count))
    return out


_MATCH = T.StructType(
    [T.StructField(k, T.StringType() if k == "template_id" else T.IntegerType()) for k in ("template_id", "per_cent", "first", "last")]
)
_ARROW = pa.list_(pa.struct([("template_id", pa.string()), ("per_cent", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))


def _scan(templates: Templates, n: int, per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches = [list(x or []) for x in batch.column("matches").to_pylist()]
            for low, high in W.pieces(batch.column("text")) if len(templates.known) else []:
                raw, ends = W.utf8(batch.column("text").slice(low, high - low))
                starts, stops, firsts = W.word_spans(raw, ends, W.ALNUM_WORD)
                for i, runs in enumerate(W.shingles(W.word_hashes(raw, starts, stops), firsts, n), low):
                    found = _found(runs, templates, per_cent) if len(runs) else {}
                    matches[i] += [
                        {"template_id": k, "per_cent": share, "first": first, "last": last + n - 1}
                        for k, (share, first, last) in found.items()
                    ]
            matches = [sorted(x, key=lambda m: m["template_id"]) for x in matches]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(matches, _ARROW)], names=["doc_id", "text", "matches"]
            )

    return run


def license_scan(
    docs: DataFrame,
    templates: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    template_col: str = "template_id",
    template_text_col: str = "text",
    n: int = 5,
    per_cent: int = 80,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, matches``: one row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of characters above U+007F, A-Z as a-z.
    A template of k distinct runs of ``n`` words matches a text if at least ``per_cent`` per
    cent of them stand anywhere in it, together or apart; ``matches`` has, by template, the
    share found, rounded down, and the first and last word (from 0) of the shortest stretch
    with all the runs found, of equal stretches the first.
    A shorter template has one run of all its words and only matches a text of just these.

    Null and empty texts match nothing; templates without an id or without words match
    nowhere; templates of equal id are alternatives.  Numbers may be null or repeat.  Other
    columns are not read; an empty table of texts gives an empty result."""
    items = templates.select(
        F.col(template_col).cast("string").alias("template_id"), F.col(template_text_col).cast("string").alias("text")
    ).where("template_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast(T.ArrayType(_MATCH)).alias("matches"),
    )
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("template_id"), F.lit(count)) == k).orderBy("template_id", "text").collect()
        block = template_block([(r.template_id, r.text) for r in part], n)
        rows = rows.mapInArrow(_scan(block, n, per_cent), rows.schema)
    return rows.select("doc_id", "matches")
