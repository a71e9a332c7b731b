"""Words of whole Arrow text columns as 64-bit hashes, computed with array operations.

Texts are handled as UTF-8 bytes.  A set of word bytes splits a text into words, which is
exact as long as the set treats all bytes of a character above U+007F alike.  Work goes
through pieces of bounded size, so memory does not depend on the size of a batch; one
document is never split, so it does depend on the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 20

_ALL = np.arange(256)
SPACE = np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
#: Bytes of words that are whatever stands between white space.
SPACED_WORD = ~SPACE
#: Bytes of words made of digits, letters and all characters above U+007F.
ALNUM_WORD = (
    ((_ALL >= 0x30) & (_ALL <= 0x39))
    | ((_ALL >= 0x41) & (_ALL <= 0x5A))
    | ((_ALL >= 0x61) & (_ALL <= 0x7A))
    | (_ALL >= 0x80)
)
LOWER = _ALL.astype(np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x5851F42D4C957F2D | 3  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    """A number for each byte, A-Z as a-z."""
    return mix(np.arange(256), seed=77 + seed)[LOWER]


#: Bytes hashed at a time, whatever the length of a text.
CHUNK_BYTES = 1 << 16


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``CHUNK_BYTES`` of the base and of its inverse."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        a = np.full(CHUNK_BYTES + 1, base, dtype=U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[ends[0] : ends[-1]] if len(column) else raw[:0]), ends - (ends[0] if len(ends) else 0)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or are one row."""
    _, ends = utf8(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high
        low = high


def word_spans(
    raw: np.ndarray, ends: np.ndarray, word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of its first word.

    The third has one number more than there are texts."""
    return spans(word[raw], ends)


def spans(mask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words that consist of the bytes that ``mask`` marks."""
    inside = np.zeros(len(mask) + 2, dtype=bool)
    inside[1:-1] = mask
    first = inside[1:-1] & ~inside[:-2]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    first[cuts] |= inside[1:-1][cuts]
    last = inside[1:-1] & ~inside[2:]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def strings(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """These spans of UTF-8 bytes, which do not overlap, as texts."""
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, stops, 1)
    data = np.ascontiguousarray(raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; A-Z count as a-z."""
    letters = _letters(seed)
    out = np.zeros(len(starts), dtype=U64)
    up, down = _powers()
    sums = np.zeros(CHUNK_BYTES + 1, dtype=U64)
    low = 0
    while low < len(starts):
        begin = int(starts[low])
        high = int(np.searchsorted(stops, begin + CHUNK_BYTES, side="right"))
        if high == low:
            out[low] = _long_word(raw, begin, int(stops[low]), letters)
            low += 1
            continue
        size = int(stops[high - 1]) - begin
        np.cumsum(letters[raw[begin : begin + size]] * up[:size], out=sums[1 : size + 1])
        at, to = starts[low:high] - begin, stops[low:high] - begin
        out[low:high] = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(U64))
        low = high
    return out


def _long_word(raw: np.ndarray, begin: int, stop: int, letters: np.ndarray) -> np.uint64:
    """The hash of one word of more bytes than are hashed at a time."""
    up, _ = _powers()
    total, power = 0, 1
    for at in range(begin, stop, CHUNK_BYTES):
        part = raw[at : min(at + CHUNK_BYTES, stop)]
        total += int((letters[part] * up[: len(part)]).sum(dtype=U64)) * power
        power = power * int(up[CHUNK_BYTES]) % 2**64
    return mix(np.array([(total + stop - begin) % 2**64], dtype=U64))[0]


def shingles(words: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the hashes of its runs of ``n`` words, in order, with repeats.

    A text of fewer words has one run of them all; a text without words has none."""
    count = len(words)
    runs = np.zeros(count, dtype=U64)
    if count >= n:
        whole = np.zeros(count - n + 1, dtype=U64)
        for k in range(n):
            whole = mix(whole + words[k : count - n + 1 + k], seed=k)
        runs[: count - n + 1] = whole
    out = []
    for low, high in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if high - low >= n:
            out.append(runs[low : high - n + 1])
        elif high > low:
            short = np.zeros(1, dtype=U64)
            for k in range(high - low):
                short = mix(short + words[low + k], seed=k)
            out.append(mix(short, seed=1000 + high - low))
        else:
            out.append(runs[:0])
    return out


def shingle_sets(column: pa.Array, n: int, word: np.ndarray = SPACED_WORD) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for low, high in pieces(column):
        raw, ends = utf8(column.slice(low, high - low))
        starts, stops, firsts = word_spans(raw, ends, word)
        hashes = word_hashes(raw, starts, stops)
        for runs in shingles(hashes, firsts, n):
            yield np.unique(runs)
