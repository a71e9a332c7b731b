"""Token sequences of fixed capacity by best-fit packing of whole documents.

Documents longer than a sequence are cut into full pieces and a rest, so all pieces have
lengths from 1 to the capacity, and the packing depends only on how many there are of each
length.  Best-fit-decreasing therefore runs on the driver over at most that many numbers: all
bins of equal remaining capacity are alike, whole ranges of them move at once, and a
segment tree over remaining capacities finds the tightest one with room.  Its outcome is the
same as packing piece by piece.  What it returns is, for each length, which ranks go to
which range of bins; ranks come from counts per task, so pieces are never sorted or gathered.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.bins import RoomTree
from citescope.llm.shared import Scratch

#: Bytes of runs of characters that a worker remembers before it starts anew, what an entry
#: takes besides its text and ids, and the longest run that is remembered.
CACHED_BYTES, ENTRY_BYTES, LONGEST = 64 << 20, 110, 64
#: Runs looked up at a time, a character of one byte that lower-case text does not have, and
#: the first one beyond Latin letters.
RUNS, END, BEYOND = 1 << 16, "A", "\u0250"
#: The character that stands for each byte in a byte-level vocabulary: printable ones of
#: Latin-1 for themselves, the others in order from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = iter(range(0x100, 0x200))
BYTE_CHARACTERS = [chr(b if b in _PRINTED else next(_OTHERS)) for b in range(256)]


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, equal to the tokenizer's own.

    For a tokenizer that lowers a text, drops white space and encodes the bytes of each word
    alone, runs of characters between white space are remembered with their ids.  New runs of
    a text are encoded together, by a library that works by rank, where the file's merges have
    their ids in order.  Texts with one of its special strings or with a character that is
    white space by only one of the two definitions, and all texts of any other kind of
    tokenizer, are given to it whole."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        steps = [s.get("type") for s in (found.get("normalizer") or {}).get("normalizers", [])]
        split = next(iter((found.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
        pattern = split.get("pattern", {}).get("Regex", "")
        # White space is dropped if no part of the pattern can match it.
        drops = split.get("behavior") == "Removed" and split.get("invert") and r"[^\s" in pattern
        kinds = [s.get("type") for s in (found.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        plain = steps == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"]
        self.pattern = regex.compile(pattern) if drops and plain else None
        #: The same for runs in lines; the ends of the lines are found as well.
        self.in_lines = regex.compile(f"(?:{pattern})|\n") if drops and plain else None
        spaces = [c for c in map(chr, range(0x3001)) if c.isspace() != bool(regex.match(r"\s", c))]
        self.whole_if = [t["content"] for t in found.get("added_tokens", [])] + spaces
        self.known: dict[str, bytes] = {}
        self.room = CACHED_BYTES
        self.ranked, self.line = _by_rank(found["model"], self.whole_if) if plain else (None, None)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        tokens = self.tokenizer.model.tokenize("".join([BYTE_CHARACTERS[b] for b in word.encode()]))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> bytes:
        # By rank, the time for a word grows with the square of its length.
        if self.ranked is None or not words or max(map(len, words)) > LONGEST:
            made = {word: self._word(word) for word in set(words)}
            return b"".join(map(made.__getitem__, words))
        return np.array(self.ranked.encode_ordinary(END.join(words) + END), dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if run.isascii() or max(run) < BEYOND:
            return self._words(self.pattern.findall(run))
        # Beyond Latin letters two versions of Unicode may see different words.
        if unicodedata.is_normalized("NFC", run):
            return self._whole(run)
        # Lower case has made a sequence that would be composed if it were normalised again.
        return b"".join(map(self._whole, self.pattern.findall(run)))

    def _short(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs of Latin letters, none of them long."""
        if self.ranked is None:
            return {run: self._run(run) for run in runs}
        words = self.in_lines.findall("\n".join([*runs, ""]))
        # An ``END`` after the end of a line is no word, and is passed over.
        ids = np.array(self.ranked.encode_ordinary(END.join(words)), dtype="<u4")
        data, stops = ids.tobytes(), (4 * np.flatnonzero(ids == self.line)).tolist()
        return {run: data[low:high] for run, low, high in zip(runs, [0, *[s + 4 for s in stops]], stops)}

    def _new(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of runs not known yet, of which the short ones are remembered."""
        latin = [r for r in runs if len(r) <= LONGEST and (r.isascii() or max(r) < BEYOND)]
        made = self._short(latin)
        if len(latin) < len(runs):
            made |= {run: self._run(run) for run in runs.difference(made)}
        short = made if len(latin) == len(runs) else {run: ids for run, ids in made.items() if len(run) <= LONGEST}
        self.known.update(short)
        # Beyond Latin-1 a letter takes two bytes or four.
        letters = sum(len(run) * (1 if run.isascii() else 4) for run in short)
        self.room -= ENTRY_BYTES * len(short) + letters + sum(map(len, short.values()))
        return made

    def __call__(self, text: str) -> bytes:
        if self.pattern is None or any(s in text for s in self.whole_if):
            return self._whole(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case goes letter by letter; only sigma has a form that depends on neighbours.
        found = (text.lower() if "Σ" not in text else "".join(map(str.lower, text))).split()
        return b"".join([self._some(found[i : i + RUNS]) for i in range(0, len(found), RUNS)])

    def _some(self, found: list[str]) -> bytes:
        if self.room < 0:
            self.known.clear()
            self.room = CACHED_BYTES
        known, runs = self.known, set(found)
        new = runs.difference(known)
        if new:
            made = self._new(new)
            if any(len(r) > LONGEST for r in new):
                known = {r: made[r] if r in made else known[r] for r in runs}
        return b"".join(map(known.__getitem__, found))


def _by_rank(model: dict, special: list[str]):
    """An encoder of words that end in ``END`` and of line ends, and the id of these.

    Words of lower-case text never hold ``END``, so it can stand for the suffix of a word's
    last token.  Nothing if the file's ids are not in the order of its merges."""
    suffix, vocabulary = model.get("end_of_word_suffix"), model.get("vocab") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
    unusual = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or not suffix or any(model.get(k) for k in unusual):
        return None, None
    byte_of = {c: b for b, c in enumerate(BYTE_CHARACTERS)}

    def written(token: str) -> bytes:
        last = token.endswith(suffix)
        return bytes([byte_of[c] for c in (token[: -len(suffix)] if last else token)]) + END.encode() * last

    try:
        ranks = {written(t): i for t, i in vocabulary.items() if t not in special}
    except KeyError:
        return None, None
    singles = {bytes([b]) for b in range(256)}
    singles |= {b + END.encode() for b in singles}
    # Single bytes and those that end a word come first, then what each merge makes.
    in_order = {ranks.get(s) for s in singles} == set(range(512)) and all(
        vocabulary.get("".join(m)) == 512 + i for i, m in enumerate(merges)
    )
    if not in_order or len(ranks) != 512 + len(merges):
        return None, None
    import tiktoken

    pattern = rf"[^{END}\n]+{END}|\n"
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


_IDS: dict[str, Ids] = {}


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            texts = batch.column("text")
            for low, high in W.pieces(texts):
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for i in range(low, high):
                    tokens = ids(texts[i].as_py() or "") + end
                    for at in range(0, len(tokens), 4 * capacity):
                        cut = tokens[at : at + 4 * capacity]
                        n = len(cut) // 4
                        row.append(i)
                        piece.append(at // (4 * capacity))
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(cut))
                        seen[n] = seen.get(n, 0) + 1
                        rank.append(seen[n] - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([part] * len(row), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, first bin, pieces per bin, offset)``, by length and rank.

    Pieces of one length have ranks from 0; those from ``first rank`` on to the next run's
    go to bins from ``first bin`` on, so many to each, the first of a bin at ``offset``."""
    tree = RoomTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by room, ranges of bins: first, count
    bins, runs = 0, []
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room = capacity
                many = -(-left // (capacity // size))
                first, bins = bins, bins + many
            else:
                first, many = heapq.heappop(open_bins[room])
                tree.add(room, -many)
            # A bin just used is the tightest one until no more pieces go in.
            each = room // size
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            at = capacity - room
            if full:
                runs.append((size, rank, first, each, at))
                _open(tree, open_bins, room - each * size, first, full)
            if rest:
                runs.append((size, rank + full * each, first + full, each, at))
                _open(tree, open_bins, room - rest * size, first + full, 1)
            used = full + (rest > 0)
            if used < many:
                _open(tree, open_bins, room, first + used, many - used)
            rank += full * each + rest
            left -= full * each + rest
    return runs


def _open(tree: RoomTree, open_bins: dict, room: int, first: int, many: int) -> None:
    if room:
        heapq.heappush(open_bins.setdefault(room, []), (first, many))
        tree.add(room, many)


def _placed(runs: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            low = np.searchsorted(table[:, 0], length, side="left")
            high = np.searchsorted(table[:, 0], length, side="right")
            # The last run of the length that begins at or before the rank.
            while len(low) and (high - low > 1).any():
                middle = (low + high) // 2
                right = table[np.minimum(middle, len(table) - 1), 1] <= rank
                wide = high - low > 1
                low, high = np.where(wide & right, middle, low), np.where(wide & ~right, middle, high)
            _, first_rank, first_bin, each, offset = table[low].T
            k = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                    pa.array(first_bin + k // each),
                    pa.array(offset + k % each * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_sequences(
    docs: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  A document is
    its token ids and then ``end_id``; a null text is empty, so it is one piece of length 1.
    Documents longer than ``capacity`` are cut into pieces of that length, the last of which
    may be shorter.  A sequence has at most ``capacity`` tokens and no gaps: ``offset`` is a
    piece's place in it.

    Rows may repeat, numbers may be null, and each row is packed.  Other columns are not
    read.  An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Written once, so a task that runs again replaces its ranks and its rows together.
    pieces = scratch.save(
        source.mapInArrow(
            _cut(tokenizer, capacity, end_id),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long",
        ),
        "pieces",
    )
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(best_fit_runs(totals, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
