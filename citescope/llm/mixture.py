"""Token sequences with a controlled mixture of sources, by deficit round-robin.

Each source is a queue: its documents, one after another, are one stream of tokens.  The
queues are served in units of ``quantum`` tokens.  While a unit is served, the deficit of each queue grows by its
target share of a unit, and the queue served pays one; the next is the queue whose unit falls due
first.  So a queue's deficit always stays within a unit or so, and it is carried from one
window to the next: each window has the target proportions as well as whole units can give
them.  A queue that runs dry leaves the others to share what it would have had.

Nothing of this is done one after another.  The k-th unit of a queue falls due at (2k + 1) h,
with h in inverse proportion to its share, and the number of units of another queue that fall due before
is a division.  So the place of each unit in the sequences follows from the queues' totals
alone, and what a partition carries over to the next is where its part of each stream
begins: a running sum over the tasks that made the tokens.

Tokens are made once, in one pass, and written; their places follow when all are counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.byte_ids import ByteIds
from citescope.llm.shared import Scratch

#: Sources with at least this part of all tokens have a queue of their own, so there are at
#: most as many; where there are more sources, the others share queues by their names.
QUEUES, SHARED = 1024, 256
#: Rows of running sums, 24 bytes each, that are sent to tasks; more are joined by a shuffle.
SENT_ROWS = 400_000
#: Tokens whose places are computed at a time.
TOKENS = 1 << 20


class Plan(NamedTuple):
    """Queues in order: whole units, the tokens after them, and h; and the lengths of sequences."""

    units: np.ndarray
    rests: np.ndarray
    steps: np.ndarray
    quantum: int
    capacity: int

    def total(self) -> int:
        return int(self.units.sum()) * self.quantum + int(self.rests.sum())

    def places(self, queue: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """How many units are served before each of these whole ones."""
        due = (2 * unit + 1) * self.steps[queue]
        out = np.zeros(len(unit), dtype=np.int64)
        for r, (many, step) in enumerate(zip(self.units.tolist(), self.steps.tolist())):
            # Of units due at the same time that of the first queue is served first.
            before = (due // step + 1) // 2
            not_after = -(-due // step) // 2
            out += np.where(queue == r, unit, np.minimum(np.where(queue > r, before, not_after), many))
        return out


def plan(tokens: list[int], weights: list[float], quantum: int, capacity: int) -> Plan:
    """The plan for queues of so many tokens and weights above 0."""
    units = [t // quantum for t in tokens]
    # As fine as 62 bits allow for the last unit that falls due.
    scale = min([w / max(1, u) for w, u in zip(weights, units)], default=1.0)
    steps = [max(1, int((1 << 61) * (scale / w))) for w in weights]
    steps = [min(s, ((1 << 62) - 1) // (2 * u + 1)) for s, u in zip(steps, units)]
    return Plan(
        np.array(units, dtype=np.int64), np.array([t % quantum for t in tokens], dtype=np.int64), np.array(steps, dtype=np.int64), quantum, capacity
    )


def bounds(total: int, capacity: int) -> np.ndarray:
    """Where the sequences after the last full one begin, and the end of all tokens.

    Their lengths are powers of two, so they need no padding."""
    at = total // capacity * capacity
    out, rest = [at], total - at
    for k in reversed(range(capacity.bit_length())):
        if rest >> k & 1:
            at += 1 << k
            out.append(at)
    return np.array(out, dtype=np.int64)


_IDS: dict[str, ByteIds] = {}


def _tokens(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _IDS.get(path) or _IDS.setdefault(path, ByteIds(path))
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            sources, texts = batch.column("source").to_pylist(), batch.column("text")
            for low, high in W.pieces(texts):
                count = high - low
                each = [np.append(tokenizer(t or ""), end_id).astype(dtype) for t in texts.slice(low, count).to_pylist()]
                size = np.array([len(ids) for ids in each], dtype=np.int64)
                whole = np.concatenate(each)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * whole.itemsize
                at = np.zeros(count, dtype=np.int64)
                for i, n in enumerate(size.tolist()):
                    source = sources[low + i]
                    at[i] = seen.get(source, 0)
                    seen[source] = int(at[i]) + n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, count),
                        batch.column("source").slice(low, count),
                        pa.array(np.full(count, part, dtype=np.int32)),
                        pa.array(at),
                        pa.array(size),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(ends), pa.py_buffer(whole)]).cast(pa.binary()),
                    ],
                    names=["doc_id", "source", "part", "at", "size", "ids"],
                )

    return run


def _cut(made: Plan, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents that stand so in their streams.

    ``document, start, length, sequence, offset`` of each piece, by document and start."""
    q, full = made.quantum, made.units[queue] * made.quantum
    first, last = begin // q, (begin + size - 1) // q
    document = np.repeat(np.arange(len(size)), last - first + 1)
    unit = np.arange(len(document)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[document]
    start = np.maximum(unit * q, begin[document])
    length = np.minimum((unit + 1) * q, (begin + size)[document]) - start
    whole = unit < made.units[queue[document]]
    place = np.zeros(len(unit), dtype=np.int64)
    place[whole] = made.places(queue[document][whole], unit[whole]) * q + start[whole] % q
    rest_at = int(made.units.sum()) * q + np.cumsum(made.rests) - made.rests
    place[~whole] = rest_at[queue[document][~whole]] + (start - full[document])[~whole]
    # Units that follow one another in a document and in a window are one piece.
    new = np.ones(len(unit), dtype=bool)
    new[1:] = (document[1:] != document[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] // made.capacity != place[:-1] // made.capacity)
    at = np.flatnonzero(new)
    length = np.add.reduceat(length, at) if len(at) else length
    document, start, place = document[at], (start - begin[document])[at], place[at]
    ends = bounds(made.total(), made.capacity)
    while True:
        number = np.where(place < ends[0], 0, np.searchsorted(ends, place, side="right"))
        stop = np.where(number == 0, (place // made.capacity + 1) * made.capacity, ends[np.minimum(number, len(ends) - 1)])
        over = place + length > stop
        if not over.any():
            break
        room = (stop - place)[over]
        document = np.concatenate([document, document[over]])
        start = np.concatenate([start, start[over] + room])
        place, length = np.concatenate([place, stop[over]]), np.concatenate([np.where(over, stop - place, length), length[over] - room])
    order = np.lexsort([start, document])
    sequence = np.where(number == 0, place // made.capacity, ends[0] // made.capacity + number - 1)
    offset = place - np.where(number == 0, place // made.capacity * made.capacity, ends[np.maximum(number - 1, 0)])
    return tuple(c[order] for c in (document, start, length, sequence, offset))


def _placed(made: Plan, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, queue = batch.column("size").to_numpy(), batch.column("queue").to_numpy().astype(np.int64)
            begin = batch.column("at").to_numpy() + batch.column("before").to_numpy()
            ends = np.cumsum(size)
            low = 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS, side="right")))
                document, start, length, sequence, offset = _cut(made, queue[low:high], begin[low:high], size[low:high])
                crc, last, data = [], -1, b""
                for i, s, n in zip(document.tolist(), start.tolist(), length.tolist()):
                    if i != last:
                        last, data = i, memoryview(np.frombuffer(batch.column("ids")[low + i].as_buffer(), dtype=dtype).astype("<u4")).cast("B")
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                rows = pa.array(low + document)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("source").take(rows),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                        pa.array(size[low + document]),
                        pa.array(sequence),
                        pa.array(offset),
                    ],
                    names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                low = high

    return run


def pack_mixture(
    docs: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str, float] | None = None,
    capacity: int = 2048,
    quantum: int = 64,
    end_id: int = 1,
) -> DataFrame:
    """``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row per piece.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  A document is its
    token ids and then ``end_id``; a null or empty text is just that.  Sequences have
    ``capacity`` tokens, a power of two; what is left after the last full one fills sequences whose lengths are
    powers of two, so nothing is padded.  ``offset`` is a piece's place in its sequence, without gaps.

    ``targets`` gives sources their share of each sequence; those it does not name, and all
    by default, have their share of all tokens, so their queues end together.  A null
    source is a source of its own.  ``quantum`` divides the capacity: tokens served at a time, so the
    least length of most pieces; larger ones cut documents less and follow the shares less
    closely.

    Rows may repeat, numbers may be null, and each row is packed once.  Units due at the same
    time are served in the order of the sources' names.  A document longer than a sequence
    spans several.  Other columns are not read; an empty table gives an empty result."""
    if capacity & (capacity - 1) or capacity % quantum:
        raise ValueError("the capacity must be a power of two, and the quantum divide it")
    scratch = Scratch(docs.sparkSession, "mixture")
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        # A null source is kept apart from every name.
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
    )
    # Written once, so a task that runs again replaces its rows and their places together.
    made = scratch.save(
        source.mapInArrow(_tokens(tokenizer, end_id, dtype), "doc_id long, source string, part int, at long, size long, ids binary"), "tokens"
    )
    parts = scratch.save(made.groupBy("part", "source").agg(F.sum("size").alias("tokens")), "parts")
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    by_source = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    named = {f"={k}": v for k, v in (targets or {}).items()}
    own = by_source.where((F.col("tokens") * QUEUES >= total) | F.col("source").isin(list(named))).select("source", F.col("source").alias("name"))
    shared = F.concat(F.lit("+"), F.crc32("source") % SHARED)
    queued = parts.join(F.broadcast(own), "source", "left").withColumn("name", F.coalesce("name", shared))
    rows = sorted((r.name, r.tokens) for r in queued.groupBy("name").agg(F.sum("tokens").alias("tokens")).collect())
    weights = [named.get(name, tokens / total) for name, tokens in rows]
    if any(not w > 0 for w in weights):
        raise ValueError("shares must be above 0")
    schedule = plan([t for _, t in rows], weights, quantum, capacity)
    number = docs.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(rows)], "name string, queue int")
    before = Window.partitionBy("name").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(
        queued.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .join(F.broadcast(number), "name")
        .select("part", "source", "queue", "before"),
        "starts",
    )
    joined = made.join(F.broadcast(starts) if starts.count() <= SENT_ROWS else starts, ["part", "source"])
    pieces = joined.select("doc_id", "source", "at", "size", "ids", "queue", "before").mapInArrow(
        _placed(schedule, dtype),
        "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumn("source", F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1)))
