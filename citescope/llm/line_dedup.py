"""Removal of lines that stand in many documents.

1. A pass over the texts gives a 128-bit hash of each line's key with its document and
   position; texts go no further.
2. The hashes are range-partitioned and sorted by (hash, document, position).  Document and
   position are part of the range key, so a line that stands in a third of all documents is
   spread over many partitions.
3. Each partition is read as a stream.  The first document of a hash keeps its lines; the
   lines of later documents go once enough documents are seen.  Only a hash that began in an
   earlier partition cannot be decided there: its lines are passed on with a row of counts,
   and there is at most one such hash, and so at most two rows of counts, per partition.
4. What a document loses becomes one compressed bitmap, which is all that is joined to the
   texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

_SPACE = b" \t\n\x0b\x0c\r"
DECIDED, OPEN, COUNTS = 0, 1, 2
_STREAM = "kind int, a long, b long, doc_id long, row long, pos int, n_docs long, first_doc long, last_doc long"


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z as a-z."""
    return line.strip(_SPACE).lower()


def _code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def _hashes(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for low, high in W.pieces(batch.column("text")):
                row, pos, digest = [], [], []
                for i in range(low, high):
                    for p, line in enumerate((texts[i].as_py() or b"").split(b"\n")):
                        if len(line) >= min_length:
                            key = line_key(line)
                            if len(key) >= min_length and _code_points(key) >= min_length:
                                row.append(i)
                                pos.append(p)
                                digest.append(hashlib.blake2b(key, digest_size=16).digest())
                both = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both[:, 0].copy()),
                        pa.array(both[:, 1].copy()),
                        batch.column("doc_id").take(at),
                        batch.column("row").take(at),
                        pa.array(pos, pa.int32()),
                    ],
                    names=["a", "b", "doc_id", "row", "pos"],
                )

    return run


class _Run:
    """The hash whose lines are being read."""

    def __init__(self, key: tuple[int, int], head: bool, first_doc: int):
        self.key, self.head, self.first_doc = key, head, first_doc
        self.docs, self.last_doc = 0, None
        self.waiting: list[tuple[np.ndarray, ...]] = []


def _stream(min_docs: int):
    """Lines that go, from rows sorted by hash, document and position."""

    def out(kind: int, key: tuple[int, int], doc=(), row=(), pos=(), counts=None) -> pa.RecordBatch:
        n = 1 if counts else len(doc)
        blank = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, dtype=np.int32)),
                pa.array(np.full(n, key[0], dtype=np.int64)),
                pa.array(np.full(n, key[1], dtype=np.int64)),
                blank if counts else pa.array(doc),
                blank if counts else pa.array(row),
                pa.nulls(n, pa.int32()) if counts else pa.array(pos),
                *([pa.array([c], pa.int64()) for c in counts] if counts else [blank] * 3),
            ],
            names=["kind", "a", "b", "doc_id", "row", "pos", "n_docs", "first_doc", "last_doc"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Run | None = None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc, row, pos = (batch.column(c).to_numpy() for c in ("a", "b", "doc_id", "row", "pos"))
            change = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for low, high in zip([0, *change.tolist()], [*change.tolist(), len(a)]):
                key = (int(a[low]), int(b[low]))
                if now is None or now.key != key:
                    # A hash that ends inside the partition and began there needs no counts.
                    if now is not None and now.head:
                        yield out(COUNTS, now.key, counts=(now.docs, now.first_doc, now.last_doc))
                    now, begun = _Run(key, not begun, int(doc[low])), True
                d = doc[low:high]
                new = np.ones(len(d), dtype=bool)
                new[1:] = d[1:] != d[:-1]
                new[0] = d[0] != now.last_doc
                rank = np.cumsum(new) + now.docs
                now.docs, now.last_doc = int(rank[-1]), int(d[-1])
                if now.head:
                    yield out(OPEN, key, d, row[low:high], pos[low:high])
                    continue
                later = rank > 1
                if later.any():
                    now.waiting.append((d[later], row[low:high][later], pos[low:high][later]))
                if now.docs >= min_docs and now.waiting:
                    yield out(DECIDED, key, *(np.concatenate(x) for x in zip(*now.waiting)))
                    now.waiting = []
        if now is not None:
            for rows in now.waiting:
                yield out(OPEN, now.key, *rows)
            yield out(COUNTS, now.key, counts=(now.docs, now.first_doc, now.last_doc))

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for gone in batch.column("gone").to_pylist():
            keep = np.ones(max(gone) // 8 * 8 + 8, dtype=bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array([len(x) for x in batch.column("gone").to_pylist()], pa.int64()),
                pa.array(maps, pa.binary()),
            ],
            names=["doc_id", "row", "n_dropped", "keep_bitmap"],
        )


def kept_lines(text: bytes, keep_bitmap: bytes) -> bytes:
    """The lines whose bit is set; lines beyond the bitmap are kept."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), bitorder="little")
    lines = text.split(b"\n")
    return b"\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        maps = batch.column("keep_bitmap")
        for low, high in W.pieces(batch.column("text")):
            kept, count = [], []
            for i in range(low, high):
                text = texts[i].as_py()
                count.append((text or b"").count(b"\n") + 1)
                kept.append(kept_lines(text, maps[i].as_py()) if maps[i].is_valid else text)
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(count, pa.int64()),
                    part.column("n_dropped").fill_null(0),
                ],
                names=["doc", "kept_text", "n_lines", "n_dropped"],
            )


def _row() -> Column:
    """Tells rows of the same number apart, if their texts differ."""
    return F.xxhash64("text")


def line_bitmaps(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """``doc_id, row, n_dropped, keep_bitmap`` for each document that loses lines.

    A line's key is the line without white space at its ends, A-Z as a-z.  A key of at
    least ``min_length`` code points that stands in at least ``min_docs`` documents loses
    all its lines but those of the largest number.  ``keep_bitmap`` has one bit per line,
    lowest first, up to the last line that goes, compressed with zlib; a set bit keeps the
    line.  ``row`` is ``xxhash64`` of the text.

    Null and empty texts are one empty line and lose nothing.  Rows without a number take
    no part: they neither count nor lose lines.  Rows of the same number are one document.
    Other columns are not read.  An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    source = keyed(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", "text", _row().alias("row"))
    lines = scratch.save(
        source.mapInArrow(_hashes(min_length), "a long, b long, doc_id long, row long, pos int"), "lines"
    )
    order = [F.col("a"), F.col("b"), F.col("doc_id").desc(), F.col("row"), F.col("pos")]
    found = scratch.save(
        lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _STREAM),
        "found",
    )
    scratch.drop("lines")
    before = Window.partitionBy("a", "b").orderBy(F.desc("first_doc"), F.desc("last_doc"))
    # At most two rows for each partition of the range, so this is small and may be broadcast.
    totals = (
        found.where(f"kind = {COUNTS}")
        .withColumn("again", (F.lag("last_doc").over(before) == F.col("first_doc")).cast("long"))
        .groupBy("a", "b")
        .agg(
            (F.sum("n_docs") - F.coalesce(F.sum("again"), F.lit(0))).alias("docs"),
            F.max("first_doc").alias("keeper"),
        )
        .where(F.col("docs") >= min_docs)
    )
    opened = (
        found.where(f"kind = {OPEN}")
        .select("a", "b", "doc_id", "row", "pos")
        .join(F.broadcast(totals), ["a", "b"])
        .where("doc_id <> keeper")
    )
    gone = found.where(f"kind = {DECIDED}").select("doc_id", "row", "pos").unionByName(opened.select("doc_id", "row", "pos"))
    return scratch.save(
        gone.groupBy("doc_id", "row")
        .agg(F.collect_set("pos").alias("gone"))
        .mapInArrow(_bitmaps, "doc_id long, row long, n_dropped long, keep_bitmap binary"),
        "bitmaps",
    )


def cleaned(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``doc, kept_text, n_lines, n_dropped``: each row once, its other columns in ``doc``.

    ``line_bitmaps`` gives the rule and its cases; ``n_lines`` counts lines before dropping.
    A null text stays null.  Columns may have any names."""
    maps = line_bitmaps(docs, id_col=id_col, text_col=text_col, **options)
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"),
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("row"),
    )
    joined = rows.join(maps, ["doc_id", "row"], "left").select("doc", "text", "n_dropped", "keep_bitmap")
    schema = (
        T.StructType([joined.schema["doc"]])
        .add("kept_text", "string")
        .add("n_lines", "long")
        .add("n_dropped", "long")
    )
    return joined.mapInArrow(_apply, schema)


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without the lines that ``line_bitmaps`` drops; same rows, same columns."""
    return cleaned(docs, id_col=id_col, text_col=text_col, **options).select(
        *[
            F.col("kept_text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
