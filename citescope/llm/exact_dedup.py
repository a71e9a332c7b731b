"""Exact duplicates by composable polynomial fingerprints and a comparison of the texts.

A text's bytes, after runs of white space became one space, are the coefficients of a
polynomial that is evaluated at four points modulo a 31-bit prime: 124 bits together.  A
text is cut into chunks from its end; each chunk is hashed alone, and the hash of a whole is
the sum of its chunks' hashes, each shifted by the length that follows it.  So chunks of a
huge text can be hashed anywhere and in any order, and the hashes of two texts give the hash
of their concatenation (``combine``).

Texts of equal length and fingerprint are then compared byte by byte: their chunks are
spread by (fingerprint, salt, chunk) and sorted by document, each task holds one chunk and
compares those that follow.  The first of each salt meet in a second, small round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.llm import words as W
from citescope.llm.shared import Scratch, keyed

PRIME = 2**31 - 1
POINTS = np.array([48271, 69621, 1132489760, 1226874159], dtype=np.int64)
#: Products are below 2**39, so sums over a chunk are exact in a 53-bit float.
CHUNK = 4096
COMPARED = 1 << 20


def _table(step: int, count: int) -> np.ndarray:
    """Powers 0, step, 2 * step ... of the four points, as rows."""
    out = np.ones((count, len(POINTS)), dtype=np.int64)
    factor = np.array([pow(int(p), step, PRIME) for p in POINTS], dtype=np.int64)
    for i in range(1, count):
        out[i] = out[i - 1] * factor % PRIME
    return out


_WITHIN = _table(1, CHUNK)[::-1].astype(np.float64)
_SHIFTS = _table(CHUNK, 1)


def _shifts(count: int) -> np.ndarray:
    global _SHIFTS
    if count > len(_SHIFTS):
        _SHIFTS = _table(CHUNK, max(count, 2 * len(_SHIFTS)))
    return _SHIFTS


def combine(left: np.ndarray, right: np.ndarray, right_length: int) -> np.ndarray:
    """Hash of a concatenation from the hashes of its parts and the length of the second."""
    shift = np.array([pow(int(p), right_length, PRIME) for p in POINTS], dtype=np.int64)
    return (left * shift + right) % PRIME


def polynomials(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Four hashes of each text, as rows; texts lie in ``raw`` between ``ends``."""
    size = np.diff(ends)
    chunks = np.maximum(1, -(-size // CHUNK))
    last = np.cumsum(chunks) * CHUNK
    # Each text ends at a chunk border; zeros before it change nothing.
    laid = np.zeros(int(last[-1]) if len(last) else 0, dtype=np.uint8)
    laid[np.arange(len(raw)) + np.repeat(last - ends[1:], size)] = raw
    hashes = (laid.reshape(-1, CHUNK).astype(np.float64) @ _WITHIN % PRIME).astype(np.int64)
    first = np.cumsum(chunks) - chunks
    follow = np.repeat(first + chunks - 1, chunks) - np.arange(int(chunks.sum()))
    moved = hashes * _shifts(int(chunks.max(initial=1)))[follow] % PRIME
    return np.add.reduceat(moved, first, axis=0) % PRIME if len(first) else moved


def one_space(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space as one space."""
    space = W.SPACE[raw]
    again = np.zeros(len(raw), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    cuts = ends[1:-1]
    again[cuts[cuts < len(raw)]] = False
    kept = np.where(space, np.uint8(0x20), raw)[~again]
    return kept, np.concatenate([[0], np.cumsum(~again)])[ends]


def _fingerprints(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in W.pieces(batch.column("text")):
                part = batch.slice(low, high - low)
                raw, ends = one_space(*W.utf8(part.column("text")))
                four = polynomials(raw, ends)
                data = raw.tobytes()
                texts = [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                ids = part.column("doc_id")
                if with_text:
                    # Rows without a number are told apart by what they hold.
                    ids = pc.coalesce(ids, pa.array(four[:, 0] ^ four[:, 3]))
                columns = [
                    ids,
                    pa.array(np.diff(ends)),
                    pa.array(four[:, 0] << 31 | four[:, 1]),
                    pa.array(four[:, 2] << 31 | four[:, 3]),
                ]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()))
                else:
                    columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_bytes", "fp_a", "fp_b", "data" if with_text else "text_sha256"]
                )

    return run


_KEY = ["n_bytes", "fp_a", "fp_b"]
_HEADS = "kind int, n_bytes long, fp_a long, fp_b long, chunk int, doc_id long, like_doc long, data binary"
DIFFERS, HEAD = 0, 1


def _compare(keep_heads: bool):
    """Rows sorted by (fingerprint, salt, chunk, document): names what differs from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, []
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in (*_KEY, "salt", "chunk", "doc_id")}
            data = batch.column("data")
            rows = []
            for i in range(batch.num_rows):
                key = tuple(columns[c][i] for c in (*_KEY, "salt", "chunk"))
                chunk, doc = data[i].as_buffer(), columns["doc_id"][i]
                if key != at:
                    at, seen = key, []
                like = next((d for d, c in seen if c.equals(chunk)), None)
                if like is None:  # no number is null here
                    seen.append((doc, pa.py_buffer(chunk.to_pybytes())))
                    if keep_heads:
                        rows.append((HEAD, *key[:3], key[4], doc, doc, chunk.to_pybytes()))
                    like = doc
                if like != seen[0][0]:
                    rows.append((DIFFERS, *key[:3], key[4], doc, like, None))
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    names=["kind", *_KEY, "chunk", "doc_id", "like_doc", "data"],
                )

    return run


def _spread(rows: DataFrame) -> DataFrame:
    key = [*_KEY, "salt", "chunk"]
    return rows.repartition(*key).sortWithinPartitions(*key, "doc_id")


def collisions(source: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, n_bytes, fp_a, fp_b, class``: texts that differ from others of their fingerprint.

    Rows without a number have one made of their fingerprint.  Texts of equal fingerprint and equal ``class`` are equal; those without a row here equal
    the text of the smallest number."""
    several = groups.where("group_size > 1").select(*_KEY, "group_size")
    texts = (
        source.mapInArrow(_fingerprints(True), "doc_id long, n_bytes long, fp_a long, fp_b long, data binary")
        .join(several, _KEY)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.sqrt("group_size"))))
    )
    step = F.lit(COMPARED)
    chunks = texts.select(
        "doc_id", *_KEY, "salt", "data",
        F.explode(F.sequence(F.lit(0), F.floor(F.col("n_bytes") / step).cast("int"))).alias("chunk"),
    ).withColumn("data", F.expr(f"substring(data, chunk * {COMPARED} + 1, {COMPARED})"))
    first = scratch.save(_spread(chunks).mapInArrow(_compare(True), _HEADS), "heads")
    heads = first.where(f"kind = {HEAD}").withColumn("salt", F.lit(0).cast("long"))
    second = scratch.save(_spread(heads.drop("like_doc", "kind")).mapInArrow(_compare(False), _HEADS), "second")
    odd_heads = second.where(f"kind = {DIFFERS}").select(*_KEY, "chunk", F.col("doc_id").alias("head"), "like_doc")
    if odd_heads.isEmpty():
        return source.sparkSession.createDataFrame([], "doc_id long, n_bytes long, fp_a long, fp_b long, class string")
    # Some fingerprint has several texts: name the class of every chunk of its documents.
    odd = odd_heads.select(*_KEY).distinct()
    of_first = _spread(chunks.join(odd, _KEY, "left_semi")).mapInArrow(_named, "doc_id long, n_bytes long, fp_a long, fp_b long, chunk int, head long")
    return (
        of_first.join(odd_heads, [*_KEY, "chunk", "head"])
        .groupBy("doc_id", *_KEY)
        .agg(F.array_sort(F.collect_set(F.struct("chunk", "like_doc"))).cast("string").alias("class"))
    )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the first document of its salt that has the same bytes there."""
    at, seen = None, {}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in (*_KEY, "salt", "chunk", "doc_id", "data")}
        head = []
        for i in range(batch.num_rows):
            key = tuple(columns[c][i] for c in (*_KEY, "salt", "chunk"))
            if key != at:
                at, seen = key, {}
            head.append(seen.setdefault(columns["data"][i], columns["doc_id"][i]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", *_KEY, "chunk")] + [pa.array(head, pa.int64())],
            names=["doc_id", *_KEY, "chunk", "head"],
        )


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``.

    Texts are equal if they are identical after each run of ASCII white space became one
    space; null counts as empty.  ``keep_id`` is the smallest number of a group, ``kept``
    tells whether the row has it, ``text_sha256`` is of the text so changed, in UTF-8.

    Rows that share both number and text are kept together.  A row without a number never
    names a group that has a numbered row; a group without any number has a null
    ``keep_id`` and is kept.  Other columns are not read.  An empty table gives an empty
    result."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    source = keyed(docs, id_col, text_col)
    prints = scratch.save(
        source.mapInArrow(_fingerprints(False), "doc_id long, n_bytes long, fp_a long, fp_b long, text_sha256 string"),
        "prints",
    )

    def grouped(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    groups = scratch.save(grouped(prints, *_KEY), "groups")
    odd = collisions(source, groups, scratch)
    key: list[str] = list(_KEY)
    if not odd.isEmpty():
        odd = scratch.save(odd, "odd").withColumnRenamed("doc_id", "number")
        number = F.coalesce("doc_id", F.shiftright("fp_a", 31).bitwiseXOR(F.col("fp_b").bitwiseAND(F.lit(2**31 - 1))))
        prints = prints.withColumn("number", number).join(odd, ["number", *_KEY], "left").withColumn("class", F.coalesce("class", F.lit("")))
        key.append("class")
        groups = grouped(prints, *key)
    scratch.drop("heads", "second")
    return prints.join(groups, key).select(
        "doc_id",
        "keep_id",
        "group_size",
        _kept().alias("kept"),
        "text_sha256",
    )


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
