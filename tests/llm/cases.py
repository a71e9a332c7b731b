"""Awkward rows that every operator of documents has to take."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, kept boolean, n_lines string, row string, "
    "hub string, `a.b` string, doc string, shard string"
)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(words))


BASE = prose(1, 120)
LINE = "This line is long enough and stands in many documents."

TEXTS: list[tuple[int | None, str | None]] = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace(" ", " \t", 3)),
    (4, BASE.upper()),
    (5, BASE + " one more"),
    (6, None),
    (7, ""),
    (8, " \n\t"),
    (9, "word"),
    (10, "WORD"),
    (11, "two words"),
    (12, "\n".join([LINE, prose(2, 30), LINE])),
    (13, f"  {LINE.upper()} \n{prose(3, 30)}"),
    (14, f"{prose(4, 30)}\n{LINE}"),
    (15, f"{LINE}\n{prose(5, 30)}"),
    (16, f"{LINE}"),
    (17, f"{prose(6, 5)}\n\n{LINE}\r"),
    (18, "Ünïcode ÉTÉ straße " * 3),
    (18, "Ünïcode ÉTÉ straße " * 3),
    (19, prose(7, 40)),
    (19, prose(8, 40)),
    (None, BASE),
    (None, None),
    (20, prose(9, 30_000)),
    (21, "!!! ??? --- 123 456"),
    (22, BASE[:300] + " " + prose(10, 6)),
    (23, BASE[:300] + " " + prose(11, 6)),
]


def documents(spark, texts=None):
    """The texts with columns whose names operators use inside, and one with a dot."""
    rows = [
        (i, t, ("en", "de", None)[k % 3], True, "x", "y", "z", "dot", "d", "s")
        for k, (i, t) in enumerate(TEXTS if texts is None else texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
