"""Text helpers that follow Unicode whitespace rules."""

from __future__ import annotations

from functools import reduce
from html.entities import html5, name2codepoint

from citescope.functions import sql as F
from citescope.functions.sql import Expr


# Every character Unicode (and the four ASCII separators) counts as white space.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
WS = r"[\s\x1c-\x1f]"  # with (?U)
NOT_WS = r"(?U)[^\s\x1c-\x1f]"


def let(value: Expr, body) -> Expr:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda.

    Catalyst shares common subexpressions in a projection but not in a lambda body.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last(items: Expr) -> Expr:
    """Last element, null when there is none."""
    return F.try_element_at(items, F.lit(-1))


def first(items: Expr) -> Expr:
    return F.get(items, F.lit(0))


def strip(text: Expr) -> Expr:
    return F.btrim(text, WHITESPACE)


def word_count(text: Expr) -> Expr:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS + "+")), F.lit(0))


def split_words(text: Expr) -> Expr:
    return F.regexp_extract_all(text, F.lit(NOT_WS + "+"), F.lit(0))


def any_of(conditions) -> Expr:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Expr:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(text: Expr, needles) -> Expr:
    return any_of(text.contains(needle) for needle in needles)


def count_of(text: Expr, needles) -> Expr:
    """How many of the needles occur."""
    return reduce(
        lambda a, b: a + b, (text.contains(needle).cast("int") for needle in needles)
    )


_END = "end of text"


def _plain_numbers(text: Expr) -> Expr:
    """JSON text whose numbers without a value, which Spark refuses, are strings."""
    pieces = F.transform(
        F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"?|[^"]+'), F.lit(0)),
        lambda piece: F.when(piece.startswith('"'), piece).otherwise(
            F.regexp_replace(piece, r"(?<![\w.])-?(?:NaN|Infinity)(?![\w.])", '"$0"')
        ),
    )
    return F.when(
        text.contains("NaN") | text.contains("Infinity"), F.array_join(pieces, "")
    ).otherwise(text)


def parse_json(text: Expr) -> Expr:
    """VARIANT of a text that is JSON from end to end, else null.

    ``try_parse_json`` stops after the first value and accepts what follows it, so the
    text is parsed as the first of two array elements.  ``NaN`` and ``Infinity`` outside
    strings are accepted, and read as strings of that name.  Of repeated keys the last wins
    where the session allows them, which operators see to.
    """
    return let(
        F.try_parse_json(F.concat("[", _plain_numbers(text), f',"{_END}"]')),
        lambda v: F.when(
            (F.try_variant_get(v, "$[1]", "string") == _END)
            & F.try_variant_get(v, "$[2]", "variant").isNull(),
            F.try_variant_get(v, "$[0]", "variant"),
        ),
    )


# ---------------------------------------------------------------------------------
# character references

_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&"


def _named_references() -> dict[str, str]:
    """The classic named references, with and (where HTML allows it) without ``;``."""
    table = {f"&{name};": html5[f"{name};"] for name in name2codepoint}
    table["&apos;"] = "'"
    table.update(
        {f"&{name}": text for name, text in html5.items() if not name.endswith(";")}
    )
    return table


def _further_references() -> dict[str, str]:
    """All other named references of HTML5, as numeric ones."""
    known = _named_references()
    return {
        f"&{name}": "".join(f"&#{ord(char)};" for char in text)
        for name, text in html5.items()
        if f"&{name}" not in known
    }


def _windows_controls() -> dict[str, str]:
    """Code points 128..159, which browsers read as windows-1252."""
    table = {}
    for code in range(0x80, 0xA0):
        try:
            table[f"{code:08X}"] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[f"{code:08X}"] = chr(code)
    return table


def _literal_map(table: dict[str, str]) -> Expr:
    """One folded literal; a ``create_map`` of every entry would bloat the plan."""
    lines = "\x1e".join(f"{key}\x1f{value}" for key, value in table.items())
    return F.str_to_map(F.lit(lines), F.lit("\x1e"), F.lit("\x1f"))


def _decode_reference(piece: Expr) -> Expr:
    """Character of one reference; anything else as it is.

    Code points are compared as eight hexadecimal digits.
    """
    digits = F.regexp_extract(piece, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.lpad(
        F.when(piece.rlike("^&#[xX]"), F.upper(digits)).otherwise(
            F.coalesce(F.conv(digits, 10, 16), "0")
        ),
        8,
        "0",
    )
    unusable = (
        (F.length(digits) > 7)
        | (code == "00000000")
        | (code > "0010FFFF")
        | code.between("0000D800", "0000DFFF")
    )
    named = F.try_element_at(_literal_map(_named_references()), piece)
    return (
        F.when(~piece.startswith("&") | (piece == "&"), piece)
        .when(~piece.startswith("&#"), F.coalesce(named, piece))
        .when(unusable, "\ufffd")
        .when(
            code.between("00000080", "0000009F"),
            F.try_element_at(_literal_map(_windows_controls()), code),
        )
        .otherwise(F.decode(F.unhex(code), "UTF-32"))
    )


def numeric_references(text: Expr) -> Expr:
    """Text whose rarer named references, some two thousand, are numeric ones.

    Done once per page, where it is cut into tokens, so that ``unescape``, which stands in
    many expressions, can do with the classic names.
    """
    return let(
        text,
        lambda t: F.when(~t.contains("&"), t).otherwise(
            F.array_join(
                F.transform(
                    F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)),
                    lambda piece: F.when(
                        piece.rlike("^&[a-zA-Z].*;$"),
                        F.coalesce(
                            F.try_element_at(_literal_map(_further_references()), piece), piece
                        ),
                    ).otherwise(piece),
                ),
                "",
            )
        ),
    )


def unescape(text: Expr) -> Expr:
    """Decode character references; text without ``&`` is passed through.

    Of named references, the classic ones; see ``numeric_references``.
    """
    return let(
        text,
        lambda t: F.when(~t.contains("&"), t).otherwise(
            F.array_join(
                F.transform(
                    F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)),
                    _decode_reference,
                ),
                "",
            )
        ),
    )
