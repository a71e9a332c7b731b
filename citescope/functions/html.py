"""HTML as an array of tokens, one row per page.

A page is tokenised once by a single regular expression and stays one row: every
extractor below is a filter or transform over the token array, so page extraction is a
narrow projection and the page source is never shuffled.
"""

from __future__ import annotations


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions.text import last, let, numeric_references, strip, unescape

# Possessive quantifiers keep the matcher iterative (no stack growth on long tags) and
# free of backtracking.
_INSIDE_TAG = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+"""
_TOKEN = (
    r"(?is)<!--.*?-->"
    rf"|<script(?=[\s/>]){_INSIDE_TAG}>.*?(?:</script(?=[\s/>])[^>]*+>|\z)"
    rf"|<style(?=[\s/>]){_INSIDE_TAG}>.*?(?:</style(?=[\s/>])[^>]*+>|\z)"
    rf"|</?[a-z]{_INSIDE_TAG}>"
    r"|<[!?][^>]*+>"
    r"|[^<]++|<"
)
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
_START_TAG = rf"(?s)^<[a-zA-Z][^\s/>]*+({_INSIDE_TAG})>"
_ATTRIBUTE = r"""([^\s/=>"'][^\s/=>]*)(?:\s*=+\s*("[^"]*"|'[^']*'|[^\s>]*))?"""

HEAD_TAGS = ["html", "meta", "link", "img", "script"]
BLOCK_TAGS = (
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr section article header footer "
    "nav main aside form blockquote pre figure body html"
).split()
VOID_TAGS = (
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer keygen menuitem"
).split()


def _token(raw: Expr) -> Expr:
    """Kind and name of a token; the pattern has already told tags from plain ``<``."""

    def token(kind, tag=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            (tag or F.lit(None).cast("string")).alias("tag"),
            raw.alias("raw"),
        )

    def opened(tag):
        whole = tag.isin("script", "style")
        return F.struct(
            F.when(whole, "raw").otherwise("start").alias("kind"),
            tag.alias("tag"),
            raw.alias("raw"),
        )

    name = F.lower(F.regexp_extract(raw, _NAME, 1))
    return (
        F.when(~raw.startswith("<") | (raw == "<"), token("text"))
        .when(raw.startswith("</"), token("end", name))
        .when(raw.startswith("<!--"), token("comment"))
        .when(raw.startswith("<!") | raw.startswith("<?"), token("decl"))
        .otherwise(let(name, opened))
    )


def tokens(html: Expr, as_written: bool = False) -> Expr:
    """array<struct<kind, tag, raw>>; element *i* is the token at position *i*.

    ``raw`` tokens are whole script and style elements, whose body is not markup.  In texts
    and start tags the rarer named references become numeric, unless ``as_written``.
    """
    found = F.transform(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), F.lit(0)), _token
    )
    if as_written:
        return found
    return F.transform(
        found,
        lambda t: F.struct(
            t["kind"],
            t["tag"],
            F.when(t["kind"].isin("text", "start"), numeric_references(t["raw"]))
            .otherwise(t["raw"])
            .alias("raw"),
        ),
    )


def elements(token_array: Expr, *tags: str) -> Expr:
    """Start tags (script and style included) of the given names, in order."""
    return F.filter(
        token_array,
        lambda t: t["kind"].isin("start", "raw") & t["tag"].isin(list(tags)),
    )


def attributes(raw: Expr) -> Expr:
    """array<struct<name, value>> of a start tag: lower-cased names, decoded values."""
    inside = F.regexp_extract(raw, _START_TAG, 1)
    return F.transform(
        F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda text: F.struct(
            F.lower(F.regexp_extract(text, _ATTRIBUTE, 1)).alias("name"),
            let(
                F.regexp_extract(text, _ATTRIBUTE, 2),
                lambda v: unescape(
                    F.when(
                        v.startswith('"') | v.startswith("'"),
                        F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0))),
                    ).otherwise(v)
                ),
            ).alias("value"),
        ),
    )


def attribute(attrs: Expr, name: str) -> Expr:
    """Value of an attribute (the last one if repeated), null when it is absent."""
    return last(F.filter(attrs, lambda a: a["name"] == name))["value"]


def heads(token_array: Expr) -> Expr:
    """array<struct<tag, raw, attrs>> of the elements whose attributes carry page data."""
    return F.transform(
        elements(token_array, *HEAD_TAGS),
        lambda t: F.struct(
            t["tag"], t["raw"], attributes(t["raw"]).alias("attrs")
        ),
    )


def pick(head_array: Expr, tag: str, *names: str) -> Expr:
    """array<struct<name1, name2, ...>>: some attributes of the heads of one name."""
    return F.transform(
        F.filter(head_array, lambda h: h["tag"] == tag),
        lambda h: F.struct(*[attribute(h["attrs"], name).alias(name) for name in names]),
    )


def raw_body(raw: Expr) -> Expr:
    """Body of a script or style element."""
    opened = F.regexp_replace(raw, rf"(?is)^<(?:script|style){_INSIDE_TAG}>", "")
    return F.regexp_replace(opened, r"(?is)</(?:script|style)(?=[\s/>])[^>]*>\z", "")


def comments(token_array: Expr) -> Expr:
    return F.transform(
        F.filter(token_array, lambda t: t["kind"] == "comment"),
        lambda t: F.regexp_replace(t["raw"], r"(?s)^<!--|-->\z", ""),
    )


def joined_text(token_array: Expr) -> Expr:
    """Text of the given tokens; comments, scripts and styles do not count."""
    return unescape(
        F.array_join(
            F.transform(
                F.filter(token_array, lambda t: t["kind"] == "text"),
                lambda t: t["raw"],
            ),
            "",
        )
    )


#: Elements whose text a page's text leaves out.
UNREAD_TAGS = ["template", "rt", "rp"]


def readable(token_array: Expr) -> Expr:
    """The tokens outside of templates and ruby notes; most pages have none of these."""

    def unread(t):
        return (t["kind"] == "start") & t["tag"].isin(UNREAD_TAGS)

    inside = F.flatten(
        F.transform(
            F.filter(
                spans(token_array, lambda t, i: unread(t)),
                lambda s: s["close"] > s["pos"] + 1,
            ),
            lambda s: F.sequence(s["pos"] + 1, s["close"] - 1),
        )
    )
    return F.when(
        F.exists(token_array, unread),
        F.transform(
            F.array_except(F.sequence(0, F.size(token_array) - 1), inside),
            lambda i: F.get(token_array, i),
        ),
    ).otherwise(token_array)


def _position(token_array: Expr, kind: str, tag: str) -> Expr:
    """Position of the first such token counted from 1, 0 when there is none."""
    return F.array_position(
        F.transform(token_array, lambda t: (t["kind"] == kind) & (t["tag"] == tag)), True
    ).cast("int")


def _without_head(token_array: Expr) -> Expr:
    return let(
        F.struct(
            _position(token_array, "start", "head").alias("opened"),
            _position(token_array, "end", "head").alias("closed"),
        ),
        lambda p: F.when(
            (p["opened"] > 0) & (p["closed"] > p["opened"]),
            F.concat(
                F.slice(token_array, 1, p["opened"] - 1),
                F.slice(token_array, p["closed"] + 1, F.size(token_array)),
            ),
        ).otherwise(token_array),
    )


def page_text(token_array: Expr) -> Expr:
    """Readable text: no markup, scripts or head; a blank line between block elements."""
    pieces = F.transform(
        _without_head(readable(token_array)),
        lambda t: F.when(t["kind"] == "text", t["raw"])
        .when(~t["kind"].isin("start", "end"), "")
        .when(t["tag"].isin(BLOCK_TAGS), "\n\n")
        .when(t["tag"] == "br", "\n")
        .otherwise(""),
    )
    text = unescape(F.array_join(pieces, ""))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def title_text(token_array: Expr) -> Expr:
    """Text of the first title element, null when there is none."""
    start = F.array_position(
        F.transform(
            token_array,
            lambda t: (t["kind"] == "start") & (t["tag"] == "title"),
        ),
        True,
    )
    return let(
        start,
        lambda i: F.when(
            i > 0,
            let(
                F.slice(token_array, (i + 1).cast("int"), F.size(token_array)),
                lambda rest: let(
                    F.array_position(
                        F.transform(
                            rest,
                            lambda t: (t["kind"] == "end")
                            & t["tag"].isin("title", "head", "body", "html"),
                        ),
                        True,
                    ),
                    lambda end: strip(
                        joined_text(
                            F.when(
                                end > 0, F.slice(rest, 1, (end - 1).cast("int"))
                            ).otherwise(rest)
                        )
                    ),
                ),
            ),
        ),
    )


def spans(token_array: Expr, wanted) -> Expr:
    """array<struct<pos, close>> of the wanted elements.

    ``wanted(token, position)`` selects start tags.  An end tag closes the nearest open
    element of its name together with everything still open inside; an end tag without
    an open element is ignored; what is open at the end of the page closes there.  Void
    elements never open.

    A fold over the tags keeps the open elements, and what it has closed, as text: Spark
    copies the state of a fold at every step, and a text is copied as one block of memory.
    Tags that cannot matter are left out first: an element that no later end tag can close
    by its name, unless it is wanted, and an end tag before any start tag of its name.
    """
    structural = F.filter(
        F.transform(
            token_array,
            lambda t, i: F.struct(
                i.alias("pos"),
                t["tag"],
                (t["kind"] == "start").alias("open"),
                F.coalesce((t["kind"] == "start") & wanted(t, i), False).alias("wanted"),
                (
                    t["kind"].isin("start", "end") & ~t["tag"].isin(VOID_TAGS)
                ).alias("structural"),
            ),
        ),
        lambda t: t["structural"],
    )
    return let(
        structural,
        lambda items: F.when(
            F.exists(items, lambda t: t["wanted"]),
            _close_positions(_that_matter(items), F.size(token_array)),
        ).otherwise(F.empty("array<struct<pos:int,close:int>>")),
    )


def _that_matter(items: Expr) -> Expr:
    """Without the tags that no other tag can meet."""

    def places(of: Expr, largest: bool) -> Expr:
        """map of tag names to their first or last position."""
        ordered = F.reverse(of) if largest else of
        return let(
            F.struct(
                F.transform(ordered, lambda t: t["tag"]).alias("tags"),
                F.transform(ordered, lambda t: t["pos"]).alias("pos"),
            ),
            lambda x: F.map_from_entries(
                F.transform(
                    F.array_distinct(x["tags"]),
                    lambda tag: F.struct(
                        tag.alias("key"),
                        F.get(x["pos"], (F.array_position(x["tags"], tag) - 1).cast("int")).alias("value"),
                    ),
                )
            ),
        )

    return let(
        F.struct(
            places(F.filter(items, lambda t: t["open"]), False).alias("first_open"),
            places(F.filter(items, lambda t: ~t["open"]), True).alias("last_end"),
        ),
        lambda at: F.filter(
            items,
            lambda t: F.when(
                t["open"],
                t["wanted"] | F.coalesce(F.try_element_at(at["last_end"], t["tag"]) > t["pos"], False),
            ).otherwise(F.coalesce(F.try_element_at(at["first_open"], t["tag"]) < t["pos"], False)),
        ),
    )


def _close_positions(items: Expr, end: Expr) -> Expr:
    """Lines of ``open``: name and, for a wanted element, position.

    Names hold no white space, so line ends and form feeds can part them.  ``done`` has blocks of such lines, each after the position that closes them.
    """
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("done"))

    def block(close: Expr, lines: Expr) -> Expr:
        return F.concat("\f", close, "\n", lines)

    def step(state, t):
        key = F.concat("\n", t["tag"], " ")
        # what was opened after the nearest element of the name; all if there is none
        after = F.substring_index(state["open"], key, -1)
        matched = F.octet_length(after) < F.octet_length(state["open"])
        before = F.substring(
            state["open"].cast("binary"),
            1,
            F.octet_length(state["open"]) - F.octet_length(after) - F.octet_length(key),
        ).cast("string")
        opened = F.concat(
            state["open"], key, F.when(t["wanted"], t["pos"].cast("string")).otherwise("")
        )
        return (
            F.when(
                t["open"],
                F.struct(opened.alias("open"), state["done"].alias("done")),
            )
            .when(
                matched,
                F.struct(
                    before.alias("open"),
                    F.when(
                        after.rlike(r"[0-9](?:\n|\z)"),
                        F.concat(state["done"], block(t["pos"].cast("string"), F.concat("x ", after))),
                    )
                    .otherwise(state["done"])
                    .alias("done"),
                ),
            )
            .otherwise(state)
        )

    def read(text: Expr) -> Expr:
        """The wanted elements of a block."""
        return let(
            F.split(text, "\n"),
            lambda lines: F.transform(
                F.filter(
                    F.transform(
                        F.filter(lines, lambda line, i: i > 0),
                        lambda line: F.substring_index(line, " ", -1),
                    ),
                    lambda pos: pos != "",
                ),
                lambda pos: F.struct(
                    pos.cast("int").alias("pos"),
                    F.get(lines, 0).cast("int").alias("close"),
                ),
            ),
        )

    return F.aggregate(
        items,
        start,
        step,
        lambda state: F.array_sort(
            F.flatten(
                F.transform(
                    F.filter(
                        F.split(
                            F.concat(state["done"], block(end.cast("string"), state["open"])),
                            "\\f",
                        ),
                        lambda text: text != "",
                    ),
                    read,
                )
            )
        ),
    )


def span_text(token_array: Expr, pos: Expr, close: Expr) -> Expr:
    """Text between an element's start tag and its end.

    Tokens are fetched one by one: ``slice`` would copy the page for every element.
    """
    pieces = F.transform(
        F.sequence(pos + 1, close - 1),
        lambda i: let(
            F.get(token_array, i), lambda t: F.when(t["kind"] == "text", t["raw"]).otherwise("")
        ),
    )
    return unescape(
        F.array_join(
            F.when(close - pos > 1, pieces).otherwise(F.empty("array<string>")), ""
        )
    )
