"""llm.txt: candidate addresses, validity, sections, score and embedded content."""

from __future__ import annotations

from functools import reduce


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions import html as H
from citescope.functions.text import (
    all_of,
    any_of,
    contains_any,
    count_of,
    first,
    let,
    parse_json,
    split_words,
    strip,
)
from citescope.functions.urls import normalize_url, root_domain, url_netloc


def site_of(url: Expr) -> Expr:
    """Scheme and host of a page: all that its candidate addresses depend on."""
    return let(
        normalize_url(url),
        lambda full: F.concat(F.regexp_extract(full, "^(https?)://", 1), F.lit("://"), url_netloc(full)),
    )


def candidates(url: Expr) -> Expr:
    """Addresses where a site may keep its llm.txt, in the order they are tried.

    Sub-domains are tried only when none of their words occurs in the host.
    """
    full = normalize_url(url)
    return let(
        F.struct(
            F.regexp_extract(full, "^(https?)://", 1).alias("scheme"),
            url_netloc(full).alias("host"),
        ),
        lambda u: F.array_distinct(
            F.flatten(
                F.transform(
                    F.concat(
                        F.array(u["host"]),
                        F.when(
                            contains_any(u["host"], fixed.LLM_SUBDOMAINS),
                            F.empty("array<string>"),
                        ).otherwise(
                            F.array(
                                *[
                                    F.concat(F.lit(sub + "."), root_domain(u["host"]))
                                    for sub in fixed.LLM_SUBDOMAINS
                                ]
                            )
                        ),
                    ),
                    lambda host: F.transform(
                        F.array(*[F.lit(path) for path in fixed.LLM_PATHS]),
                        lambda path: F.concat(u["scheme"], F.lit("://"), host, path),
                    ),
                )
            )
        ),
    )


def fetch_method(address: Expr) -> Expr:
    """Label of a file found at ``address``."""
    host = url_netloc(address)
    path = F.regexp_replace(address, "^[a-z]+://[^/]*", "")
    return F.concat(
        F.lit("direct_fetch_"), F.translate(path, "/", "_"), F.lit("_on_"), host
    )


def _is_valid(content: Expr, raw_length: Expr, text: Expr) -> Expr:
    """``content`` as it is, its stripped length, and its lower-cased stripped text."""
    line_ends = F.length(content) - F.length(F.replace(content, "\n", ""))
    structured = text.contains('"@context"') & text.contains("schema.org")
    plain_json = (
        text.startswith("{")
        & text.endswith("}")
        & contains_any(text, fixed.LLM_JSON_MARKERS)
    )
    ordinary_page = (
        count_of(text, fixed.WEBSITE_TERMS) > fixed.WEBSITE_TERMS_ALLOWED
    ) & ~contains_any(text, fixed.POLICY_TERMS)
    return (
        (raw_length >= fixed.LLM_MIN_LENGTH)
        & ~structured
        & ~plain_json
        & (contains_any(text, fixed.LLM_INDICATORS) | (line_ends > fixed.LLM_LINE_ENDS))
        & ~ordinary_page
    )


def is_valid(content: Expr) -> Expr:
    """Whether a text reads like an llm.txt file.

    A text of many lines counts as one even if it has no mark of the format."""
    checked = let(
        content,
        lambda whole: let(
            strip(whole),
            lambda raw: let(
                F.struct(F.length(raw).alias("n"), strip(F.lower(raw)).alias("s")),
                lambda v: _is_valid(whole, v["n"], v["s"]),
            ),
        ),
    )
    return F.coalesce(checked, F.lit(False))


def sections(content: Expr) -> Expr:
    """Non-empty lines of a file, each in the first section it fits."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), strip),
        lambda line: line != "",
    )
    labelled = F.transform(
        F.transform(
            lines, lambda line: F.struct(line.alias("line"), F.lower(line).alias("low"))
        ),
        lambda v: F.struct(
            v["line"].alias("line"),
            reduce(
                lambda chain, item: chain.when(
                    contains_any(v["low"], item[1]), F.lit(item[0])
                ),
                fixed.LLM_SECTION_WORDS,
                F.when(v["line"].startswith("#"), F.lit("headers")),
            ).alias("section"),
        ),
    )
    return let(
        labelled,
        lambda all_lines: F.struct(
            *[
                F.transform(
                    F.filter(all_lines, lambda v, s=name: v["section"] == s),
                    lambda v: v["line"],
                ).alias(name)
                for name in fixed.LLM_SECTIONS
            ]
        ),
    )


def score(parts: Expr) -> Expr:
    """Relevance of the sections, 0 to 100."""
    total = reduce(
        lambda a, b: a + b, (F.size(parts[name]) for name in fixed.LLM_SECTIONS)
    )
    points = F.when(total > 0, fixed.LLM_SCORE_ANY).otherwise(0)
    for name, value in fixed.LLM_SCORE_SECTION.items():
        points = points + F.when(F.size(parts[name]) > 0, value).otherwise(0)
    bonus = reduce(
        lambda chain, step: chain.when(total > step[0], step[1]),
        fixed.LLM_SCORE_ITEMS[1:],
        F.when(total > fixed.LLM_SCORE_ITEMS[0][0], fixed.LLM_SCORE_ITEMS[0][1]),
    ).otherwise(0)
    return F.least(points + bonus, F.lit(fixed.LLM_SCORE_MAX))


# ---------------------------------------------------------------------------------
# content embedded in a page: each function gives array<struct<content, source>>


def _found(content: Expr, source) -> Expr:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(content.alias("content"), source.alias("source"))


def from_comments(token_array: Expr) -> Expr:
    texts = F.transform(H.comments(token_array), strip)
    return F.transform(
        F.filter(
            texts,
            lambda c: contains_any(F.lower(c), fixed.LLM_COMMENT_WORDS) & is_valid(c),
        ),
        lambda c: _found(c, "html_comment"),
    )


def from_meta(head_array: Expr) -> Expr:
    metas = F.transform(
        H.pick(head_array, "meta", "content", "name", "property"),
        lambda m: F.struct(
            F.coalesce(m["content"], "").alias("content"),
            F.lower(F.coalesce(m["name"], "")).alias("name"),
            F.lower(F.coalesce(m["property"], "")).alias("property"),
        ),
    )
    return F.transform(
        F.filter(
            metas,
            lambda m: (
                contains_any(m["name"], fixed.LLM_META_NAME_WORDS)
                | contains_any(m["property"], fixed.LLM_META_NAME_WORDS)
                | contains_any(F.lower(m["content"]), fixed.LLM_META_CONTENT_WORDS)
            )
            & is_valid(m["content"]),
        ),
        lambda m: _found(
            strip(m["content"]),
            F.concat(
                "meta_tag_", F.when(m["name"] != "", m["name"]).otherwise(m["property"])
            ),
        ),
    )


def _may_be_marked(token: Expr) -> Expr:
    """Cheap test on a tag's source before its attributes are read.

    A tag with a character reference may spell anything, so it always passes.
    """
    return let(
        F.lower(token["raw"]),
        lambda raw: raw.contains("&")
        | contains_any(raw, ["llm", "ai", "assistant"])
        | (token["tag"].isin(fixed.HIDDEN_TAGS) & raw.contains("style")),
    )


def _selectors(attrs: Expr) -> Expr:
    """Numbers of the selectors an element matches."""
    found = []
    for number, (name, part, _) in enumerate(fixed.LLM_SELECTORS):
        value = H.attribute(attrs, name)
        if name == "class":
            value = F.array_join(split_words(value), " ")
        hit = value.isNotNull() if part is None else value.contains(part)
        found.append(F.when(hit, number))
    return F.filter(F.array(*found), lambda n: n.isNotNull())


def marked_texts(token_array: Expr) -> Expr:
    """array<struct<text, selectors, hidden>> of elements that may hold llm.txt content.

    Attributes are read once per element for both kinds, and pages without such an
    element (most of them) are not searched for element ends.
    """

    def marks(token: Expr) -> Expr:
        return let(
            H.attributes(token["raw"]),
            lambda attrs: F.struct(
                _selectors(attrs).alias("selectors"),
                F.coalesce(
                    token["tag"].isin(fixed.HIDDEN_TAGS)
                    & contains_any(
                        F.lower(H.attribute(attrs, "style")), fixed.HIDDEN_STYLES
                    ),
                    False,
                ).alias("hidden"),
            ),
        )

    def candidate(token: Expr) -> Expr:
        # void elements have no span and no text
        return (
            (token["kind"] == "start")
            & ~token["tag"].isin(H.VOID_TAGS)
            & _may_be_marked(token)
        )

    def marked(m: Expr) -> Expr:
        return m["hidden"] | (F.size(m["selectors"]) > 0)

    chosen = F.filter(
        F.transform(token_array, lambda t: F.when(candidate(t), marks(t))),
        lambda m: m.isNotNull() & marked(m),
    )

    def read(found):
        # spans come in the order of the start tags, one for each of them
        texts = F.transform(
            H.spans(token_array, lambda t, i: candidate(t) & marked(marks(t))),
            lambda s, i: F.struct(
                strip(H.span_text(token_array, s["pos"], s["close"])).alias("text"),
                F.get(found, i).alias("at"),
            ),
        )
        usable = F.filter(texts, lambda e: is_valid(e["text"]))
        return F.when(
            F.size(found) > 0,
            F.transform(
                usable,
                lambda e: F.struct(
                    e["text"], e["at"]["selectors"], e["at"]["hidden"]
                ),
            ),
        ).otherwise(F.empty("array<struct<text:string,selectors:array<int>,hidden:boolean>>"))

    return let(chosen, read)


def from_elements(marked: Expr) -> Expr:
    """Texts of elements whose class, id or data attributes speak of AI.

    An element that matches several selectors is kept once per selector.
    """
    return F.flatten(
        F.array(
            *[
                F.transform(
                    F.filter(
                        marked,
                        lambda e, n=number: F.array_contains(e["selectors"], n),
                    ),
                    lambda e, s=label: _found(e["text"], f"element_{s}"),
                )
                for number, (_, _, label) in enumerate(fixed.LLM_SELECTORS)
            ]
        )
    )


def from_hidden(marked: Expr) -> Expr:
    return F.transform(
        F.filter(marked, lambda e: e["hidden"]),
        lambda e: _found(e["text"], "hidden_element"),
    )


def from_json_ld(bodies: Expr) -> Expr:
    return F.transform(
        F.filter(
            bodies,
            lambda b: contains_any(
                F.lower(F.to_json(parse_json(b))), fixed.LLM_JSON_LD_WORDS
            )
            & is_valid(b),
        ),
        lambda b: _found(b, "json_ld"),
    )


# Substrings that lower-cased text must have for the pattern of the same place to match
# (any of a list; all of a tuple).  They avoid letters with case variants of their own
# outside ASCII, or list those variants.
_TEXT_NEEDS = [
    ["ai:", "a\u0131:", "ai\u0307:", "llm:", "model:", "tant:"],
    ["#"],
    ["truct"],
    ["truct", "rule", ("gu", "del")],
]


def _may_match(lowered: Expr, needs) -> Expr:
    return any_of(
        all_of(lowered.contains(part) for part in need)
        if isinstance(need, tuple)
        else lowered.contains(need)
        for need in needs
    )


def from_text(all_text: Expr) -> Expr:
    """Lines and phrases of the page text that address AI systems.

    The patterns are slow on long texts, so each runs only on texts that can match it.
    """
    matches = let(
        F.struct(all_text.alias("text"), F.lower(all_text).alias("low")),
        lambda t: F.flatten(
            F.array(
                *[
                    F.when(
                        _may_match(t["low"], needs),
                        F.regexp_extract_all(t["text"], pattern, 0),
                    ).otherwise(F.empty("array<string>"))
                    for pattern, needs in zip(
                        fixed.LLM_TEXT_PATTERNS, _TEXT_NEEDS, strict=True
                    )
                ]
            )
        ),
    )
    return F.transform(
        F.filter(matches, is_valid), lambda m: _found(strip(m), "text_pattern")
    )


def embedded(
    token_array: Expr, head_array: Expr, bodies: Expr, marked: Expr, all_text: Expr
) -> Expr:
    """struct<found, content, method, sources>: the six finds joined and checked again."""
    finds = F.concat(
        from_comments(token_array),
        from_meta(head_array),
        from_elements(marked),
        from_json_ld(bodies),
        from_hidden(marked),
        from_text(all_text),
    )
    joined = let(
        finds,
        lambda found: F.struct(
            F.array_join(F.transform(found, lambda f: f["content"]), "\n\n").alias(
                "content"
            ),
            F.transform(found, lambda f: f["source"]).alias("sources"),
        ),
    )
    return let(
        joined,
        lambda j: let(
            is_valid(j["content"]),
            lambda ok: F.struct(
                ok.alias("found"),
                F.when(ok, j["content"]).otherwise("").alias("content"),
                F.when(
                    ok,
                    F.concat(
                        F.lit("html_embedded_"), F.size(j["sources"]), F.lit("_sources")
                    ),
                ).alias("method"),
                F.when(ok, j["sources"])
                .otherwise(F.empty("array<string>"))
                .alias("sources"),
            ),
        ),
    )


