"""Recommendations: from rules over the metrics, or parsed from a model's answer."""

from __future__ import annotations


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions.text import any_of, let, parse_json, strip

REC_TYPE = "array<struct<title:string,description:string,priority:string>>"


def _entry(title, description, priority) -> Expr:
    return F.struct(
        title.alias("title"), description.alias("description"), priority.alias("priority")
    )


def _rule(name: str, *values) -> Expr:
    title, description, priority = fixed.RULES[name]
    if values:
        before, after = description.split("{}")
        text = F.concat(F.lit(before), *values, F.lit(after))
    else:
        text = F.lit(description)
    return _entry(F.lit(title), text, F.lit(priority))


def rule_recommendations(m: dict[str, Expr]) -> Expr:
    """Rules in order.

    ``m``: has_llm_txt, missing_critical, h1, total_headings, word_count,
    missing_elements, json_ld, has_faq.
    """
    missing = m["missing_elements"]
    found = F.array(
        F.when(~m["has_llm_txt"], _rule("llm_txt")),
        F.when(
            F.size(m["missing_critical"]) > 0,
            _rule("meta", F.array_join(m["missing_critical"], ", ")),
        ),
        F.when(m["h1"] == 0, _rule("no_h1"))
        .when(m["h1"] > 1, _rule("many_h1", (m["h1"] - 1).cast("string")))
        .when(
            m["total_headings"] < fixed.FEW_HEADINGS,
            _rule("few_headings", m["total_headings"].cast("string")),
        ),
        F.when(
            m["word_count"] < fixed.SHORT_PAGE_WORDS,
            _rule("short", m["word_count"].cast("string")),
        ),
        F.when(
            F.array_contains(missing, "article") | F.array_contains(missing, "section"),
            _rule("semantic"),
        ),
        F.when(m["json_ld"] == 0, _rule("json_ld")),
        F.when(~m["has_faq"] & (m["word_count"] > fixed.LONG_PAGE_WORDS), _rule("faq")),
    )
    return F.filter(found, lambda r: r.isNotNull())


def fill(recommendations: Expr) -> Expr:
    """Exactly four: a short list takes the filler of each free place."""
    fillers = F.array(*[_entry(*map(F.lit, filler)) for filler in fixed.FILLERS])
    kept = fixed.RECOMMENDATIONS_KEPT
    return F.slice(
        F.concat(
            recommendations,
            F.slice(fillers, F.size(recommendations) + 1, F.lit(len(fixed.FILLERS))),
        ),
        1,
        kept,
    )


# ---------------------------------------------------------------------------------
# model answers


def _json_lines(response: Expr) -> Expr:
    """Answer without code fences, from the first ``[`` line to the last ``]`` line."""
    text = strip(response)
    text = F.regexp_replace(text, r"(?mdU)^```json\s*", "")
    text = F.regexp_replace(text, r"(?mdU)^```\s*", "")
    text = F.regexp_replace(text, r"(?mdU)\s*```$", "")
    marked = let(
        text,
        lambda t: let(
            F.split(t, "\n"),
            lambda lines: F.struct(
                t.alias("text"),
                lines.alias("lines"),
                F.array_position(
                    F.transform(lines, lambda x: strip(x).startswith("[")), True
                )
                .cast("int")
                .alias("start"),
                F.array_position(
                    F.transform(F.reverse(lines), lambda x: strip(x).endswith("]")),
                    True,
                )
                .cast("int")
                .alias("from_end"),
            ),
        ),
    )
    return let(
        marked,
        lambda m: F.when(
            (m["start"] > 0) & (m["from_end"] > 0),
            F.array_join(
                F.slice(
                    m["lines"],
                    m["start"],
                    F.greatest(
                        F.size(m["lines"]) - m["from_end"] + 2 - m["start"], F.lit(0)
                    ),
                ),
                "\n",
            ),
        ).otherwise(m["text"]),
    )


def _value(item: Expr, key: str) -> Expr:
    """A member as text; JSON null reads ``None``."""
    path = f"$.{key}"
    present = F.try_variant_get(item, path, "variant").isNotNull()
    return F.when(
        present, F.coalesce(F.try_variant_get(item, path, "string"), F.lit("None"))
    )


def _entries(items: Expr) -> Expr:
    """Members that are objects with a title and a description."""
    raw = F.transform(
        items,
        lambda v: F.struct(
            _value(v, "title").alias("title"),
            _value(v, "description").alias("description"),
            F.coalesce(_value(v, "priority"), F.lit(fixed.DEFAULT_PRIORITY)).alias(
                "priority"
            ),
        ),
    )
    return F.filter(raw, lambda r: r["title"].isNotNull() & r["description"].isNotNull())


def _clean(text: Expr, spaces: bool) -> Expr:
    text = F.replace(text, F.lit(",,"), F.lit(""))
    if spaces:
        text = F.replace(text, F.lit("  "), F.lit(" "))
    return strip(text)


def _finished(text: Expr) -> Expr:
    """A sentence that stops at an article loses it."""
    return F.when(
        any_of(text.endswith(word) for word in fixed.DANGLING_WORDS),
        F.concat(F.regexp_replace(text, r" [^ ]*$", ""), F.lit(".")),
    ).otherwise(text)


def _strict(items: Expr) -> Expr:
    cleaned = F.transform(
        _entries(items),
        lambda r: _entry(
            _clean(r["title"], True),
            let(_clean(r["description"], True), _finished),
            strip(r["priority"]),
        ),
    )
    return F.filter(
        cleaned,
        lambda r: (r["title"] != "")
        & (F.length(r["description"]) > fixed.MEANINGFUL_LENGTH),
    )


def _relaxed(items: Expr) -> Expr:
    cleaned = F.transform(
        _entries(items),
        lambda r: _entry(
            _clean(r["title"], False),
            _clean(r["description"], False),
            strip(r["priority"]),
        ),
    )
    return F.filter(cleaned, lambda r: (r["title"] != "") & (r["description"] != ""))


def _none() -> Expr:
    return F.empty(REC_TYPE)


def _members(parsed: Expr) -> Expr:
    return F.coalesce(
        F.try_variant_get(parsed, "$", "array<variant>"),
        F.empty("array<variant>"),
    )


def parse_strict(response: Expr) -> Expr:
    """Recommendations of an answer that is one JSON array, at most four."""
    return let(
        F.struct(parse_json(_json_lines(response)).alias("v")),
        lambda p: F.slice(
            F.coalesce(_strict(_members(p["v"])), _none()),
            1,
            fixed.RECOMMENDATIONS_KEPT,
        ),
    )


def parse_loose(response: Expr) -> Expr:
    """For an answer that is not JSON: the first bracketed piece with any entries."""
    pieces = let(
        _json_lines(response),
        lambda text: F.when(
            parse_json(text).isNull(),
            F.regexp_extract_all(text, F.lit(r"(?s)\[.*?\]"), F.lit(0)),
        ).otherwise(F.empty("array<string>")),
    )
    lists = F.transform(pieces, lambda p: let(parse_json(p), lambda v: _relaxed(_members(v))))
    return F.slice(
        F.coalesce(
            F.get(F.filter(lists, lambda found: F.size(found) > 0), F.lit(0)), _none()
        ),
        1,
        fixed.RECOMMENDATIONS_KEPT,
    )


def parse(response: Expr) -> Expr:
    """Strict reading, else the loose one; an empty array when neither finds any."""
    return let(
        parse_strict(response),
        lambda strict: F.when(F.size(strict) > 0, strict).otherwise(
            parse_loose(response)
        ),
    )
