"""Structure metrics of a page.

Regular-expression counts over the rendered source and the readable text: projections
without a shuffle.  A pattern is a slow scan of the whole source, so it runs only where
plain substrings of the lower-cased source say that it can match at all.  ``Source``
holds what that needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions.text import (
    NOT_WS,
    WS,
    all_of,
    any_of,
    contains_any,
    word_count,
)


@dataclass(frozen=True)
class Source:
    """A page source with its lower-cased form.

    ``exotic`` is true when that form has letters that match an ASCII letter regardless
    of case without being lower-cased to it; substring tests then decide nothing.
    """

    html: Expr
    low: Expr
    exotic: Expr

    def may_match(self, *needles) -> Expr:
        """Any needle occurs; a needle that is a tuple asks for all of its parts."""
        return self.exotic | any_of(
            all_of(self.low.contains(part) for part in needle)
            if isinstance(needle, tuple)
            else self.low.contains(needle)
            for needle in needles
        )

    def count(self, pattern: str, *needles) -> Expr:
        return F.coalesce(
            F.when(self.may_match(*needles), F.regexp_count(self.html, pattern)).otherwise(
                0
            ),
            0,
        )


def lowered(html: Expr) -> Expr:
    return F.lower(F.coalesce(html, ""))


def exotic(low: Expr) -> Expr:
    return contains_any(low, ["\u017f", "\u0131", "i\u0307"])


def _present(labelled) -> Expr:
    """Labels whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(condition, F.lit(label)) for label, condition in labelled]),
        lambda label: label.isNotNull(),
    )


def content_metrics(text: Expr) -> dict[str, Expr]:
    return {
        "word_count": word_count(text),
        "paragraph_count": F.size(
            F.filter(F.split(text, "\n\n"), lambda p: p.rlike(NOT_WS))
        ),
        "content_length": F.length(text),
    }


def heading_counts(source: Source) -> dict[str, Expr]:
    return {
        f"h{level}": source.count(
            fixed.HEADING_PATTERN.format(level=level), f"</h{level}>"
        )
        for level in fixed.HEADING_LEVELS
    }


def heading_structure(counts: dict[str, Expr]) -> dict[str, Expr]:
    return {
        "total": reduce(lambda a, b: a + b, counts.values()),
        "issues": _present(
            [("missing_h1", counts["h1"] == 0), ("multiple_h1", counts["h1"] > 1)]
        ),
    }


def semantic_counts(source: Source) -> dict[str, Expr]:
    return {
        tag: source.count(fixed.SEMANTIC_PATTERN.format(tag=tag), f"<{tag}")
        for tag in fixed.SEMANTIC_TAGS
    }


def semantic_elements(counts: dict[str, Expr]) -> dict[str, Expr]:
    used = reduce(lambda a, b: a + b, ((n > 0).cast("int") for n in counts.values()))
    return {
        "semantic_score": used / F.lit(float(len(counts))),
        "missing_elements": _present([(tag, n == 0) for tag, n in counts.items()]),
    }


def meta_completeness(present: dict[str, Expr]) -> dict[str, Expr]:
    """``present`` says for each tag whether the page has a non-empty value."""

    def share(tags):
        have = reduce(lambda a, b: a + b, (present[t].cast("int") for t in tags))
        return have / F.lit(float(len(tags)))

    def missing(tags):
        return _present([(tag, ~present[tag]) for tag in tags])

    return {
        "critical_completeness": share(fixed.CRITICAL_TAGS),
        "social_completeness": share(fixed.SOCIAL_TAGS),
        "missing_critical": missing(fixed.CRITICAL_TAGS),
        "missing_social": missing(fixed.SOCIAL_TAGS),
    }


# Substrings of the patterns of the same place in ``fixed.FAQ_PATTERNS``.
_FAQ_NEEDS = [
    ("<div", "faq"),
    ("<section", "faq"),
    ("</h", "?"),
    ("<dt", "?"),
    ("<p", "question"),
    ("<div", "question"),
]
# The same matches as ``fixed.QA_PATTERN``: each ends in the only colon it has, so
# looking back from the colons finds them without a trial at every letter.
_QA_BY_COLON = r"(?iu):(?<=(?:Q|A|Question|Answer):)"


def faq_counts(source: Source) -> dict[str, Expr]:
    counts = [
        (source.count(pattern, needs), question)
        for (pattern, question), needs in zip(
            fixed.FAQ_PATTERNS, _FAQ_NEEDS, strict=True
        )
    ]
    return {
        "faq_sections": reduce(lambda a, b: a + b, (n for n, _ in counts)),
        "question_patterns": reduce(lambda a, b: a + b, (n for n, q in counts if q)),
        "qa_indicators": source.count(
            _QA_BY_COLON, "q:", "a:", "question:", "answer:"
        ),
    }


def has_faq(counts: dict[str, Expr]) -> Expr:
    return (
        (counts["faq_sections"] > 0)
        | (counts["question_patterns"] > fixed.FAQ_QUESTIONS_OVER)
        | (counts["qa_indicators"] > fixed.FAQ_INDICATORS_OVER)
    )


_SCHEMA_NEEDS = {
    "json_ld": [("<script", "application/ld+json")],
    "microdata": ["itemscope", "itemtype", "itemprop"],
    "rdfa": ["property=", "typeof=", "vocab="],
    "faq_schema": [('"@type":', '"faq')],
    "article_schema": [('"@type":', '"article')],
    "organization_schema": [('"@type":', '"organization')],
    "breadcrumb_schema": [('"@type":', '"breadcrumblist')],
}


def schema_counts(source: Source) -> dict[str, Expr]:
    return {
        name: source.count(pattern.replace("{ws}", WS), *_SCHEMA_NEEDS[name])
        for name, pattern in fixed.SCHEMA_PATTERNS.items()
    }


def schema_markup(counts: dict[str, Expr]) -> dict[str, Expr]:
    specific = reduce(lambda a, b: a + b, (counts[n] for n in fixed.SCHEMA_SPECIFIC))
    return {
        "total_markup": reduce(
            lambda a, b: a + b, (counts[n] for n in fixed.SCHEMA_MARKUP)
        ),
        "specific_schemas": specific,
        "has_structured_data": (counts["json_ld"] > 0) | (specific > 0),
    }


def faq_text_unmarked(source: Source, text: Expr) -> Expr:
    """The text speaks of frequent questions but no element is marked as FAQ."""
    marked = source.may_match(("class=", "faq")) & source.html.rlike(
        fixed.FAQ_CLASS_PATTERN
    )
    return text.rlike(fixed.FAQ_TEXT_PATTERN) & ~marked


def structural_issues(
    words: Expr,
    present: dict[str, Expr],
    semantic: dict[str, Expr],
    unmarked_faq: Expr,
    json_ld: Expr,
) -> Expr:
    return _present(
        [
            ("insufficient_content", words < fixed.SHORT_PAGE_WORDS),
            ("missing_title", ~present["title"]),
            ("missing_description", ~present["description"]),
            ("missing_article_tags", semantic["article"] == 0),
            ("missing_main_tag", semantic["main"] == 0),
            ("missing_faq_structure", unmarked_faq),
            ("missing_schema_markup", json_ld == 0),
        ]
    )
