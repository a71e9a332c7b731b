from __future__ import annotations

import re

from citescope.functions import advice as A
from citescope.functions.sql import col
from citescope.operators import audit

X = col("x")


def pages(spark, html):
    return spark.createDataFrame(
        [(1, "https://h.example/", html, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )


def test_heading_structure(spark):
    html = "<h2>a</h2>" * 13 + "<H3 class='x'>b\n</H3>" * 24 + "<h5></h5>" * 4 + "<h1>open"
    r = audit.heading_structure(pages(spark, html)).first()
    assert (r.h2, r.h3, r.h5, r.total_headings) == (13, 24, 4, 41)
    assert r.heading_issues == ["missing_h1"]
    many = audit.heading_structure(pages(spark, "<h1>a</h1>" * 2)).first()
    assert many.heading_issues == ["multiple_h1"]


def test_patterns_count_like_the_standard_library(spark):
    html = (
        '<DIV class="my-FAQ x"><ſection><section class="faq"><h3>Why?</h3><dt>How?</dt>'
        '<p class="question">Q: a A: b data: c</p><main><mainland><nav><header></header>'
        '<script type="application/ld+json">{"@type" : 1,"@type": "FAQPage"}</script>'
        '<i itemscope itemtype="t" itemprop="p" property="og:x" typeof="y">'
    )
    r = audit.structure_metrics(pages(spark, html)).first()
    for tag in ["article", "section", "nav", "header", "footer", "main"]:
        assert r[tag] == len(re.findall(rf"<{tag}[^>]*>", html, re.I)), tag
    assert r.faq_schema == 1 and r.microdata == 3 and r.rdfa == 2
    assert r.qa_indicators == len(re.findall("Q:|A:|Question:|Answer:", html, re.I)) == 3
    assert (r.faq_sections, r.question_patterns, r.has_faq) == (5, 2, True)
    assert r.missing_elements == ["article", "footer"]


def test_meta_and_compat(spark):
    page = pages(spark, '<title>t</title><meta name="description" content=""><meta property="og:image" content="i">')
    r = audit.meta_completeness(page).first()
    assert (r.missing_critical, r.missing_social) == (
        ["description"], ["og:title", "og:description"],
    )
    old = audit.meta_completeness(page, compat=True).first()
    assert (old.critical_completeness, old.missing_critical) == (0.0, ["title", "description"])


def test_issues(spark):
    r = audit.structural_issues(pages(spark, "<article>Frequently ever asked</article>")).first()
    assert r.structural_issues == [
        "insufficient_content", "missing_title", "missing_description", "missing_main_tag",
        "missing_faq_structure", "missing_schema_markup",
    ]
    # the dot does not cross lines
    split = audit.structural_issues(pages(spark, "<p>frequently</p><p>asked</p>")).first()
    assert "missing_faq_structure" not in split.structural_issues


SAMPLE = (
    "false AS has_llm_txt, array('title', 'description') AS missing_critical, 0 AS h1, "
    "41 AS total_headings, 737 AS word_count, array('nav', 'header', 'main') AS missing_elements, "
    "0 AS json_ld, false AS has_faq"
)


def recommend(spark, select):
    row = spark.sql(f"SELECT 1L AS page_id, {select}")
    return audit.fill_recommendations(audit.rule_recommendations(row)).first().recommendations


def test_rules_on_the_saved_sample(spark):
    assert [r.title for r in recommend(spark, SAMPLE)] == [
        "Add LLM.txt File", "Add Missing Meta Tags", "Add H1 Heading", "Add JSON-LD Schema",
    ]


def test_fill(spark):
    fine = (
        "true AS has_llm_txt, CAST(array() AS array<string>) AS missing_critical, 1 AS h1, "
        "{} AS total_headings, 400 AS word_count, CAST(array() AS array<string>) AS missing_elements, "
        "1 AS json_ld, false AS has_faq"
    )
    assert [r.title for r in recommend(spark, fine.format(5))] == [
        "Add Meta Description", "Improve Page Structure", "Add Schema Markup",
        "Enhance Content Structure",
    ]
    one = recommend(spark, fine.format(2))
    assert [r.title for r in one][:2] == ["Add More Headings", "Improve Page Structure"]
    assert "(currently 2)" in one[0].description


def titles(rows):
    return [[(r.title, r.description, r.priority) for r in found] for found in rows]


def test_parse(evaluate):
    long = "A description that is long enough"
    cases = {
        f'```json\n[{{"title": "a,,b", "description": "{long}  x the"}}]\n```': [
            ("ab", f"{long} x.", "Medium")
        ],
        f'Sure:\n[{{"title": 1, "description": "{long}", "priority": " High "}}]\nbye': [
            ("1", long, "High")
        ],
        f'[{{"title": null, "description": "{long}"}}]': [("None", long, "Medium")],
        '[{"title": "t", "description": "short"}]': [],
        '{"title": "t"}': [],
        'x [{"title": "a"}] y [{"title": "b", "description": "c"}] z': [("b", "c", "Medium")],
        "no list": [],
        "[": [],
    }
    assert titles(evaluate(A.parse(X), list(cases))) == list(cases.values())
    many = "[" + ",".join(f'{{"title":"t{i}","description":"{long}"}}' for i in range(9)) + "]"
    assert [t for t, _, _ in titles(evaluate(A.parse(X), [many]))[0]] == ["t0", "t1", "t2", "t3"]


def test_choose(spark):
    analysis = spark.sql(f"SELECT 1L AS page_id, {SAMPLE} UNION ALL SELECT 2L, {SAMPLE}")
    answers = spark.createDataFrame(
        [(1, '[{"title": "t", "description": "words that are more than twenty"}]')],
        "page_id long, response_text string",
    )
    rows = audit.choose_recommendations(analysis, answers).orderBy("page_id").collect()
    assert [(r.from_model, len(r.recommendations)) for r in rows] == [(True, 1), (False, 4)]


def test_overview_rounds_up(spark):
    r = audit.site_overview(
        spark.sql(
            "SELECT 1 AS page_id, 1 AS word_count, 1 AS total_headings, 1 AS h1, 0 AS h2, true AS "
            "has_structured_data, true AS has_faq, true AS has_llm_txt, 0.125D AS semantic_score"
        )
    ).first()
    assert r.semantic_percent == 13


def test_nested_shape(spark):
    flat = audit.structure_analysis(pages(spark, "<h1>a</h1>"))
    nested = audit.nested_analysis(flat).first().structure_analysis
    assert nested.heading_structure.distribution.h1 == 1
    assert nested.llm_txt_analysis.has_llm_txt is False
    assert "title" in nested.meta_completeness.missing_critical


def test_each_place_has_its_filler(spark):
    """Whatever findings a page has, each missing place is taken by the filler of that place."""
    filled = recommend(spark, "true AS has_llm_txt, CAST(array() AS array<string>) AS missing_critical, 1 AS h1, "
                       "9 AS total_headings, 400 AS word_count, CAST(array() AS array<string>) AS missing_elements, 1 AS json_ld, true AS has_faq")
    assert len(filled) == 4
    every = audit.rule_recommendations(spark.sql(f"SELECT 1L AS page_id, {SAMPLE}"))
    for n in range(5):
        cut = every.selectExpr("page_id", f"slice(recommendations, 1, {n}) AS recommendations")
        rows = audit.fill_recommendations(cut).first().recommendations
        kept = cut.first().recommendations[:4]
        assert rows == kept + filled[len(kept):]
