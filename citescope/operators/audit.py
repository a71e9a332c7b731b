"""Structure audit: every metric of a page in one narrow projection.

``structure_metrics`` is wide; selecting some of its columns leaves the patterns of the
others out of the plan, so the single reports below cost only what they show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from citescope.functions import advice as A
from citescope.functions import audit as M
from citescope.functions import extract as X
from citescope.functions import fixed_values as fixed
from citescope.functions import html as H
from citescope.functions import sql as S
from citescope.functions.llmtxt import site_of
from citescope.functions.sql import Expr, col, select
from citescope.operators.llmtxt import (
    embedded_column,
    llm_resolve_sites,
    merge_llm_txt,
    with_llm_sources,
)

HTML = col("rendered_html")
TEXT = col("clean_text")


def _named(columns: dict[str, Expr]) -> list[Expr]:
    return [value.alias(name) for name, value in columns.items()]


def _refs(names) -> dict[str, Expr]:
    return {name: col(name) for name in names}


def _presence(compat: bool) -> Expr:
    if compat:
        # the audit looks the tags up where the page record never puts them
        tags = fixed.CRITICAL_TAGS + fixed.SOCIAL_TAGS
        return S.struct(*[S.lit(False).alias(t.replace(":", "_")) for t in tags])
    return X.meta_presence(col("tokens"), col("heads"))


def structure_metrics(
    pages: DataFrame, compat: bool = False, embedded: bool = False
) -> DataFrame:
    """All metrics of a page, flat.

    ``compat`` reports every meta tag as missing, as the saved sample of the original
    does; by default a tag is present when the page gives it a non-empty value.
    ``embedded`` adds the llm.txt content found inside the page as a struct.
    """
    staged = select(
        pages,
        "page_id",
        "url",
        "rendered_html",
        H.tokens(HTML).alias("tokens"),
        M.lowered(HTML).alias("low"),
    )
    staged = select(
        staged,
        "*",
        H.page_text(col("tokens")).alias("clean_text"),
        H.heads(col("tokens")).alias("heads"),
        M.exotic(col("low")).alias("exotic"),
    )
    source = M.Source(HTML, col("low"), col("exotic"))
    if embedded:
        staged = with_llm_sources(staged)
    extra = [embedded_column().alias("embedded")] if embedded else []
    counted = select(
        staged,
        "page_id",
        "url",
        *_named(M.content_metrics(TEXT)),
        *_named(M.heading_counts(source)),
        *_named(M.semantic_counts(source)),
        *_named(M.faq_counts(source)),
        *_named(M.schema_counts(source)),
        M.faq_text_unmarked(source, TEXT).alias("faq_unmarked"),
        _presence(compat).alias("present"),
        *extra,
    )
    headings = _refs(f"h{level}" for level in fixed.HEADING_LEVELS)
    semantic = _refs(fixed.SEMANTIC_TAGS)
    schema = _refs(fixed.SCHEMA_PATTERNS)
    faq = _refs(["faq_sections", "question_patterns", "qa_indicators"])
    present = {
        tag: col("present")[tag.replace(":", "_")]
        for tag in fixed.CRITICAL_TAGS + fixed.SOCIAL_TAGS
    }
    heading_totals = M.heading_structure(headings)
    return select(
        counted,
        "page_id",
        "url",
        "word_count",
        "paragraph_count",
        "content_length",
        *headings.values(),
        heading_totals["total"].alias("total_headings"),
        heading_totals["issues"].alias("heading_issues"),
        *semantic.values(),
        *_named(M.semantic_elements(semantic)),
        *_named(M.meta_completeness(present)),
        *faq.values(),
        M.has_faq(faq).alias("has_faq"),
        *schema.values(),
        *_named(M.schema_markup(schema)),
        M.structural_issues(
            col("word_count"), present, semantic, col("faq_unmarked"), col("json_ld")
        ).alias("structural_issues"),
        *[part.name for part in extra],
    )


CONTENT = ["word_count", "paragraph_count", "content_length"]
HEADINGS = [f"h{n}" for n in fixed.HEADING_LEVELS] + ["total_headings", "heading_issues"]
SEMANTIC = [*fixed.SEMANTIC_TAGS, "semantic_score", "missing_elements"]
META = [
    "critical_completeness", "social_completeness", "missing_critical", "missing_social",
]
FAQ = ["faq_sections", "question_patterns", "qa_indicators", "has_faq"]
SCHEMA = [
    *fixed.SCHEMA_PATTERNS, "total_markup", "specific_schemas", "has_structured_data",
]


def content_metrics(pages: DataFrame) -> DataFrame:
    return structure_metrics(pages).select("page_id", *CONTENT)


def heading_structure(pages: DataFrame) -> DataFrame:
    return structure_metrics(pages).select("page_id", *HEADINGS)


def semantic_elements(pages: DataFrame) -> DataFrame:
    return structure_metrics(pages).select("page_id", *SEMANTIC)


def meta_completeness(pages: DataFrame, compat: bool = False) -> DataFrame:
    return structure_metrics(pages, compat).select("page_id", *META)


def faq_structure(pages: DataFrame) -> DataFrame:
    return structure_metrics(pages).select("page_id", *FAQ)


def schema_markup(pages: DataFrame) -> DataFrame:
    return structure_metrics(pages).select("page_id", *SCHEMA)


def structural_issues(pages: DataFrame, compat: bool = False) -> DataFrame:
    return structure_metrics(pages, compat).select("page_id", "structural_issues")


SUMMARY = [
    "has_llm_txt", "llm_txt_url", "extraction_method", "content_size", "sources_found",
    "attempts_made",
]


def _summary_columns() -> list:
    return [
        col("llm_txt_found").alias("has_llm_txt"),
        "llm_txt_url",
        "extraction_method",
        col("llm_txt_size_bytes").alias("content_size"),
        S.size(col("sources")).alias("sources_found"),
        S.size(col("attempts")).alias("attempts_made"),
    ]


def llm_summary(llm_txt: DataFrame) -> DataFrame:
    """What the audit keeps of the llm.txt search."""
    return select(llm_txt, "page_id", *_summary_columns())


def structure_analysis(
    pages: DataFrame, site_files: DataFrame | None = None, compat: bool = False
) -> DataFrame:
    """Metrics with the llm.txt summary, from one pass over the page source.

    The metrics and the search for embedded llm.txt content read the page in the same
    projection; what is then joined with what sites have landed are narrow rows without any
    source.  With no ``site_files`` nothing is shuffled and only
    embedded content counts.
    """
    metrics = structure_metrics(pages, compat, embedded=True)
    kept = [c for c in metrics.columns if c != "embedded"]
    if site_files is None:
        inside = col("embedded")
        return select(
            metrics,
            *kept,
            inside["found"].alias("has_llm_txt"),
            S.lit(None).cast("string").alias("llm_txt_url"),
            inside["method"].alias("extraction_method"),
            S.octet_length(inside["content"]).alias("content_size"),
            S.size(inside["sources"]).alias("sources_found"),
            S.lit(0).alias("attempts_made"),
        )
    rows = select(metrics, "*", site_of(col("url")).alias("site"))
    sites = llm_resolve_sites(pages, site_files)
    return select(merge_llm_txt(rows, sites), *kept, *_summary_columns())


def nested_analysis(analysis: DataFrame) -> DataFrame:
    """The flat analysis in the nested shape that is saved as JSON."""

    def part(names):
        return S.struct(*map(col, names))

    return select(
        analysis,
        "page_id",
        "url",
        S.struct(
            part(CONTENT).alias("content_metrics"),
            S.struct(
                part(HEADINGS[:6]).alias("distribution"),
                col("total_headings").alias("total"),
                col("heading_issues").alias("issues"),
            ).alias("heading_structure"),
            S.struct(
                part(fixed.SEMANTIC_TAGS).alias("elements"), *map(col, SEMANTIC[6:])
            ).alias("semantic_elements"),
            part(META).alias("meta_completeness"),
            part(FAQ).alias("faq_structure"),
            S.struct(
                part(fixed.SCHEMA_PATTERNS).alias("types"),
                *map(col, SCHEMA[len(fixed.SCHEMA_PATTERNS):]),
            ).alias("schema_markup"),
            part(SUMMARY).alias("llm_txt_analysis"),
            col("structural_issues"),
        ).alias("structure_analysis"),
    )


def site_overview(analysis: DataFrame) -> DataFrame:
    """Figures of the overview cards."""
    percent = S.floor(col("semantic_score") * 100 + 0.5).cast("int")
    return select(
        analysis,
        "page_id",
        "word_count",
        "total_headings",
        "h1",
        "h2",
        col("has_structured_data").alias("has_schema"),
        "has_faq",
        "has_llm_txt",
        percent.alias("semantic_percent"),
    )


RECOMMENDATION_INPUTS = [
    "has_llm_txt", "missing_critical", "h1", "total_headings", "word_count",
    "missing_elements", "json_ld", "has_faq",
]


def rule_recommendations(analysis: DataFrame) -> DataFrame:
    """``page_id, recommendations``: findings of the rules, in rule order."""
    return select(
        analysis,
        "page_id",
        A.rule_recommendations(_refs(RECOMMENDATION_INPUTS)).alias("recommendations"),
    )


def fill_recommendations(recommendations: DataFrame) -> DataFrame:
    return select(
        recommendations,
        "page_id",
        A.fill(col("recommendations")).alias("recommendations"),
    )


def parse_recommendations(responses: DataFrame) -> DataFrame:
    """Recommendations a model's answers give in ``(page_id, response_text)``."""
    return select(
        responses, "page_id", A.parse(col("response_text")).alias("recommendations")
    )


def parse_recommendations_strict(responses: DataFrame) -> DataFrame:
    return select(
        responses, "page_id", A.parse_strict(col("response_text")).alias("recommendations")
    )


def parse_recommendations_loose(responses: DataFrame) -> DataFrame:
    return select(
        responses, "page_id", A.parse_loose(col("response_text")).alias("recommendations")
    )


def choose_recommendations(analysis: DataFrame, responses: DataFrame) -> DataFrame:
    """The parsed answer where it has any entry, else the filled rules."""
    rules = fill_recommendations(rule_recommendations(analysis)).withColumnRenamed(
        "recommendations", "fallback"
    )
    parsed = parse_recommendations(responses).withColumnRenamed(
        "recommendations", "parsed"
    )
    joined = rules.join(parsed, "page_id", "left")
    return select(
        joined,
        "page_id",
        (S.coalesce(S.size(col("parsed")), 0) > 0).alias("from_model"),
        S.when(S.size(col("parsed")) > 0, col("parsed"))
        .otherwise(col("fallback"))
        .alias("recommendations"),
    )


def recommendation_rows(recommendations: DataFrame) -> DataFrame:
    """One row per recommendation: ``page_id, pos, title, description, priority``."""
    return recommendations.selectExpr(
        "page_id", "posexplode(recommendations) AS (pos, r)"
    ).select("page_id", "pos", "r.*")


def _listing(names: Expr) -> Expr:
    return S.concat(
        "[", S.array_join(S.transform(names, lambda n: S.concat("'", n, "'")), ", "), "]"
    )


def structure_prompt(analysis: DataFrame) -> DataFrame:
    """Prompt text per page for a later job that asks a model."""

    def shown(flag):
        return S.when(flag, "True").otherwise("False")

    facts = [
        ("Missing meta tags", _listing(col("missing_critical"))),
        ("Word count", col("word_count").cast("string")),
        ("H1 tags", col("h1").cast("string")),
        ("Total headings", col("total_headings").cast("string")),
        ("Missing elements", _listing(col("missing_elements"))),
        ("FAQ structure", shown(col("has_faq"))),
        ("Schema markup", shown(col("has_structured_data"))),
        ("LLM.txt file", shown(col("has_llm_txt"))),
    ]
    lines = [S.concat(f"- {label}: ", value, "\n") for label, value in facts]
    prompt = S.concat(
        "Findings of a page audit for citation by AI systems:\n",
        *lines,
        f"Give {fixed.RECOMMENDATIONS_KEPT} short recommendations, one about the "
        "LLM.txt file if it is missing.\nAnswer with a JSON array of objects with "
        'the keys "title", "description" and "priority" (High, Medium or Low), '
        "nothing else.",
    )
    return select(analysis, "page_id", prompt.alias("prompt"))
