"""Question sets: quotas, prompts, fallback and type summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.functions import fixed_values as fixed
from citescope.functions import sql as S
from citescope.functions.sql import Expr, col, select


def direct_quota(n: Expr, share: Expr) -> Expr:
    """Direct questions out of ``n``: at least one, rounded half to even."""
    return S.greatest(S.lit(1), S.bround(n * share, 0).cast("int"))


def query_quota(requests: DataFrame) -> DataFrame:
    """Adds ``direct_count, generic_count`` to ``(num_queries, direct_share)`` rows."""
    quota = direct_quota(col("num_queries"), col("direct_share"))
    with_direct = select(requests, "*", quota.alias("direct_count"))
    return select(
        with_direct,
        "*",
        (col("num_queries") - col("direct_count")).cast("int").alias("generic_count"),
    )


def query_prompt(texts: DataFrame) -> DataFrame:
    """``page_id, prompt`` from ``(page_id, clean_text, num_queries, direct_share)``."""
    quotas = query_quota(texts)

    def number(name):
        return col(name).cast("string")

    prompt = S.concat(
        "Write questions that people could ask an AI assistant about the topics of the "
        "website text below.\n\nTEXT:\n",
        col("clean_text"),
        "\n\nWrite exactly ",
        number("num_queries"),
        " questions: ",
        number("direct_count"),
        ' of type "Direct" (they name the company or brand that owns the website) and ',
        number("generic_count"),
        ' of type "Generic" (they do not). When in doubt a question is Generic.\n'
        'Answer with a JSON object {"queries": [{"query": "...", "type": "Direct"}]} '
        "and nothing else.",
    )
    return select(quotas, "page_id", prompt.alias("prompt"))


def with_fallback(
    sites: DataFrame, queries: DataFrame, key: str = "page_id"
) -> DataFrame:
    """Queries of all sites; a site without any gets the one fixed Generic query.

    The anti join runs against the distinct keys, so a site with very many queries is
    one row by then.
    """
    missing = sites.select(key).join(
        queries.select(key).distinct(), key, "left_anti"
    )
    return queries.select(key, "query", "type").unionByName(
        missing.select(
            key,
            F.lit(fixed.FALLBACK_QUERY).alias("query"),
            F.lit(fixed.GENERIC).alias("type"),
        )
    )


def query_list(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query")


def queries_structured(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", "type")


def percent_of(part: Column, whole: Column) -> Column:
    """Percentage to one place, half to even; 0 when there is no whole."""
    return F.coalesce(
        F.bround(F.try_divide(part.cast("double"), whole) * 100, 1), F.lit(0.0)
    )


def query_type_summary(queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals and shares of the two types, over everything or per group of ``by``."""
    counts = queries.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("type") == fixed.DIRECT).alias("direct"),
    )
    generic = F.col("total") - F.col("direct")
    return counts.select(
        *by,
        "total",
        "direct",
        generic.alias("generic"),
        percent_of(F.col("direct"), F.col("total")).alias("direct_percentage"),
        percent_of(generic, F.col("total")).alias("generic_percentage"),
    )
