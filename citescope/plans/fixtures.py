"""Inputs derived from the test tables by fixed rules.

The test tables hold no answers, JSON-LD, site files and the like; these frames add
them row by row, so they grow with the tables.  ``oracle.py`` states the same rules in
SQL for the check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.sources.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, write) -> str:
    """Path of a table that ``write(df, path)`` has written where all executors see it."""
    path = f"{Scratch(df.sparkSession, 'landed').root}/{uuid.uuid4().hex}"
    write(df, path)
    return path


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def geo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a query, and queries that nothing answers."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = turns.selectExpr(
        "conv_id * 100 + turn AS query_id",
        "text AS query",
        "CASE WHEN conv_id % 5 = 0 THEN 'Direct' ELSE 'Generic' END AS type",
    )
    return asked.unionByName(
        turns.where("conv_id % 7 = 3").selectExpr(
            "- conv_id * 100 - turn - 1 AS query_id",
            "concat('Unanswered: ', text) AS query",
            "'Generic' AS type",
        )
    )


def answer_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the number of the query they follow."""
    return (
        _table(spark, sf_dir, "conversations")
        .selectExpr(
            "*",
            "conv_id * 100 + coalesce(max(CASE WHEN role = 'user' THEN turn END) "
            "OVER (PARTITION BY conv_id ORDER BY turn), 99) AS query_id",
        )
        .where("role = 'assistant'")
    )


def geo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links per assistant turn, to pages picked by number."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    turns = answer_turns(spark, sf_dir).select(
        "query_id", "conv_id", "turn", F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    )
    number = F.col("conv_id") * 7 + F.col("turn") * 13 + F.col("k") * 31
    picked = turns.withColumn("n", pages.agg(F.count("*")).scalar()).withColumn(
        "page_id", number % F.col("n")
    )
    return picked.join(pages, "page_id").selectExpr(
        "query_id",
        "turn AS segment_pos",
        "k AS link_pos",
        "CASE WHEN (conv_id + turn + k) % 4 = 0 THEN '' "
        "ELSE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS title",
        "url AS actual_url",
    )


def geo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose rendered source has meta data, JSON-LD, images and hidden text."""
    from citescope.plans.oracle import GEO_PAGES_HTML

    pages = landed_pages(spark, sf_dir).withColumn("n", F.col("page_id").cast("string"))
    return pages.select(
        "page_id", "url", F.col("html").alias("raw_html"),
        F.expr(GEO_PAGES_HTML).alias("rendered_html"),
    )


def geo_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the pages, numbered by their first page."""
    site = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site"
    return _table(spark, sf_dir, "pages").selectExpr(site, "page_id").groupBy("site").agg(F.min("page_id").alias("page_id"))


def geo_site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of each site, and one that all sites of a root domain try."""
    from citescope.plans.oracle import SHARED_FILE, SITE_FILE_CONTENT, SITE_FILE_STATUS

    paths = F.array(*map(F.lit, ["/llms.txt", "/llm.txt", "/ai.txt"]))
    sites = geo_sites(spark, sf_dir)
    own = sites.withColumn("path", F.explode(paths)).selectExpr(
        "page_id AS site_id",
        "concat(site, path) AS file_url",
        f"{SITE_FILE_STATUS} AS status",
        f"{SITE_FILE_CONTENT} AS content",
    )
    roots = sites.where("site LIKE 'https:%'").selectExpr("page_id", "substring_index(site, '.', -2) AS root")
    shared = roots.groupBy("root").agg(F.min("page_id").alias("page_id")).selectExpr(
        "page_id AS site_id", "concat('https://docs.', root, '/docs/llm.txt') AS file_url", "200 AS status", f"{SHARED_FILE} AS content"
    )
    return own.unionByName(shared)


def http_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP data of three fetches of all pages, one in three under a number that no page has.

    The last fetch has the page's data; the others failed."""
    return (
        _table(spark, sf_dir, "pages")
        .withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
        .selectExpr(
            "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, k) AS fetched_at",
            "CASE WHEN page_id % 3 = 2 THEN page_id + 1000000 ELSE page_id END AS page_id",
            "CASE WHEN page_id % 5 = 0 THEN concat(url, '&r=1') ELSE url END AS final_url",
            "CASE WHEN k < 2 THEN 500 WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status_code",
            "map('Server', 'x') AS response_headers",
            "CASE WHEN page_id % 5 = 0 THEN array(named_struct('from', url, 'to', "
            "concat(url, '&r=1'), 'status', 301)) "
            "ELSE CAST(array() AS array<struct<`from`:string,`to`:string,status:int>>) "
            "END AS redirects",
            "CASE WHEN k < 2 THEN 'xx' WHEN page_id % 4 = 0 THEN 'en' END AS content_language",
            "CAST(NULL AS string) AS last_modified",
            "'text/html' AS content_type",
        )
    )


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redirect address per page, of which one in eleven does not resolve.

    Of each sixteen ten are a chain, and every third chain is a circle."""
    from citescope.plans.oracle import REDIRECT_TARGET

    return _table(spark, sf_dir, "pages").selectExpr(
        "concat('https://redirect.test/r/', page_id) AS redirect_url",
        f"{REDIRECT_TARGET} AS actual_url",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per assistant turn: three chunks, and a support for each sentence."""
    n_pages = _table(spark, sf_dir, "pages").agg(F.count("*"))
    turns = (
        _table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .selectExpr("conv_id * 100 + turn AS query_id", "text AS response_text")
        .withColumn("n", n_pages.scalar())
    )
    return turns.selectExpr(
        "query_id",
        "response_text",
        "transform(array(0, 1, 2), k -> named_struct("
        "  'uri', CASE WHEN (query_id + k) % 9 <> 4 THEN "
        "    concat('https://redirect.test/r/', (query_id * 7 + k * 31) % n) END,"
        "  'title', CASE WHEN (query_id + k) % 3 = 0 THEN '' "
        "    ELSE concat('www.site', (query_id + k) % 23, '.co.uk') END)) AS chunks",
        "CASE WHEN query_id % 6 = 5 THEN "
        "  CAST(array() AS array<struct<text:string,start_index:int,end_index:int,"
        "chunk_indices:array<int>>>) "
        "ELSE transform(split(response_text, '[.] '), (t, s) -> named_struct("
        "  'text', t,"
        "  'start_index', CASE WHEN s > 0 THEN s * 10 END, 'end_index', s * 10 + 10,"
        "  'chunk_indices', CASE WHEN s % 2 = 0 THEN array(0, 2, 0)"
        "    ELSE array(CAST(query_id % 5 AS int)) END)) END AS supports",
    )


def site_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of sites; a site is a page here."""
    n_pages = _table(spark, sf_dir, "pages").agg(F.count("*"))
    return (
        geo_queries(spark, sf_dir)
        .withColumn("n", n_pages.scalar())
        .selectExpr("abs(query_id * 3) % n AS page_id", "query", "type")
    )


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers about pages: clean, fenced, chatty, broken or missing."""
    from citescope.plans.oracle import LLM_RESPONSE

    return (
        _table(spark, sf_dir, "pages")
        .selectExpr("page_id", "CAST(page_id AS string) AS n")
        .selectExpr("page_id", f"{LLM_RESPONSE} AS response_text")
    )


def any_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of all site files, documents and conversation turns with a text."""
    files = geo_site_files(spark, sf_dir).where("content IS NOT NULL")
    return (
        files.selectExpr("site_id AS id", "content AS text")
        .unionByName(_table(spark, sf_dir, "documents").selectExpr("1000000000 + doc_id AS id", "text"))
        .unionByName(
            _table(spark, sf_dir, "conversations").selectExpr(
                "2000000000 + conv_id * 100 + turn AS id", "text"
            )
        )
        .where("text IS NOT NULL")
    )
