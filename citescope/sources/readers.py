"""Readers of landed tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HTTP_INFO = (
    "page_id bigint, fetched_at timestamp, final_url string, status_code int, "
    "response_headers map<string,string>, "
    "redirects array<struct<`from`:string,`to`:string,status:int>>, "
    "content_language string, last_modified string, content_type string"
)
SEGMENTS = (
    "array<struct<text:string,"
    "links:array<struct<title:string,redirect_url:string,actual_url:string>>,"
    "start_index:int,end_index:int>>"
)


def _struct(**fields: str) -> str:
    return f"struct<{','.join(f'{name}:{kind}' for name, kind in fields.items())}>"


def _table(**fields: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


# an answer as it is saved; `grounding_metadata` is empty for ungrounded answers
_ANSWER = {
    "query": "string",
    "response_text": "string",
    "web_search_queries": "array<string>",
    "grounding_metadata": SEGMENTS,
    "has_grounding": "boolean",
}
_RESULT = {
    "query": "string",
    "query_type": "string",
    "links": "array<struct<domain:string,count:bigint>>",
    "complete_result": _struct(**_ANSWER),
}
RESULT_TYPE = _struct(**_RESULT)
ANSWER = _table(**_ANSWER)
RESULT = _table(**_RESULT)
RUN = _table(
    url="string",
    queries_to_run="int",
    generated_queries="array<struct<query:string,type:string>>",
    analysis_results=f"array<{_struct(**_RESULT)}>",
    saved_at="string",
    part="int",
)
#: Name of the column that keeps what could not be read.
BROKEN = "broken"


def read_pages(
    spark: SparkSession,
    path: str,
    html: str = "html",
    rendered: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Landed pages as ``page_id, url, raw_html, rendered_html``.

    Without a ``rendered`` column the source serves as both, which is also what a
    crawler that keeps only the rendered document gives.  ``partitions`` shuffles the
    table into so many parts, for a table in fewer files than the work needs tasks; by
    default nothing is shuffled.
    """
    table = spark.read.parquet(path)
    if partitions is not None:
        table = table.select("page_id", "url", *{html, rendered or html}).repartition(partitions)
    return table.select(
        "page_id",
        "url",
        F.col(html).alias("raw_html"),
        F.col(rendered or html).alias("rendered_html"),
    )


def read_site_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed files of sites, one for each address: ``file_url, status, content``."""
    return spark.read.parquet(path).select("file_url", "status", "content")


def read_http_info(spark: SparkSession, path: str) -> DataFrame:
    """HTTP data of pages from JSON lines."""
    return spark.read.schema(HTTP_INFO).json(path)


def final_hop(redirects: Column) -> Column:
    """Where a list of redirect hops ends, null without hops."""
    return F.try_element_at(redirects, F.lit(-1))["to"]


def read_answers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved grounded answers; pretty-printed files or (splittable) JSON lines."""
    return spark.read.schema(ANSWER).option("multiLine", not lines).json(path)


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved per-query results, failures included (null ``complete_result``)."""
    return spark.read.schema(RESULT).option("multiLine", not lines).json(path)


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved runs: one row per run with its queries and results."""
    return spark.read.schema(RUN).option("multiLine", not lines).json(path)


def checked(
    spark: SparkSession, path: str, schema: str, layout: str = "lines"
) -> tuple[DataFrame, DataFrame]:
    """Records of saved files, and what is broken in them.

    The first frame has the schema's columns and ``file``; the second ``file, broken``: the text
    that is not a record of that schema.  So a broken file, or a broken record, costs its own
    rows only, and they are listed.  Values of another type than the schema's break a record.

    ``layout`` is how a file is written:

    ``lines``
        a record on each line; large files are split between tasks.
    ``document``
        one record or one array of records, however written; a file is one task.
    ``indented``
        one array, indented by two, as saved reports are; records are found by the lines
        that part them, so one large file is split between tasks.

    Empty files and blank lines have no records.
    """
    fields = spark.createDataFrame([], schema).schema
    if layout == "document":
        rows = (
            spark.read.schema(f"{schema}, {BROKEN} string")
            .option("multiLine", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BROKEN)
            .json(path)
            .select("*", F.col("_metadata.file_path").alias("file"))
        )
        # The reader has to parse something besides the broken text; the condition holds for all.
        parsed = f"hash(`{fields[0].name}`) >= -2147483648"
        bad = rows.where(f"{BROKEN} IS NOT NULL AND {parsed}").select("file", BROKEN)
        return rows.where(f"{BROKEN} IS NULL").drop(BROKEN), bad
    reader = spark.read
    if layout == "indented":
        reader = reader.option("lineSep", "\n  },\n  {")
    texts = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if layout == "indented":
        # what stands before the first and after the last record, and the braces that
        # parted records, which the reader has taken
        inner = F.regexp_replace(F.regexp_replace("text", r"^\s*\[\s*\n  \{", ""), r"\n  \}\s*\n?\]\s*$", "")
        empty = F.col("text").rlike(r"^\s*(\[\s*\])?\s*$")
        texts = texts.where(~empty).select("file", F.concat(F.lit("{"), inner, F.lit("\n}")).alias("text"))
    else:
        texts = texts.where(~F.col("text").rlike(r"^\s*$"))
    parsed = texts.select(
        "file",
        "text",
        F.from_json("text", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"),
    )
    good = parsed.where(f"r IS NOT NULL AND r.{BROKEN} IS NULL").select(*[F.col(f"r.`{f.name}`") for f in fields], "file")
    bad = parsed.where(f"r IS NULL OR r.{BROKEN} IS NOT NULL").select("file", F.col("text").alias(BROKEN))
    return good, bad


def read_variants(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """``file, record``: saved records of any shape as VARIANT, null where they are not JSON.

    For files whose fields have changed over time: paths are taken with ``try_variant_get``.
    """
    texts = spark.read.option("wholetext", not lines).text(path).where(r"NOT value RLIKE '^\\s*$'")
    return texts.select(F.col("_metadata.file_path").alias("file"), F.expr("try_parse_json(value)").alias("record"))


def parse_answers(rows: DataFrame, json: str, key: str = "query_id") -> DataFrame:
    """Answers kept as JSON text in a column; malformed text gives null fields."""
    return rows.select(key, F.from_json(json, ANSWER).alias("a")).select(key, "a.*")


def segment_links(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """Links of saved answers: ``key, segment_pos, link_pos, title, actual_url``."""
    segments = answers.select(
        key, F.posexplode("grounding_metadata").alias("segment_pos", "s")
    )
    return segments.select(
        key, "segment_pos", F.posexplode("s.links").alias("link_pos", "l")
    ).select(key, "segment_pos", "link_pos", "l.title", "l.actual_url")


def run_queries(runs: DataFrame) -> DataFrame:
    """Queries of saved runs: ``url, saved_at, pos, query, type``."""
    return runs.select(
        "url", "saved_at", F.posexplode("generated_queries").alias("pos", "q")
    ).select("url", "saved_at", "pos", "q.query", "q.type")


def run_results(runs: DataFrame) -> DataFrame:
    """Domain counts of saved runs; failed queries keep a row without a domain."""
    results = runs.select(
        "url", "saved_at", F.posexplode("analysis_results").alias("pos", "r")
    )
    return results.select(
        "url",
        "saved_at",
        "pos",
        "r.query",
        "r.query_type",
        F.explode_outer("r.links").alias("l"),
    ).select("url", "saved_at", "pos", "query", "query_type", "l.domain", "l.count")
