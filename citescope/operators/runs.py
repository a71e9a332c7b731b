"""Runs of queries: their saved form, and reports that new runs are added to.

A run is ``run_id, url, queries_to_run, saved_at``; its queries are
``run_id, query_id, query, type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.functions import fixed_values as fixed
from citescope.operators.citations import domain_breakdown, grounding, ranked_counts, resolve_redirects
from citescope.operators.joins import spread_join
from citescope.operators.query_sets import percent_of
from citescope.sources.readers import RESULT_TYPE, SEGMENTS
from citescope.sources.writers import write_results

#: Results in one row of a saved run, about; a run with more is saved in several rows.
RESULTS_PER_ROW = 1000


def complete_results(answers: DataFrame, redirects: DataFrame) -> DataFrame:
    """``query_id`` and the saved form of each answer, its links with their final address.

    ``answers`` are ``query_id, query, response_text, chunks, supports``, and
    ``web_search_queries`` where the model told them.  Addresses are resolved by one join of
    all links; an answer's segments and links then come back together in order.
    """
    found = grounding(answers)
    segments = found.select("query_id", F.posexplode("segments").alias("segment_pos", "s"))
    links = segments.select("query_id", "segment_pos", F.posexplode("s.links").alias("link_pos", "l")).select(
        "query_id", "segment_pos", "link_pos", "l.title", "l.redirect_url"
    )
    resolved = resolve_redirects(links, redirects).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("segment_pos", "link_pos", "title", "redirect_url", "actual_url"))).alias("resolved")
    )
    searched = F.col("web_search_queries") if "web_search_queries" in answers.columns else F.lit(None).cast("array<string>")
    rows = found.join(resolved, "query_id", "left").join(
        answers.select("query_id", "query", searched.alias("web_search_queries")), "query_id"
    )
    metadata = F.expr(
        "transform(coalesce(segments, array()), (s, i) -> named_struct('text', s.text, 'links', "
        "transform(filter(coalesce(resolved, array()), l -> l.segment_pos = i), "
        "l -> named_struct('title', l.title, 'redirect_url', l.redirect_url, 'actual_url', l.actual_url)), "
        "'start_index', s.start_index, 'end_index', s.end_index))"
    ).cast(SEGMENTS)
    return rows.select(
        "query_id",
        F.struct(
            "query",
            F.coalesce("response_text", F.lit("")).alias("response_text"),
            F.coalesce("web_search_queries", F.array().cast("array<string>")).alias("web_search_queries"),
            metadata.alias("grounding_metadata"),
            (F.coalesce(F.size("segments"), F.lit(0)) > 0).alias("has_grounding"),
        ).alias("complete_result"),
    )


def saved_runs(
    runs: DataFrame,
    queries: DataFrame,
    counts: DataFrame,
    answers: DataFrame,
    redirects: DataFrame,
    results_per_row: int = RESULTS_PER_ROW,
) -> DataFrame:
    """Runs as they are saved: their queries and results as nested arrays.

    ``run_id, part, url, queries_to_run, generated_queries, analysis_results, saved_at``.  A
    query without an answer has no links and a null ``complete_result``.  Results of a row
    are in the order of ``query_id``; a run of more than about ``results_per_row`` queries has
    several rows, whose queries the hash of their number picks, so no row holds more
    however large a run is.  A run without queries has one row with empty lists.
    """
    listed = ranked_counts(counts).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "domain", "count"))).alias("ranked")
    )
    sizes = queries.groupBy("run_id").agg(F.ceil(F.count("*") / results_per_row).alias("parts"))
    placed = spread_join(queries.select("run_id", "query_id", "query", "type"), sizes, "run_id", "query_id").withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
    )
    results = placed.join(listed, "query_id", "left").join(complete_results(answers, redirects), "query_id", "left")
    result = F.struct(
        "query",
        F.col("type").alias("query_type"),
        F.expr("transform(coalesce(ranked, array()), d -> named_struct('domain', d.domain, 'count', d.count))").alias("links"),
        "complete_result",
    )
    rows = results.groupBy("run_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("query_id", F.struct("query", "type").alias("q"), result.alias("r")))).alias("all")
    )
    return runs.select("run_id", "url", "queries_to_run", "saved_at").join(rows, "run_id", "left").select(
        "run_id",
        F.coalesce("part", F.lit(0)).alias("part"),
        "url",
        F.col("queries_to_run").cast("int").alias("queries_to_run"),
        F.expr("transform(coalesce(all, array()), x -> x.q)").cast("array<struct<query:string,type:string>>").alias("generated_queries"),
        F.expr("transform(coalesce(all, array()), x -> x.r)").cast(f"array<{RESULT_TYPE}>").alias("analysis_results"),
        F.col("saved_at").cast("string").alias("saved_at"),
    )


# ---------------------------------------------------------------------------------
# reports that grow run by run


def breakdown_state(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """``run_id, domain, direct, total, queries``: what a run adds to the report.

    The row without a domain has the number of the run's queries, cited or not."""
    report = domain_breakdown(queries, counts, by=("run_id",)).select(
        "run_id", "domain", F.col("direct_count").alias("direct"), F.col("total_count").alias("total"), F.lit(0).cast("bigint").alias("queries")
    )
    zero = F.lit(0).cast("bigint")
    sizes = queries.groupBy("run_id").agg(F.count("*").alias("queries")).select(
        "run_id", F.lit(None).cast("string").alias("domain"), zero.alias("direct"), zero.alias("total"), "queries"
    )
    return report.unionByName(sizes)


def add_runs(queries: DataFrame, counts: DataFrame, path: str) -> None:
    """Adds runs to the state at ``path``; a run that is there already is replaced.

    Only the given runs are read, and only their folders written."""
    write_results(breakdown_state(queries, counts), path, "parquet", ("run_id",), replace=True)


def read_state(spark: SparkSession, path: str, run_type: str = "bigint") -> DataFrame:
    """The state of all runs; a filter on ``run_id`` reads only their folders."""
    return spark.read.schema(f"domain string, direct bigint, total bigint, queries bigint, run_id {run_type}").parquet(path)


def state_breakdown(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The breakdown over all runs of a state, or for each of ``by`` (``run_id``, say).

    Counts of runs add up, so it equals the report made of all queries at once, in which
    equal texts of a run share its first result."""
    size = state.where("domain IS NULL").groupBy(*by).agg(F.sum("queries").alias("num_queries"))
    report = state.where("domain IS NOT NULL").groupBy(*by, "domain").agg(
        F.sum("direct").alias("direct_count"), F.sum("total").alias("total_count")
    )
    report = report.withColumn("generic_count", F.col("total_count") - F.col("direct_count"))
    report = report.join(size, list(by)) if by else report.withColumn("num_queries", size.scalar())
    kinds = ["direct", "generic", "total"]
    return report.select(
        *by,
        "domain",
        *[f"{kind}_count" for kind in kinds],
        *[percent_of(F.col(f"{kind}_count"), F.col("num_queries")).alias(f"{kind}_percentage") for kind in kinds],
    )


def top_state_domains(state: DataFrame, n: int = fixed.CHART_DOMAINS) -> DataFrame:
    """The first ``n`` domains of a state for the chart."""
    return (
        state_breakdown(state)
        .orderBy(F.desc("total_percentage"), "domain")
        .limit(n)
        .select("domain", "direct_percentage", "generic_percentage")
    )
