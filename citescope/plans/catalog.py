"""Every registered query: what Spark runs over a table directory.

Results are flat: arrays are joined to text and integers are 64 bit, so that they can be
compared with the SQL in ``checks.py`` value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.functions import jsonld, urls
from citescope.functions import sql as S
from citescope.functions.sql import col, select
from citescope.operators import audit, citations, domains, pages, query_sets
from citescope.operators import runs as saved
from citescope.operators import llmtxt as llm
from citescope.plans import fixtures as fx
from citescope.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings joined by ``|``, integers widened."""
    parts = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "array<string>":
            column = F.concat_ws("|", column)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        parts.append(column.alias(field.name))
    return df.select(*parts)


def registered(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
    return fn


def _on_pages(name: str, operator, *columns: str) -> None:
    """Register an operator that takes the derived pages and nothing else."""

    def run(spark, sf_dir):
        result = operator(fx.geo_pages(spark, sf_dir))
        return flat(result.selectExpr(*columns) if columns else result)

    QUERIES[name] = run


# ---------------------------------------------------------------------------------
# sources


@registered
def read_pages(spark, sf_dir):
    return readers.read_pages(spark, f"{sf_dir}/pages.parquet").selectExpr(
        "page_id", "url", "length(raw_html) AS html_length",
        "raw_html = rendered_html AS same_source",
    )


@registered
def read_site_files(spark, sf_dir):
    """Site files written as a landed table, and read."""
    path = fx.landed(fx.geo_site_files(spark, sf_dir), lambda df, p: df.write.parquet(p))
    return readers.read_site_files(spark, path)


@registered
def read_http_info(spark, sf_dir):
    """HTTP data written as JSON lines, and read with the declared schema."""
    path = fx.landed(fx.http_info(spark, sf_dir), writers.write_results)
    return readers.read_http_info(spark, path).select(
        "page_id",
        "final_url",
        "status_code",
        "content_language",
        F.size("redirects").alias("hops"),
        readers.final_hop(F.col("redirects")).alias("last_hop"),
    )


@registered
def read_answers(spark, sf_dir):
    """Answers saved as JSON lines, read, and their links."""
    links = F.expr(
        "transform(filter(chunks, c -> c.uri IS NOT NULL), c -> named_struct("
        "'title', c.title, 'redirect_url', c.uri, 'actual_url', c.uri))"
    )
    saved = fx.answers(spark, sf_dir).select(
        F.col("query_id").cast("string").alias("query"),
        "response_text",
        F.array(F.struct(F.col("response_text").alias("text"), links.alias("links"))).alias(
            "grounding_metadata"
        ),
        F.lit(True).alias("has_grounding"),
    )
    path = fx.landed(saved, writers.write_results)
    read = readers.segment_links(readers.read_answers(spark, path, lines=True), key="query")
    return read.selectExpr(
        "CAST(query AS bigint) AS query_id", "segment_pos", "link_pos", "title", "actual_url"
    )


@registered
def crawl_record(spark, sf_dir):
    landed = fx.geo_pages(spark, sf_dir)
    record = pages.crawl_record(
        landed, fx.http_info(spark, sf_dir), fx.geo_site_files(spark, sf_dir)
    )
    return record.selectExpr(
        "page_id",
        "crawl_info.final_url AS final_url",
        "http_info.status_code AS status_code",
        "length(raw_html) AS raw_length",
        "length(rendered_html) AS rendered_length",
        "meta.tags.title AS title",
        "meta.tags.description AS description",
        "language.html_lang AS html_lang",
        "language.content_language_header AS header_language",
        "structured_data.json_ld_count AS json_ld_count",
        "structured_data.microdata_count AS microdata_count",
        "size(structured_data.schema_org) AS parsed_items",
        "structured_data_normalized.author AS author",
        "md5(array_join(transform(links, x -> concat(x.href, ' ', x.text)), '|')) AS links_md5",
        "md5(array_join(transform(images, x -> x.src), '|')) AS images_md5",
        "content_stats.link_count AS link_count",
        "content_stats.word_count AS word_count",
        "dom_diff.added_nodes_count AS added_ids",
        "llm_txt.llm_txt_found AS llm_txt_found",
        "llm_txt.geo_relevance_score AS geo_relevance_score",
    )


# ---------------------------------------------------------------------------------
# URLs


@registered
def normalize_url(spark, sf_dir):
    given = S.when(
        (col("page_id") % 3) == 0, S.regexp_replace(col("url"), "^[a-z]+://", "")
    ).otherwise(col("url"))
    return select(
        fx.landed_pages(spark, sf_dir), "page_id", urls.normalize_url(given).alias("url")
    )


def _url_forms():
    return (
        S.when((col("page_id") % 4) == 0, "https://")
        .when((col("page_id") % 4) == 1, S.regexp_replace(col("url"), "^[a-z]+://", ""))
        .when((col("page_id") % 4) == 2, "")
        .otherwise(col("url"))
    )


@registered
def is_valid_url(spark, sf_dir):
    return select(
        fx.landed_pages(spark, sf_dir),
        "page_id",
        urls.is_valid_url(_url_forms()).alias("is_valid"),
    )


@registered
def url_netloc(spark, sf_dir):
    return select(
        fx.landed_pages(spark, sf_dir),
        "page_id",
        urls.url_netloc(col("url")).alias("netloc"),
        urls.url_netloc(_url_forms()).alias("netloc_of_form"),
    )


def _hosts(spark, sf_dir):
    """Hosts with a prefix and a suffix that depend on the page number."""
    hosts = select(
        fx.landed_pages(spark, sf_dir), "page_id", urls.url_netloc(col("url")).alias("h")
    )
    return hosts.selectExpr(
        "page_id",
        "concat(CASE WHEN page_id % 3 = 0 THEN 'WWW.' ELSE '' END, h, "
        "CASE page_id % 6 WHEN 1 THEN '.co.uk' WHEN 2 THEN '.com.np' WHEN 3 THEN '.or.jp' "
        "WHEN 4 THEN ':8080' ELSE '' END) AS host",
    )


@registered
def url_domain_bare(spark, sf_dir):
    full = S.concat("https://www.", S.regexp_replace(col("url"), "^[a-z]+://", ""))
    return select(
        fx.landed_pages(spark, sf_dir), "page_id", urls.url_domain_bare(full).alias("domain")
    )


@registered
def normalize_domain(spark, sf_dir):
    return select(
        _hosts(spark, sf_dir), "page_id", "host",
        urls.normalize_domain(col("host")).alias("domain"),
    )


@registered
def normalize_domain_by_rules(spark, sf_dir):
    """Domains by the default suffixes and by rules made from the hosts themselves."""
    hosts = _hosts(spark, sf_dir)
    own = hosts.selectExpr(
        "CASE page_id % 5 WHEN 0 THEN substring_index(lower(host), '.', -3) "
        "WHEN 1 THEN concat('*.', substring_index(lower(host), '.', -2)) "
        "WHEN 2 THEN concat('!', lower(host)) END AS rule"
    )
    rules = domains.default_rules(spark).unionByName(own)
    return domains.with_domains(hosts, rules, spread_by="page_id").select("page_id", "host", "domain")


@registered
def root_domain(spark, sf_dir):
    return select(
        _hosts(spark, sf_dir), "page_id", urls.root_domain(col("host")).alias("domain")
    )


@registered
def resolve_link(spark, sf_dir):
    n = S.concat(col("page_id"))
    forms = S.array(
        S.concat("/abs/", n),
        S.concat("rel/", n, "?a=1"),
        S.concat("../up/", n),
        S.concat("./here#", n),
        S.concat("//other.example.org/", n),
        S.concat("#part-", n),
        S.concat("https://e.org/a/../b/", n),
        S.concat("mailto:x@", n),
    )
    rows = fx.landed_pages(spark, sf_dir).select(
        "page_id", "url", F.posexplode(forms.col()).alias("form", "href")
    )
    return select(
        rows, "page_id", "form", urls.resolve_link(col("url"), col("href")).alias("target")
    )


@registered
def is_internal_link(spark, sf_dir):
    return pages.page_links(fx.geo_pages(spark, sf_dir)).selectExpr(
        "page_id", "pos", "is_internal"
    )


@registered
def redirect_hops(spark, sf_dir):
    return citations.redirect_hops(fx.http_info(spark, sf_dir))


@registered
def redirect_ends(spark, sf_dir):
    return citations.redirect_ends(fx.redirects(spark, sf_dir))


@registered
def resolve_redirects(spark, sf_dir):
    chunks = citations.answer_chunks(fx.answers(spark, sf_dir))
    return citations.resolve_redirects(chunks, fx.redirects(spark, sf_dir)).select(
        "query_id", "chunk_index", "redirect_url", "actual_url"
    )


# ---------------------------------------------------------------------------------
# page extraction

_on_pages(
    "page_tokens", pages.page_tokens, "page_id", "pos", "kind", "tag",
    "array_join(transform(attrs, a -> concat(a.name, '=', a.value)), ';') AS attrs",
    "text",
)


@registered
def element_spans(spark, sf_dir):
    spans = pages.element_spans(fx.geo_pages(spark, sf_dir), "title", "h1", "a")
    return spans.select("page_id", "tag", "text")


_on_pages("page_text", pages.page_text)
_on_pages("meta_scalars", pages.meta_scalars)
_on_pages("meta_hreflang", pages.meta_hreflang)
_on_pages("meta_open_graph", pages.meta_open_graph)
_on_pages("meta_twitter", pages.meta_twitter)
_on_pages("page_links", pages.page_links)
_on_pages("page_images", pages.page_images)


@registered
def page_language(spark, sf_dir):
    result = pages.page_language(fx.geo_pages(spark, sf_dir), fx.http_info(spark, sf_dir))
    return result.selectExpr(
        "page_id", "html_lang", "content_language_header",
        "array_join(transform(hreflang_alternatives, h -> concat(h.hreflang, '=', h.href)), ';') AS alternatives",
    )


_on_pages(
    "json_ld", pages.json_ld, "page_id", "json_ld_count", "size(items) AS parsed_items",
    "size(filter(items, v -> schema_of_variant(v) LIKE 'OBJECT%')) AS object_items",
)
_on_pages("microdata_count", pages.json_ld, "page_id", "microdata_count")
_on_pages("dom_diff", pages.dom_diff)
_on_pages("js_detection", pages.js_detection)
_on_pages("content_stats", pages.content_stats)
_on_pages(
    "crawl_info", pages.crawl_info, "page_id", "url", "final_url", "javascript_executed",
    "javascript_modified_dom", "content_length", "html_length", "rendered_html_length",
    "extraction_method",
)

# ---------------------------------------------------------------------------------
# JSON-LD

_on_pages(
    "ld_dates", pages.json_ld_normalized, "page_id", "date_published", "date_modified"
)
_on_pages("ld_author", pages.json_ld_normalized, "page_id", "author")
_on_pages("ld_publisher", pages.json_ld_normalized, "page_id", "publisher")
_on_pages(
    "ld_geo", pages.json_ld_normalized, "page_id", "geo.latitude AS latitude",
    "geo.longitude AS longitude",
)
_on_pages("ld_address", pages.json_ld_normalized, "page_id", "address")
_on_pages(
    "ld_place", pages.json_ld_normalized, "page_id", "place.name AS name",
    "place.type AS type", "place.address AS address", "place.telephone AS telephone",
    "place.url AS url",
)
_on_pages(
    "ld_contact", pages.json_ld_normalized, "page_id", "contact.telephone AS telephone",
    "contact.email AS email", "contact.contact_type AS contact_type",
    "contact.area_served AS area_served",
)


def _ld_rows(spark, sf_dir, members):
    objects = select(
        pages.json_ld(fx.geo_pages(spark, sf_dir)), "page_id",
        jsonld.objects(col("items")).alias("items"),
    )
    return objects.select(
        "page_id", F.posexplode(members(col("items")).col()).alias("pos", "m")
    ).select("page_id", "pos", "m.*")


@registered
def ld_breadcrumbs(spark, sf_dir):
    return _ld_rows(spark, sf_dir, jsonld.breadcrumbs)


@registered
def ld_faq(spark, sf_dir):
    return _ld_rows(spark, sf_dir, jsonld.faq)


@registered
def ld_faq_answer(spark, sf_dir):
    """Answers of all shapes, made from the page number."""
    given = fx.landed_pages(spark, sf_dir).selectExpr(
        "page_id",
        "concat('{\"name\":\"q\"', CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN ',\"acceptedAnswer\":null' "
        "WHEN 2 THEN concat(',\"acceptedAnswer\":{\"text\":\"a', page_id, '\"}') "
        "WHEN 3 THEN concat(',\"acceptedAnswer\":\"plain ', page_id, '\"') "
        "ELSE ',\"acceptedAnswer\":\"\"' END, '}') AS entry",
    )
    return select(
        given, "page_id", jsonld.faq_answer(S.try_parse_json(col("entry"))).alias("answer")
    )


_on_pages(
    "ld_normalized", pages.json_ld_normalized, "page_id", "date_published",
    "date_modified", "author", "publisher", "geo.latitude AS latitude",
    "size(breadcrumbs) AS breadcrumbs", "size(faq) AS faq",
    "contact.contact_type AS contact_type", "place.name AS place_name", "address",
)

# ---------------------------------------------------------------------------------
# llm.txt


@registered
def llm_candidates(spark, sf_dir):
    return llm.llm_candidates_of_pages(fx.landed_pages(spark, sf_dir))


@registered
def page_llm_candidates(spark, sf_dir):
    return llm.page_llm_candidates(fx.landed_pages(spark, sf_dir))


@registered
def llm_valid(spark, sf_dir):
    texts = fx.any_texts(spark, sf_dir).selectExpr("id AS page_id", "text AS content")
    return llm.llm_valid(texts).select("page_id", "is_valid")


@registered
def llm_resolve_sites(spark, sf_dir):
    found = llm.llm_resolve_sites(fx.landed_pages(spark, sf_dir), fx.geo_site_files(spark, sf_dir))
    return found.selectExpr(
        "site", "found", "llm_txt_url", "extraction_method",
        "octet_length(llm_txt_content) AS size_bytes", "size(attempts) AS attempts_made",
    )


@registered
def llm_resolve(spark, sf_dir):
    found = llm.llm_resolve(
        fx.landed_pages(spark, sf_dir).select("page_id", "url"),
        fx.geo_site_files(spark, sf_dir),
    )
    return found.selectExpr(
        "page_id", "found", "llm_txt_url", "extraction_method",
        "octet_length(llm_txt_content) AS size_bytes",
        "size(attempts) AS attempts_made",
        "size(filter(attempts, a -> a.error = 'HTTP 404')) AS answered_404",
        "size(filter(attempts, a -> a.error = 'HTTP 200')) AS invalid_200",
        "size(filter(attempts, a -> a.success)) AS successes",
    )


_on_pages("llm_from_comments", llm.llm_from_comments)
_on_pages("llm_from_meta", llm.llm_from_meta)
_on_pages("llm_from_elements", llm.llm_from_elements)
_on_pages("llm_from_json_ld", llm.llm_from_json_ld)
_on_pages("llm_from_hidden", llm.llm_from_hidden)
_on_pages("llm_from_text", llm.llm_from_text)
_on_pages("llm_embedded", llm.llm_embedded)


def _file_texts(spark, sf_dir):
    """Site files, documents and turns of conversations, as llm.txt contents."""
    return fx.any_texts(spark, sf_dir).selectExpr("id AS page_id", "text AS llm_txt_content")


@registered
def llm_sections(spark, sf_dir):
    return llm.llm_sections(_file_texts(spark, sf_dir))


@registered
def llm_score(spark, sf_dir):
    return llm.llm_score(_file_texts(spark, sf_dir))


def _llm_txt(spark, sf_dir):
    return llm.llm_txt(fx.geo_pages(spark, sf_dir), fx.geo_site_files(spark, sf_dir))


@registered
def llm_txt(spark, sf_dir):
    return _llm_txt(spark, sf_dir).selectExpr(
        "page_id", "llm_txt_found", "llm_txt_url", "llm_txt_size_bytes",
        "extraction_method", "size(attempts) AS attempts_made",
        "array_join(sources, '|') AS sources", "geo_relevance_score",
    )


# ---------------------------------------------------------------------------------
# structure audit

_on_pages("content_metrics", audit.content_metrics)
_on_pages("heading_structure", audit.heading_structure)
_on_pages("semantic_elements", audit.semantic_elements)
_on_pages("meta_completeness", audit.meta_completeness)
_on_pages("faq_structure", audit.faq_structure)
_on_pages("schema_markup", audit.schema_markup)
_on_pages("structural_issues", audit.structural_issues)


@registered
def llm_summary(spark, sf_dir):
    return audit.llm_summary(_llm_txt(spark, sf_dir))


def _analysis(spark, sf_dir):
    return audit.structure_analysis(
        fx.geo_pages(spark, sf_dir), fx.geo_site_files(spark, sf_dir)
    )


@registered
def structure_analysis(spark, sf_dir):
    return _analysis(spark, sf_dir)


@registered
def site_overview(spark, sf_dir):
    return audit.site_overview(_analysis(spark, sf_dir))


# ---------------------------------------------------------------------------------
# recommendations


@registered
def rule_recommendations(spark, sf_dir):
    return audit.recommendation_rows(audit.rule_recommendations(_analysis(spark, sf_dir)))


@registered
def fill_recommendations(spark, sf_dir):
    """Every page with all its findings, filled to four."""
    rules = audit.rule_recommendations(_analysis(spark, sf_dir))
    return audit.recommendation_rows(audit.fill_recommendations(rules))


QUERIES["fill_all_recommendations"] = QUERIES["fill_recommendations"]


@registered
def parse_recommendations(spark, sf_dir):
    found = audit.parse_recommendations_strict(fx.llm_responses(spark, sf_dir))
    return audit.recommendation_rows(found)


@registered
def parse_recommendations_loose(spark, sf_dir):
    found = audit.parse_recommendations_loose(fx.llm_responses(spark, sf_dir))
    return audit.recommendation_rows(found)


@registered
def choose_recommendations(spark, sf_dir):
    chosen = audit.choose_recommendations(
        _analysis(spark, sf_dir), fx.llm_responses(spark, sf_dir)
    )
    return chosen.selectExpr(
        "page_id", "from_model", "size(recommendations) AS entries",
        "recommendations[0].title AS first_title",
    )


@registered
def structure_prompt(spark, sf_dir):
    return audit.structure_prompt(_analysis(spark, sf_dir)).selectExpr(
        "page_id", "md5(prompt) AS prompt_md5", "length(prompt) AS prompt_length"
    )


# ---------------------------------------------------------------------------------
# query sets


@registered
def query_quota(spark, sf_dir):
    requests = fx.landed_pages(spark, sf_dir).selectExpr(
        "page_id", "CAST(page_id % 50 + 1 AS int) AS num_queries",
        "CASE WHEN page_id % 2 = 0 THEN 0.1D ELSE 0.25D END AS direct_share",
    )
    return query_sets.query_quota(requests)


@registered
def query_prompt(spark, sf_dir):
    texts = pages.page_text(fx.geo_pages(spark, sf_dir)).selectExpr(
        "page_id", "clean_text", "CAST(page_id % 50 + 1 AS int) AS num_queries",
        "0.1D AS direct_share",
    )
    return query_sets.query_prompt(texts).selectExpr(
        "page_id", "md5(prompt) AS prompt_md5", "length(prompt) AS prompt_length"
    )


@registered
def fallback_queries(spark, sf_dir):
    sites = fx.landed_pages(spark, sf_dir).select("page_id")
    return query_sets.with_fallback(sites, fx.site_queries(spark, sf_dir))


@registered
def query_list(spark, sf_dir):
    return query_sets.query_list(fx.geo_queries(spark, sf_dir))


@registered
def queries_structured(spark, sf_dir):
    return query_sets.queries_structured(fx.geo_queries(spark, sf_dir))


@registered
def query_type_summary(spark, sf_dir):
    return query_sets.query_type_summary(fx.geo_queries(spark, sf_dir))


@registered
def query_type_summary_by_site(spark, sf_dir):
    return query_sets.query_type_summary(fx.site_queries(spark, sf_dir), ("page_id",))


# ---------------------------------------------------------------------------------
# citations


@registered
def resolve_chunks(spark, sf_dir):
    return citations.resolve_chunks(fx.answers(spark, sf_dir), fx.redirects(spark, sf_dir))


@registered
def ground_segments(spark, sf_dir):
    return citations.ground_segments(fx.answers(spark, sf_dir))


@registered
def has_grounding(spark, sf_dir):
    return citations.has_grounding(fx.answers(spark, sf_dir))


@registered
def grounded_domains(spark, sf_dir):
    """From answers to domain totals: grounding, redirects and counting in one plan."""
    links = citations.answer_links(fx.answers(spark, sf_dir), fx.redirects(spark, sf_dir))
    counts = citations.domain_counts(citations.extract_domains(links))
    return citations.domain_totals(counts)


@registered
def extract_domains(spark, sf_dir):
    return citations.extract_domains(fx.geo_links(spark, sf_dir))


@registered
def extract_hosts(spark, sf_dir):
    return citations.extract_domains(fx.geo_links(spark, sf_dir), grain="host")


def _counts(spark, sf_dir, grain="domain"):
    links = fx.geo_links(spark, sf_dir)
    return citations.domain_counts(citations.extract_domains(links, grain))


@registered
def domain_counts(spark, sf_dir):
    return citations.ranked_counts(_counts(spark, sf_dir))


@registered
def analyze_queries(spark, sf_dir):
    queries = fx.geo_queries(spark, sf_dir)
    answered = fx.answer_turns(spark, sf_dir).select("query_id")
    return citations.analyze_queries(queries, _counts(spark, sf_dir), answered).select(
        "query_id", "query", "query_type", "answered", "domain", "count"
    )


@registered
def domain_percentages(spark, sf_dir):
    return citations.domain_percentages(
        fx.geo_queries(spark, sf_dir), _counts(spark, sf_dir)
    )


@registered
def domain_breakdown(spark, sf_dir):
    return citations.domain_breakdown(
        fx.geo_queries(spark, sf_dir), _counts(spark, sf_dir)
    )


@registered
def host_breakdown_by_group(spark, sf_dir):
    """Breakdown per group of queries, on whole host names."""
    queries = fx.geo_queries(spark, sf_dir).withColumn("run", F.col("query_id") % 3)
    return citations.domain_breakdown(queries, _counts(spark, sf_dir, "host"), ("run",))


@registered
def domain_totals(spark, sf_dir):
    return citations.domain_totals(_counts(spark, sf_dir))


@registered
def query_details(spark, sf_dir):
    """Details of every answered turn: its text, grounded segments and cited domains."""
    answers = fx.answers(spark, sf_dir)
    queries = answers.selectExpr("query_id", "response_text AS query", "'Generic' AS type")
    links = citations.answer_links(answers, fx.redirects(spark, sf_dir))
    counts = citations.domain_counts(citations.extract_domains(links))
    details = citations.query_details(queries, counts, answers)
    return details.selectExpr(
        "query_id", "query_type", "response_text",
        "size(segments) AS segments",
        "aggregate(segments, 0, (n, s) -> n + size(s.links)) AS links",
        "array_join(transform(segments, s -> s.text), '|') AS segment_texts",
        "array_join(transform(domains, d -> concat(d.rank, ' ', d.domain, ' ', d.count)), '|') AS domains",
    )


@registered
def top_domains(spark, sf_dir):
    breakdown = citations.domain_breakdown(
        fx.geo_queries(spark, sf_dir), _counts(spark, sf_dir, "host")
    )
    return citations.top_domains(breakdown)


@registered
def top_hosts_by_group(spark, sf_dir):
    """The first hosts of each group of queries."""
    queries = fx.geo_queries(spark, sf_dir).withColumn("run", F.col("query_id") % 3)
    breakdown = citations.domain_breakdown(queries, _counts(spark, sf_dir, "host"), ("run",))
    return citations.top_domains(breakdown, by=("run",))


@registered
def query_domain_chart(spark, sf_dir):
    return citations.query_domain_chart(_counts(spark, sf_dir))


@registered
def aggregate_results(spark, sf_dir):
    return citations.aggregate_results(
        fx.geo_queries(spark, sf_dir), _counts(spark, sf_dir)
    )




def _run_tables(spark, sf_dir):
    """Twenty runs over all answered and some unanswered queries, and one run without any."""
    answers = fx.answers(spark, sf_dir).selectExpr("*", "concat('q ', query_id % 40) AS query")
    asked = answers.selectExpr("query_id", "query", "CASE WHEN query_id % 5 = 0 THEN 'Direct' ELSE 'Generic' END AS type")
    failed = fx.geo_queries(spark, sf_dir).where("query_id < 0").select("query_id", "query", "type")
    queries = asked.unionByName(failed).withColumn("run_id", F.abs("query_id") % 20)
    runs = spark.range(21).selectExpr(
        "id AS run_id", "concat('https://site', id, '.example.org') AS url", "id * 2 AS queries_to_run", "'2024-01-01 00:00:00' AS saved_at"
    )
    redirects = fx.redirects(spark, sf_dir)
    counts = citations.domain_counts(citations.extract_domains(citations.answer_links(answers, redirects)))
    return runs, queries, counts, answers, redirects


@registered
def saved_runs(spark, sf_dir):
    """Runs saved in rows of about ten results, half of them twice, and read again."""
    rows = saved.saved_runs(*_run_tables(spark, sf_dir), results_per_row=10)
    path = fx.landed(rows, lambda df, p: writers.write_results(df, p, partition_by=("run_id",), replace=True))
    writers.write_results(rows.where("run_id % 2 = 0"), path, partition_by=("run_id",), replace=True)
    results = readers.read_runs(spark, path, lines=True).select(
        "run_id", "url", "queries_to_run", "saved_at", F.size("generated_queries").alias("listed"), F.explode_outer("analysis_results").alias("r")
    )
    return results.selectExpr(
        "CAST(run_id AS bigint) AS run_id", "url", "queries_to_run", "saved_at", "r.query", "r.query_type",
        "array_join(transform(r.links, l -> concat(l.domain, ' ', l.count)), '|') AS links",
        "r.complete_result IS NULL AS failed", "r.complete_result.has_grounding",
        "size(r.complete_result.grounding_metadata) AS segments",
        "md5(array_join(flatten(transform(r.complete_result.grounding_metadata, s -> "
        "transform(s.links, l -> coalesce(l.actual_url, '-')))), '|')) AS urls_md5",
    )


@registered
def run_state_breakdown(spark, sf_dir):
    """The report over runs added in three goes, the second of which repeats some."""
    _, queries, counts, _, _ = _run_tables(spark, sf_dir)
    queries = queries.select("run_id", "query_id", "query", "type")
    path = fx.landed(queries.where("run_id < 12"), lambda df, p: saved.add_runs(df, counts, p))
    for chosen in ("run_id BETWEEN 8 AND 15", "run_id >= 16"):
        saved.add_runs(queries.where(chosen), counts, path)
    return saved.state_breakdown(saved.read_state(spark, path))


@registered
def checked_answers(spark, sf_dir):
    """Saved answers of which every seventh line is cut off: records, and what is broken."""
    saved_lines = writers.json_lines(
        fx.answers(spark, sf_dir).selectExpr("CAST(query_id AS string) AS query", "response_text", "true AS has_grounding")
    ).selectExpr("CASE WHEN CAST(get_json_object(value, '$.query') AS bigint) % 7 = 3 THEN left(value, length(value) - 5) ELSE value END AS value")
    path = fx.landed(saved_lines, lambda df, p: df.write.text(p))
    good, bad = readers.checked(spark, path, readers.ANSWER)
    return good.selectExpr("query", "length(response_text) AS length", "false AS is_broken").unionByName(
        bad.selectExpr("regexp_extract(broken, '\"query\":\"(-?[0-9]+)', 1) AS query", "CAST(NULL AS int) AS length", "true AS is_broken")
    )


@registered
def write_results(spark, sf_dir):
    """Domain counts of every query, failures included, written and read again."""
    rows = citations.analyze_queries(
        fx.geo_queries(spark, sf_dir), _counts(spark, sf_dir)
    ).select("query_id", "query_type", "domain", "count")
    path = fx.landed(rows, writers.write_results)
    return spark.read.schema(rows.schema).json(path)
