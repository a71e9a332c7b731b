"""Operators over landed pages ``(page_id, url, raw_html, rendered_html)``.

Optional page columns: ``final_url``, ``crawled_at``, ``extraction_time_seconds``.
Everything here is narrow: a page is one row from scan to result, and its source is
dropped in the first projection that no longer needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.functions import extract as X
from citescope.functions import html as H
from citescope.functions import jsonld as L
from citescope.functions import sql as S
from citescope.functions.llmtxt import site_of
from citescope.functions.sql import Expr, col, select
from citescope.operators.llmtxt import (
    LLM_TXT,
    embedded_column,
    llm_resolve_sites,
    merge_llm_txt,
    with_llm_sources,
)
from citescope.operators.session import with_repeated_keys

RAW = col("raw_html")
RENDERED = col("rendered_html")
TOKENS = col("tokens")
HEADS = col("heads")
BASE_URL = col("base_url")


def _optional(df: DataFrame, name: str, type_name: str) -> Expr:
    """An input column, or a typed null where the input lacks it."""
    if name in df.columns:
        return col(name)
    return S.lit(None).cast(type_name).alias(name)


def base_url(pages: DataFrame) -> Expr:
    """Address relative references are seen from."""
    return S.coalesce(_optional(pages, "final_url", "string"), col("url"))


def tokenised(pages: DataFrame, *keep) -> DataFrame:
    """``(page_id, base_url, tokens, heads, ...)``: each rendered page tokenised once."""
    tokens = select(
        pages,
        "page_id",
        base_url(pages).alias("base_url"),
        H.tokens(RENDERED).alias("tokens"),
        *keep,
    )
    return select(tokens, "*", H.heads(TOKENS).alias("heads"))


def _flat(df: DataFrame, struct: Expr) -> DataFrame:
    """``page_id`` and the fields of a struct."""
    return select(df, "page_id", struct.alias("s")).select("page_id", "s.*")


def _rows(df: DataFrame, structs: Expr) -> DataFrame:
    """``page_id``, position and fields: one row per element of an array of structs.

    The array is computed inside the generator.  As a column of its own it would be
    computed twice, because Catalyst infers a not-empty filter on an exploded column and
    pushes it below the projection that makes it.
    """
    rows = df.select("page_id", F.posexplode(structs.col()).alias("pos", "s"))
    return rows.select("page_id", "pos", "s.*")


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: ``page_id, pos, kind, tag, attrs, text``."""
    rows = _rows(pages, H.tokens(RENDERED, as_written=True))
    attrs = S.when(col("kind").isin("start", "raw"), H.attributes(col("raw")))
    return select(
        rows, "page_id", "pos", "kind", "tag", attrs.alias("attrs"), col("raw").alias("text")
    )


def element_spans(pages: DataFrame, *tags: str) -> DataFrame:
    """Elements of the given names: ``page_id, pos, tag, open_pos, close_pos, text``."""
    rows = select(
        tokenised(pages),
        "page_id",
        "tokens",
        H.spans(TOKENS, lambda t, i: t["tag"].isin(list(tags))).alias("spans"),
    )
    return _rows(
        rows,
        S.transform(
            col("spans"),
            lambda s: S.struct(
                S.get(TOKENS, s["pos"])["tag"],
                s["pos"].alias("open_pos"),
                s["close"].alias("close_pos"),
                H.span_text(TOKENS, s["pos"], s["close"]).alias("text"),
            ),
        ),
    )


def page_text(pages: DataFrame) -> DataFrame:
    return select(tokenised(pages), "page_id", H.page_text(TOKENS).alias("clean_text"))


def meta_scalars(pages: DataFrame) -> DataFrame:
    return _flat(tokenised(pages), X.meta_scalars(TOKENS, HEADS))


def meta_hreflang(pages: DataFrame) -> DataFrame:
    return _rows(tokenised(pages), X.hreflang(HEADS))


def _map_rows(pages: DataFrame, entries: Expr) -> DataFrame:
    return tokenised(pages).select(
        "page_id", F.explode(entries.col()).alias("key", "value")
    )


def meta_open_graph(pages: DataFrame) -> DataFrame:
    return _map_rows(pages, X.open_graph(HEADS))


def meta_twitter(pages: DataFrame) -> DataFrame:
    return _map_rows(pages, X.twitter(HEADS))


def page_links(pages: DataFrame, text_length: int | None = None) -> DataFrame:
    """One row per link; ``text_length`` cuts link texts, which are whole by default."""
    return _rows(tokenised(pages), X.links(TOKENS, BASE_URL, text_length))


def page_images(pages: DataFrame) -> DataFrame:
    return _rows(tokenised(pages), X.images(HEADS, BASE_URL))


def latest_fetch(http_info: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``page_id, http_info``: the last fetch of each page, as one struct.

    Without a column ``fetched_at`` the fetches of a page have no order, and the largest row
    stands for it.  Where pages have ``crawled_at``, only fetches up to then count; a page
    without that time takes its last fetch.  Fetches are combined before they are shuffled,
    so a page that was fetched very often is no hot key.
    """
    fields = [c for c in http_info.columns if c != "page_id"]
    kept = [F.col(c) for c in fields]
    # maps have no order; what decides is the time, and then the other fields
    plain = [F.col(f.name) for f in http_info.schema.fields if f.name in fields and "map<" not in f.dataType.simpleString()]
    when = [F.col("fetched_at")] if "fetched_at" in fields else []
    rows = http_info
    if pages is not None and when and "crawled_at" in pages.columns:
        times = pages.select("page_id", "crawled_at").groupBy("page_id").agg(F.max("crawled_at").alias("crawled_at"))
        rows = http_info.join(times, "page_id").where("crawled_at IS NULL OR fetched_at IS NULL OR fetched_at <= crawled_at")
    order = F.struct(*[w.isNotNull() for w in when], *when, *plain)
    return rows.groupBy("page_id").agg(F.max_by(F.struct(*kept), order).alias("http_info"))


def page_language(pages: DataFrame, http_info: DataFrame | None = None) -> DataFrame:
    """``page_id, html_lang, content_language_header, hreflang_alternatives``."""
    found = select(
        tokenised(pages),
        "page_id",
        X.html_lang(HEADS).alias("html_lang"),
        X.hreflang(HEADS).alias("hreflang_alternatives"),
    )
    if http_info is not None:
        answers = latest_fetch(http_info, pages)
        found = found.join(
            answers.select("page_id", "http_info.content_language"), "page_id", "left"
        )
    return select(
        found,
        "page_id",
        "html_lang",
        _optional(found, "content_language", "string").alias("content_language_header"),
        "hreflang_alternatives",
    )


def _changed_only(html: Expr) -> Expr:
    """The source of pages that rendering changed; other pages are not tokenised."""
    return S.when(RAW != RENDERED, html)


def dom_diff(pages: DataFrame, sample: int | None = None) -> DataFrame:
    """Element ids that rendering added and removed; ``sample`` bounds both lists."""
    both = select(
        pages,
        "page_id",
        H.tokens(_changed_only(RAW)).alias("before"),
        H.tokens(_changed_only(RENDERED)).alias("after"),
    )
    return _flat(both, X.dom_diff(col("before"), col("after"), sample))


def js_detection(pages: DataFrame) -> DataFrame:
    return _flat(pages, X.js_detection(RAW))


def content_stats(pages: DataFrame) -> DataFrame:
    arrays = select(
        tokenised(pages),
        "page_id",
        H.page_text(TOKENS).alias("clean_text"),
        X.links(TOKENS, BASE_URL).alias("links"),
        X.images(HEADS, BASE_URL).alias("images"),
    )
    return _flat(
        arrays, X.content_stats(col("clean_text"), col("links"), col("images"))
    )


EXTRACTION_METHOD = "landed_page"


def _crawl_info(pages: DataFrame, text: Expr, js: Expr, method: str) -> Expr:
    return S.struct(
        col("url"),
        base_url(pages).alias("final_url"),
        _optional(pages, "crawled_at", "timestamp").alias("timestamp"),
        S.bround(_optional(pages, "extraction_time_seconds", "double"), 2).alias(
            "extraction_time_seconds"
        ),
        js["javascript_executed"],
        js["javascript_modified_dom"],
        S.length(text).alias("content_length"),
        S.length(RAW).alias("html_length"),
        S.length(RENDERED).alias("rendered_html_length"),
        S.lit(method).alias("extraction_method"),
    )


def crawl_info(pages: DataFrame, method: str = EXTRACTION_METHOD) -> DataFrame:
    """Lengths, flags and addresses of pages; ``method`` labels where they come from."""
    tokens = select(pages, "*", H.tokens(RENDERED).alias("tokens"))
    staged = select(
        tokens,
        "*",
        H.page_text(TOKENS).alias("clean_text"),
        X.js_detection(RAW).alias("js"),
    )
    return _flat(staged, _crawl_info(staged, col("clean_text"), col("js"), method))


def json_ld(pages: DataFrame) -> DataFrame:
    """``page_id, json_ld_count, microdata_count, items`` (VARIANT of what parses)."""
    rows = select(
        with_repeated_keys(tokenised(pages)),
        "page_id",
        L.script_bodies(HEADS).alias("bodies"),
        X.microdata_count(TOKENS).alias("microdata_count"),
    )
    return select(
        rows,
        "page_id",
        S.size(col("bodies")).alias("json_ld_count"),
        "microdata_count",
        L.parsed(col("bodies")).alias("items"),
    )


def json_ld_normalized(pages: DataFrame) -> DataFrame:
    """``page_id`` and the normalised fields; pages without JSON-LD keep nulls."""
    objects = select(json_ld(pages), "page_id", L.objects(col("items")).alias("items"))
    return _flat(objects, L.normalized(col("items")))


def crawl_record(
    pages: DataFrame,
    http_info: DataFrame | None = None,
    site_files: DataFrame | None = None,
    keep_source: bool = True,
    max_links: int | None = None,
    max_images: int | None = None,
    text_length: int | None = None,
    sample: int | None = None,
    method: str = EXTRACTION_METHOD,
) -> DataFrame:
    """One nested record per page.

    Every part comes out of one pass over the row, before any join; links and images keep
    their addresses as written until the HTTP data, which name the base, are joined.
    The last fetch in ``http_info`` is joined by ``page_id``, and what its site has landed in
    ``site_files`` by site, when given.  With
    ``keep_source=False`` only the narrow record takes part in these joins.

    ``max_links``, ``max_images``, ``text_length`` and ``sample`` (changed ids) bound the
    lists of the record; by default everything is kept.  Statistics use all links and
    images.
    """
    source = ["raw_html", "rendered_html"] if keep_source else []
    staged = select(
        pages,
        "page_id",
        "url",
        "raw_html",
        "rendered_html",
        _optional(pages, "final_url", "string"),
        _optional(pages, "crawled_at", "timestamp"),
        _optional(pages, "extraction_time_seconds", "double"),
        H.tokens(RENDERED).alias("tokens"),
        H.tokens(_changed_only(RAW)).alias("raw_tokens"),
        X.js_detection(RAW).alias("js"),
    )
    headed = select(
        staged,
        "*",
        H.heads(TOKENS).alias("heads"),
        H.page_text(TOKENS).alias("clean_text"),
    )
    arrays = select(
        with_llm_sources(headed),
        "*",
        X.raw_links(TOKENS, text_length).alias("raw_links"),
        X.raw_images(HEADS).alias("raw_images"),
        X.hreflang(HEADS).alias("hreflang"),
        L.parsed(col("bodies")).alias("items"),
    )
    parsed = select(arrays, "*", L.objects(col("items")).alias("objects"))
    read = select(
        parsed,
        "page_id",
        "url",
        "final_url",
        "js",
        _crawl_info(parsed, col("clean_text"), col("js"), method).alias("info"),
        *source,
        "clean_text",
        "raw_links",
        "raw_images",
        X.dom_diff(col("raw_tokens"), TOKENS, sample).alias("dom_diff"),
        S.struct(
            S.transform(
                col("items"),
                lambda v: S.struct(S.lit("JSON-LD").alias("type"), v.alias("data")),
            ).alias("schema_org"),
            S.size(col("bodies")).alias("json_ld_count"),
            X.microdata_count(TOKENS).alias("microdata_count"),
        ).alias("structured_data"),
        L.normalized(col("objects")).alias("structured_data_normalized"),
        S.struct(
            X.meta_scalars(TOKENS, HEADS).alias("tags"),
            col("hreflang"),
            X.open_graph(HEADS).alias("open_graph"),
            X.twitter(HEADS).alias("twitter"),
        ).alias("meta"),
        X.html_lang(HEADS).alias("html_lang"),
        embedded_column().alias("embedded"),
    )
    landed = []
    if http_info is not None:
        read, landed = read.join(latest_fetch(http_info, pages), "page_id", "left"), ["http_info"]
    answered_url = col("http_info.final_url") if landed else S.lit(None).cast("string")
    header_language = (
        col("http_info.content_language") if landed else S.lit(None).cast("string")
    )
    based = select(
        read, "*", S.coalesce(col("final_url"), answered_url, col("url")).alias("base")
    )
    linked = select(
        based,
        "*",
        X.resolved_links(col("raw_links"), col("base")).alias("all_links"),
        X.resolved_images(col("raw_images"), col("base")).alias("all_images"),
    )

    def kept(items: Expr, most: int | None) -> Expr:
        return items if most is None else S.slice(items, 1, most)

    info = [
        (col("base") if f == "final_url" else col(f"info.{f}")).alias(f)
        for f in linked.schema["info"].dataType.names
    ]
    record = select(
        linked,
        "page_id",
        S.struct(*info).alias("crawl_info"),
        *landed,
        *source,
        "clean_text",
        "dom_diff",
        "structured_data",
        "structured_data_normalized",
        "meta",
        S.struct(
            col("html_lang"),
            header_language.alias("content_language_header"),
            col("meta.hreflang").alias("hreflang_alternatives"),
        ).alias("language"),
        kept(col("all_links"), max_links).alias("links"),
        kept(col("all_images"), max_images).alias("images"),
        X.content_stats(
            col("clean_text"), col("all_links"), col("all_images")
        ).alias("content_stats"),
        "embedded",
    )
    kept_columns = [c for c in record.columns if c != "embedded"]
    sites = None if site_files is None else llm_resolve_sites(pages, site_files)
    merged = merge_llm_txt(select(record, "*", site_of(col("crawl_info.url")).alias("site")), sites)
    return select(merged, *kept_columns, S.struct(*map(col, LLM_TXT)).alias("llm_txt"))
