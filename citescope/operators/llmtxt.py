"""llm.txt of pages: embedded in the page or landed as a file of its site.

``site_files`` is ``(file_url, status, content)``, one landed file for each address; it may
have other columns.  A site is a scheme and a host.  Addresses are tried once for each site,
however many pages it has, and each file is landed and checked once, however many sites try
it; pages take what their site has found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.functions import fixed_values as fixed
from citescope.functions import html as H
from citescope.functions import jsonld as L
from citescope.functions import llmtxt as X
from citescope.functions import sql as S
from citescope.functions.sql import Expr, col, select
from citescope.operators.joins import spread_join
from citescope.operators.session import with_repeated_keys

TOKENS = col("tokens")
HEADS = col("heads")
MARKED = col("marked")
NOT_LANDED = "not landed"


def _sites(pages: DataFrame) -> DataFrame:
    return select(pages, X.site_of(col("url")).alias("site")).distinct()


def llm_candidates(pages: DataFrame) -> DataFrame:
    """``site, ord, file_url``: addresses to try for each site of the pages, from 0 in order."""
    return _sites(pages).select(
        "site", F.posexplode(X.candidates(col("site")).col()).alias("ord", "file_url")
    )


def llm_candidates_of_pages(pages: DataFrame) -> DataFrame:
    """``page_id, ord, file_url``: for every page the addresses of its site, made once for each site.

    A site may have a large part of all pages; they are spread over several tasks."""
    rows = select(pages, "page_id", X.site_of(col("url")).alias("site"))
    tried = select(_sites(pages), "site", X.candidates(col("site")).alias("addresses"))
    placed = spread_join(rows, tried, "site", "page_id")
    return placed.select("page_id", F.posexplode("addresses").alias("ord", "file_url"))


def page_llm_candidates(pages: DataFrame) -> DataFrame:
    """``page_id, ord, file_url``: the same for each page, for jobs that fetch page by page."""
    return pages.select(
        "page_id", F.posexplode(X.candidates(col("url")).col()).alias("ord", "file_url")
    )


def llm_valid(files: DataFrame) -> DataFrame:
    return select(files, "*", X.is_valid(col("content")).alias("is_valid"))


def _usable_files(site_files: DataFrame) -> DataFrame:
    """One row per candidate-like address.

    Validity is decided and the content of unusable files dropped before the shuffle.
    """
    path = S.regexp_extract(col("file_url"), "^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    ok = S.coalesce((col("status") == 200) & X.is_valid(col("content")), False)
    files = select(
        site_files.where(path.isin(fixed.LLM_PATHS).col()),
        "file_url",
        "status",
        ok.alias("ok"),
        S.when(ok, col("content")).alias("content"),
    )
    return files.groupBy("file_url").agg(
        F.bool_or("ok").alias("ok"),
        F.min("status").alias("status"),
        F.min("content").alias("content"),
    )


def llm_resolve_sites(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """``site, found, llm_txt_url, llm_txt_content, extraction_method, attempts`` per site.

    The first candidate with status 200 and valid content, and the attempts up to it.  A site
    has at most 81 candidates, so the list gathered for it is bounded.  An address on a root
    domain may be tried for very many sites; only its one file is repeated for them.
    """
    tried = llm_candidates(pages).withColumn("ord", F.col("ord") + 1)
    files = _usable_files(site_files)
    placed = tried.join(files.select("file_url", "ok", "status"), "file_url", "left")
    hit = F.when(F.col("ok"), F.col("ord"))
    best = placed.groupBy("site").agg(
        F.min(hit).alias("first"),
        F.min_by("file_url", hit).alias("file_url"),
        F.collect_list(
            F.when(F.col("status").isNotNull(), F.struct("ord", "status"))
        ).alias("landed"),
    )
    # contents are joined to the sites that take them, not to every address tried
    best = best.join(files.where("ok").select("file_url", "content"), "file_url", "left")
    tried = S.slice(
        X.candidates(col("site")), 1, S.coalesce(col("first"), S.lit(2**31 - 1))
    )

    def attempt(address: Expr, index: Expr) -> Expr:
        status = S.get(
            S.filter(col("landed"), lambda a: a["ord"] == index + 1), 0
        )["status"]
        success = S.coalesce(col("first") == index + 1, False)
        return S.struct(
            address.alias("url"),
            success.alias("success"),
            status.alias("status_code"),
            S.when(success, S.lit(None).cast("string"))
            .otherwise(S.coalesce(S.concat("HTTP ", status), NOT_LANDED))
            .alias("error"),
        )

    return select(
        best,
        "site",
        col("first").isNotNull().alias("found"),
        S.when(col("first").isNotNull(), col("file_url")).alias("llm_txt_url"),
        S.when(col("first").isNotNull(), col("content")).alias("llm_txt_content"),
        S.when(col("first").isNotNull(), X.fetch_method(col("file_url"))).alias(
            "extraction_method"
        ),
        S.transform(tried, attempt).alias("attempts"),
    )


def llm_resolve(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """``page_id`` and what ``llm_resolve_sites`` found for the page's site.

    A site may have a large part of all pages; they are spread over several tasks.
    """
    rows = select(pages, "page_id", X.site_of(col("url")).alias("site"))
    found = spread_join(rows, llm_resolve_sites(pages, site_files), "site", "page_id").drop("site")
    return found.withColumn("found", F.coalesce("found", F.lit(False)))


def with_llm_sources(headed: DataFrame) -> DataFrame:
    """Adds what the search inside a page reads to rows with ``tokens`` and ``heads``."""
    return select(
        with_repeated_keys(headed),
        "*",
        L.script_bodies(HEADS).alias("bodies"),
        X.marked_texts(TOKENS).alias("marked"),
        H.joined_text(H.readable(TOKENS)).alias("all_text"),
    )


def embedded_column() -> Expr:
    """Embedded content as a column over ``with_llm_sources`` rows."""
    return X.embedded(TOKENS, HEADS, col("bodies"), MARKED, col("all_text"))


def _staged(pages: DataFrame, *keep: str) -> DataFrame:
    tokens = select(pages, "page_id", *keep, H.tokens(col("rendered_html")).alias("tokens"))
    return with_llm_sources(select(tokens, "*", H.heads(TOKENS).alias("heads")))


def _finds(pages: DataFrame, finds: Expr) -> DataFrame:
    rows = _staged(pages).select("page_id", F.posexplode(finds.col()).alias("pos", "f"))
    return rows.select("page_id", "pos", "f.*")


def llm_from_comments(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_comments(TOKENS))


def llm_from_meta(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_meta(HEADS))


def llm_from_elements(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_elements(MARKED))


def llm_from_json_ld(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_json_ld(col("bodies")))


def llm_from_hidden(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_hidden(MARKED))


def llm_from_text(pages: DataFrame) -> DataFrame:
    return _finds(pages, X.from_text(col("all_text")))


def llm_embedded(pages: DataFrame) -> DataFrame:
    """``page_id, found, content, method, sources`` of content inside the page."""
    return select(_staged(pages), "page_id", embedded_column().alias("e")).select(
        "page_id", "e.*"
    )


def llm_sections(texts: DataFrame) -> DataFrame:
    """``page_id`` and the six line lists of ``llm_txt_content``."""
    return select(
        texts, "page_id", X.sections(col("llm_txt_content")).alias("s")
    ).select("page_id", "s.*")


def llm_score(texts: DataFrame) -> DataFrame:
    parts = select(texts, "page_id", X.sections(col("llm_txt_content")).alias("s"))
    return select(parts, "page_id", X.score(col("s")).alias("geo_relevance_score"))


LLM_TXT = [
    "llm_txt_found", "llm_txt_url", "llm_txt_content", "extraction_method", "sources",
    "attempts", "llm_txt_size_bytes", "parsed_sections", "geo_relevance_score",
]


def merge_llm_txt(parsed: DataFrame, sites: DataFrame | None) -> DataFrame:
    """llm.txt columns from rows with ``site`` and ``embedded``, and ``llm_resolve_sites`` rows.

    Without site files the columns are the same, and only embedded content is found.

    Other columns of ``parsed`` stay, so a caller that already reads the pages for
    something else searches them in the same pass.
    """
    others = [c for c in parsed.columns if c not in ("embedded", "site")]
    inside = col("embedded")
    found_inside = inside["found"]
    none_tried = S.empty(
        "array<struct<url:string,success:boolean,status_code:int,error:string>>"
    )
    if sites is None:
        joined = select(
            parsed,
            "*",
            S.lit(False).alias("found"),
            *[S.lit(None).cast("string").alias(c) for c in ("llm_txt_url", "llm_txt_content", "extraction_method")],
            none_tried.alias("attempts"),
        )
    else:
        joined = spread_join(parsed, sites, "site", "page_id")
    merged = select(
        joined,
        *others,
        S.coalesce(found_inside | col("found"), False).alias("llm_txt_found"),
        S.when(~found_inside, col("llm_txt_url")).alias("llm_txt_url"),
        S.when(found_inside, inside["content"])
        .otherwise(col("llm_txt_content"))
        .alias("llm_txt_content"),
        S.when(found_inside, inside["method"])
        .otherwise(col("extraction_method"))
        .alias("extraction_method"),
        inside["sources"].alias("sources"),
        S.when(~found_inside, col("attempts")).otherwise(none_tried).alias("attempts"),
    )
    sized = select(
        merged,
        "*",
        S.coalesce(S.octet_length(col("llm_txt_content")), 0).alias("llm_txt_size_bytes"),
        X.sections(col("llm_txt_content")).alias("parsed_sections"),
    )
    return select(
        sized, "*", X.score(col("parsed_sections")).alias("geo_relevance_score")
    )


def llm_txt(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """llm.txt data of every page: embedded content first, else the site's file."""
    inside = select(
        _staged(pages, "url"),
        "page_id",
        X.site_of(col("url")).alias("site"),
        embedded_column().alias("embedded"),
    )
    return merge_llm_txt(inside, llm_resolve_sites(pages, site_files))
