"""One SQL statement per registered query, for DuckDB over the same tables."""

from __future__ import annotations

from citescope.functions import fixed_values as fixed
from citescope.plans.oracle import (
    _quoted,
    contains_any,
    count_of,
    domain,
    netloc,
    page_text,
    percent,
    query,
    unescape,
    valid,
)

CHECKS: dict[str, str] = {}

URL_FORMS = """CASE page_id % 4 WHEN 0 THEN 'https://'
  WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN '' ELSE url END"""
HOSTS = f"""hosts AS (SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN 'WWW.' ELSE '' END,
  {netloc('url')}, CASE page_id % 6 WHEN 1 THEN '.co.uk' WHEN 2 THEN '.com.np'
  WHEN 3 THEN '.or.jp' WHEN 4 THEN ':8080' ELSE '' END) AS host FROM pages)"""

# ---------------------------------------------------------------------------------
# sources and URLs

CHECKS["read_pages"] = (
    "SELECT page_id, url, length(html) AS html_length, true AS same_source FROM pages"
)
CHECKS["read_site_files"] = query(
    "SELECT file_url, CAST(status AS BIGINT) AS status, content FROM geo_site_files",
    "geo_site_files",
)
CHECKS["read_http_info"] = query(
    """SELECT page_id, final_url, CAST(status_code AS BIGINT) AS status_code, content_language,
  CAST(contains(final_url, '&r=1') AS BIGINT) AS hops,
  CASE WHEN contains(final_url, '&r=1') THEN final_url END AS last_hop FROM http_fetches""",
    "http_fetches",
)
CHECKS["read_answers"] = query(
    """SELECT query_id, CAST(0 AS BIGINT) AS segment_pos,
  row_number() OVER (PARTITION BY query_id ORDER BY chunk_index) - 1 AS link_pos,
  title, redirect_url AS actual_url FROM chunks WHERE redirect_url IS NOT NULL""",
    "chunks",
)
CHECKS["normalize_url"] = """SELECT page_id, CASE WHEN page_id % 3 = 0
  THEN concat('https://', regexp_replace(url, '^[a-z]+://', '')) ELSE url END AS url FROM pages"""
CHECKS["is_valid_url"] = "SELECT page_id, page_id % 4 = 3 AS is_valid FROM pages"
CHECKS["url_netloc"] = f"""SELECT page_id, {netloc('url')} AS netloc,
  CASE WHEN page_id % 4 = 3 THEN {netloc('url')} ELSE '' END AS netloc_of_form FROM pages"""
CHECKS["url_domain_bare"] = (
    f"SELECT page_id, replace({netloc('url')}, 'www.', '') AS domain FROM pages"
)
CHECKS["normalize_domain"] = (
    f"WITH {HOSTS} SELECT page_id, host, {domain('host')} AS domain FROM hosts"
)
CHECKS["root_domain"] = f"""WITH {HOSTS} SELECT page_id,
  array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM hosts"""
CHECKS["resolve_link"] = f"""WITH parts AS (SELECT page_id, url, CAST(page_id AS VARCHAR) AS n,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
  regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) AS folder FROM pages),
forms AS (SELECT *, unnest(range(8)) AS form FROM parts)
SELECT page_id, form, CASE form
  WHEN 0 THEN origin || '/abs/' || n
  WHEN 1 THEN origin || folder || 'rel/' || n || '?a=1'
  WHEN 2 THEN origin || regexp_replace(folder, '[^/]+/$', '') || 'up/' || n
  WHEN 3 THEN origin || folder || 'here#' || n
  WHEN 4 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//other.example.org/' || n
  WHEN 5 THEN regexp_replace(url, '#.*$', '') || '#part-' || n
  WHEN 6 THEN 'https://e.org/a/../b/' || n
  ELSE 'mailto:x@' || n END AS target FROM forms"""
CHECKS["is_internal_link"] = query(
    f"SELECT page_id, pos, {netloc('href')} = host AS is_internal FROM links", "links"
)
CHECKS["redirect_ends"] = query(
    "SELECT redirect_url, actual_url, CAST(hops AS BIGINT) AS hops FROM redirects", "redirects"
)
CHECKS["redirect_hops"] = """SELECT url AS redirect_url, concat(url, '&r=1') AS actual_url FROM pages WHERE page_id % 5 = 0"""
CHECKS["resolve_redirects"] = query(
    """SELECT c.query_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.redirect_url, r.actual_url
FROM chunks c LEFT JOIN redirects r ON r.redirect_url = c.redirect_url
WHERE c.redirect_url IS NOT NULL""",
    "chunks", "redirects",
)

# ---------------------------------------------------------------------------------
# page extraction

CHECKS["page_tokens"] = query(
    """WITH t AS (SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(rendered_html,
    '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-zA-Z](?:[^>"]|"[^"]*")*>|<[!?][^>]*>|[^<]+|<') AS l
    FROM geo_pages)),
k AS (SELECT *, CASE WHEN NOT starts_with(text, '<') OR text = '<' THEN 'text'
    WHEN starts_with(text, '<!--') THEN 'comment' WHEN starts_with(text, '<!') THEN 'decl'
    WHEN starts_with(text, '</') THEN 'end'
    WHEN regexp_matches(text, '^<(script|style)[ >]') THEN 'raw' ELSE 'start' END AS kind FROM t)
SELECT page_id, pos, kind,
  CASE WHEN kind IN ('start', 'end', 'raw') THEN regexp_extract(text, '^</?([a-zA-Z0-9]+)', 1) END AS tag,
  CASE WHEN kind IN ('start', 'raw') THEN replace(array_to_string([replace(x, '"', '') FOR x IN
    regexp_extract_all(regexp_extract(text, '^<(?:[^>"]|"[^"]*")*>'), ' ([a-z:-]+="[^"]*"|itemscope)', 1)], ';'),
    'itemscope;', 'itemscope=;') END AS attrs, text FROM k""",
    "geo_pages",
)
CHECKS["element_spans"] = query(
    f"""SELECT page_id, 'title' AS tag, {unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS text FROM bare
UNION ALL SELECT page_id, 'h1', {unescape("unnest(regexp_extract_all(html, '<h1>([^<]*)', 1))")} FROM bare
UNION ALL SELECT page_id, 'a', {unescape("regexp_extract(a, '>(.*)$', 1, 's')")} FROM anchors""",
    "bare", "anchors",
)
CHECKS["page_text"] = query("SELECT page_id, clean_text FROM texts", "texts")
CHECKS["meta_scalars"] = query(
    f"""SELECT page_id, trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
  regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description,
  regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonical,
  regexp_extract(html, '<meta name="robots" content="([^"]*)"', 1) AS robots,
  regexp_extract(html, '<meta name="viewport" content="([^"]*)"', 1) AS viewport FROM bare""",
    "bare",
)
CHECKS["meta_hreflang"] = query(
    """SELECT page_id, CAST(0 AS BIGINT) AS pos,
  regexp_extract(html, 'hreflang="([^"]*)"', 1) AS hreflang,
  regexp_extract(html, 'hreflang="[^"]*" href="([^"]*)"', 1) AS href
FROM bare WHERE contains(html, '<link rel="alternate" hreflang=')""",
    "bare",
)
CHECKS["meta_open_graph"] = query(
    """SELECT page_id, regexp_extract(m, 'og:([^"]*)"', 1) AS key,
  regexp_extract(m, 'content="([^"]*)"', 1) AS value
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta property="og:[^>]*>')) AS m FROM bare)""",
    "bare",
)
CHECKS["meta_twitter"] = query(
    """SELECT page_id, regexp_extract(m, 'twitter:([^"]*)"', 1) AS key,
  regexp_extract(m, 'content="([^"]*)"', 1) AS value
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<meta name="twitter:[^>]*>')) AS m FROM bare)""",
    "bare",
)
CHECKS["page_links"] = query(
    f"""SELECT page_id, pos, href, text, rel, {netloc('href')} = host AS is_internal,
  CASE WHEN contains(written, '#') THEN regexp_extract(written, '#([^#]*)$', 1) END AS anchor_hash,
  '' AS title FROM links""",
    "links",
)
CHECKS["page_images"] = query(
    """SELECT page_id, pos, CASE WHEN contains(tag, 'src="data:') THEN regexp_extract(tag, 'src="([^"]*)"', 1)
    ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(tag, 'src="([^"]*)"', 1) END AS src,
  regexp_extract(tag, 'alt="([^"]*)"', 1) AS alt, nullif(regexp_extract(tag, 'width="([^"]*)"', 1), '') AS width,
  CAST(NULL AS VARCHAR) AS height, '' AS title, contains(tag, 'src="data:') AS is_data_uri FROM imgs""",
    "imgs",
)
CHECKS["page_language"] = query(
    """SELECT b.page_id, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS html_lang,
  h.content_language AS content_language_header,
  CASE WHEN contains(html, 'hreflang=') THEN regexp_extract(html, 'hreflang="([^"]*)"', 1) || '=' ||
    regexp_extract(html, 'hreflang="[^"]*" href="([^"]*)"', 1) ELSE '' END AS alternatives
FROM bare b LEFT JOIN http_info h ON h.page_id = b.page_id""",
    "bare", "http_info",
)
CHECKS["json_ld"] = query(
    """SELECT page_id, count(body) AS json_ld_count, count(*) FILTER (WHERE coalesce(json_valid(body), false)) AS parsed_items,
  count(*) FILTER (WHERE coalesce(CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END, false)) AS object_items
FROM geo_pages LEFT JOIN scripts USING (page_id) GROUP BY page_id""",
    "scripts",
)
CHECKS["microdata_count"] = query(
    "SELECT page_id, len(regexp_extract_all(html, '<[a-z]+ itemscope')) AS microdata_count FROM bare",
    "bare",
)
CHECKS["dom_diff"] = query(
    """SELECT page_id, len(a) AS added_nodes_count, CAST(0 AS BIGINT) AS removed_nodes_count,
  coalesce(array_to_string(list_sort(a), '|'), '') AS added_selectors, '' AS removed_selectors,
  len(a) > 0 OR len(regexp_extract_all(rendered_html, '<script')) > len(regexp_extract_all(raw_html, '<script')) AS has_significant_changes
FROM (SELECT *, list_distinct(regexp_extract_all(rendered_html, ' id="([^"]*)"', 1)) AS a FROM geo_pages)""",
    "geo_pages",
)
_JS = f"""(len(regexp_extract_all(lower(html), '<script')) > {fixed.MANY_SCRIPTS}
  OR (contains(lower(html), '<script') AND {contains_any('lower(html)', fixed.FRAMEWORK_MARKERS + fixed.LAZY_MARKERS)}))"""
CHECKS["js_detection"] = f"""SELECT page_id, html <> '' AS javascript_executed,
  {_JS} AS javascript_modified_dom FROM pages"""
CHECKS["content_stats"] = query(
    f"""WITH l AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE {netloc('href')} = host) AS inside FROM links GROUP BY page_id),
i AS (SELECT page_id, count(*) AS n FROM imgs GROUP BY page_id)
SELECT t.page_id, len(regexp_extract_all(clean_text, '[^ \t\n\r]+')) AS word_count,
  coalesce(l.n, 0) AS link_count, coalesce(i.n, 0) AS image_count,
  coalesce(l.inside, 0) AS internal_link_count, coalesce(l.n - l.inside, 0) AS external_link_count
FROM texts t LEFT JOIN l USING (page_id) LEFT JOIN i USING (page_id)""",
    "texts", "links", "imgs",
)
CHECKS["crawl_info"] = query(
    f"""SELECT t.page_id, t.url, t.url AS final_url, p.html <> '' AS javascript_executed,
  {_JS.replace('html', 'p.html')} AS javascript_modified_dom, length(clean_text) AS content_length,
  length(p.html) AS html_length, length(t.html) AS rendered_html_length,
  'landed_page' AS extraction_method FROM texts t JOIN pages p USING (page_id)""",
    "texts",
)

# ---------------------------------------------------------------------------------
# JSON-LD


def _latest(path: str, alias: str, value: str | None = None) -> str:
    value = value or f"json_extract_string(j, '{path}')"
    return f"arg_max({value}, ord) FILTER (WHERE json_exists(j, '{path}')) AS {alias}"


def _per_page(columns: str, where: str = "true") -> str:
    return query(
        f"""WITH f AS (SELECT page_id, {columns} FROM typed WHERE {where} GROUP BY page_id)
SELECT p.page_id, f.* EXCLUDE (page_id) FROM geo_pages p LEFT JOIN f ON f.page_id = p.page_id""",
        "typed",
    )


def _name(path: str) -> str:
    return f"coalesce(json_extract_string(j, '{path}.name'), json_extract_string(j, '{path}'))"


CHECKS["ld_dates"] = _per_page(
    _latest("$.datePublished", "date_published")
    + ", "
    + _latest("$.dateModified", "date_modified")
)
CHECKS["ld_author"] = _per_page(_latest("$.author", "author", _name("$.author")))
CHECKS["ld_publisher"] = _per_page(
    _latest("$.publisher", "publisher", _name("$.publisher"))
)
CHECKS["ld_geo"] = _per_page(
    _latest("$.geo", "latitude", "json_extract_string(j, '$.geo.latitude')")
    + ", "
    + _latest("$.geo", "longitude", "json_extract_string(j, '$.geo.longitude')")
)
CHECKS["ld_address"] = _per_page(_latest("$.address", "address"))
_PLACES = "kind IN ('Place', 'LocalBusiness', 'Organization')"
CHECKS["ld_place"] = _per_page(
    "arg_max(json_extract_string(j, '$.name'), ord) AS name, arg_max(kind, ord) AS type, "
    "arg_max(json_extract_string(j, '$.address'), ord) AS address, "
    "arg_max(json_extract_string(j, '$.telephone'), ord) AS telephone, "
    "arg_max(json_extract_string(j, '$.url'), ord) AS url",
    _PLACES,
)
CHECKS["ld_contact"] = _per_page(
    ", ".join(
        f"arg_max(json_extract_string(j, '$.contactPoint.{key}'), ord) AS {alias}"
        for key, alias in [
            ("telephone", "telephone"), ("email", "email"),
            ("contactType", "contact_type"), ("areaServed", "area_served"),
        ]
    ),
    "json_type(j, '$.contactPoint') = 'OBJECT'",
)
_CRUMBS = """SELECT page_id, unnest(range(CAST(json_array_length(j, '$.itemListElement') AS BIGINT))) AS i, j FROM typed
  WHERE kind = 'BreadcrumbList'"""
CHECKS["ld_breadcrumbs"] = query(
    f"""WITH e AS ({_CRUMBS})
SELECT page_id, CAST(i AS BIGINT) AS pos, json_extract_string(j, '$.itemListElement[' || i || '].name') AS name,
  coalesce(json_extract_string(j, '$.itemListElement[' || i || '].item'), json_extract_string(j, '$.itemListElement[' || i || '].url')) AS url,
  json_extract_string(j, '$.itemListElement[' || i || '].position') AS position FROM e""",
    "typed",
)
CHECKS["ld_faq"] = query(
    """WITH e AS (SELECT page_id, unnest(range(CAST(json_array_length(j, '$.mainEntity') AS BIGINT))) AS i, j FROM typed WHERE kind = 'FAQPage')
SELECT page_id, CAST(i AS BIGINT) AS pos, json_extract_string(j, '$.mainEntity[' || i || '].name') AS question,
  json_extract_string(j, '$.mainEntity[' || i || '].acceptedAnswer.text') AS answer FROM e""",
    "typed",
)
CHECKS["ld_faq_answer"] = """SELECT page_id, CASE page_id % 5 WHEN 2 THEN concat('a', page_id)
  WHEN 3 THEN concat('plain ', page_id) ELSE '' END AS answer FROM pages"""
CHECKS["ld_normalized"] = query(
    f"""WITH f AS (SELECT page_id, {_latest("$.datePublished", "date_published")},
  {_latest("$.dateModified", "date_modified")}, {_latest("$.author", "author", _name("$.author"))},
  {_latest("$.publisher", "publisher", _name("$.publisher"))},
  {_latest("$.geo", "latitude", "json_extract_string(j, '$.geo.latitude')")},
  sum(CASE WHEN kind = 'BreadcrumbList' THEN json_array_length(j, '$.itemListElement') ELSE 0 END) AS breadcrumbs,
  sum(CASE WHEN kind = 'FAQPage' THEN json_array_length(j, '$.mainEntity') ELSE 0 END) AS faq,
  {_latest("$.contactPoint", "contact_type", "json_extract_string(j, '$.contactPoint.contactType')")},
  arg_max(json_extract_string(j, '$.name'), ord) FILTER (WHERE {_PLACES}) AS place_name,
  {_latest("$.address", "address")} FROM typed GROUP BY page_id)
SELECT p.page_id, f.date_published, f.date_modified, f.author, f.publisher, f.latitude,
  CAST(coalesce(f.breadcrumbs, 0) AS BIGINT) AS breadcrumbs, CAST(coalesce(f.faq, 0) AS BIGINT) AS faq,
  f.contact_type, f.place_name, f.address FROM geo_pages p LEFT JOIN f ON f.page_id = p.page_id""",
    "typed",
)

# ---------------------------------------------------------------------------------
# llm.txt

_SUBS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(fixed.LLM_SUBDOMAINS, 1))
_PATHS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(fixed.LLM_PATHS))
CANDIDATES = f"""subs(h, sub) AS (VALUES {_SUBS}), paths(k, path) AS (VALUES {_PATHS}),
origins AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {netloc('url')} AS host FROM pages),
tries AS (SELECT page_id, scheme, 0 AS h, host FROM origins
  UNION ALL SELECT page_id, scheme, h, sub || '.' || array_to_string(string_split(host, '.')[-2:], '.')
  FROM origins CROSS JOIN subs WHERE NOT {contains_any('host', fixed.LLM_SUBDOMAINS)}),
candidates AS (SELECT page_id, h * {len(fixed.LLM_PATHS)} + k AS ord, scheme || '://' || host || path AS file_url, host, path
  FROM tries CROSS JOIN paths)"""
CHECKS["page_llm_candidates"] = (
    f"WITH {CANDIDATES} SELECT page_id, CAST(ord AS BIGINT) AS ord, file_url FROM candidates"
)
CHECKS["llm_candidates"] = (
    f"WITH {CANDIDATES} SELECT page_id, CAST(ord AS BIGINT) AS ord, file_url FROM candidates"
)
ANY_TEXTS = """any_texts AS (SELECT site_id AS page_id, content FROM geo_site_files WHERE content IS NOT NULL
  UNION ALL SELECT 1000000000 + doc_id, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 2000000000 + conv_id * 100 + turn, text FROM conversations WHERE text IS NOT NULL)"""
CHECKS["llm_valid"] = query(
    f"WITH {ANY_TEXTS} SELECT page_id, {valid('content')} AS is_valid FROM any_texts",
    "geo_site_files",
)
RESOLVED = f"""{CANDIDATES},
landed AS (SELECT c.*, s.status, s.content, coalesce(s.status = 200 AND {valid('s.content')}, false) AS ok
  FROM candidates c LEFT JOIN geo_site_files s ON s.file_url = c.file_url),
hits AS (SELECT page_id, min(ord) FILTER (WHERE ok) AS hit FROM landed GROUP BY page_id),
resolved AS (SELECT l.page_id, max(hit) IS NOT NULL AS found,
  max(l.file_url) FILTER (WHERE ord = hit) AS llm_txt_url, max(l.content) FILTER (WHERE ord = hit) AS content,
  max('direct_fetch_' || replace(path, '/', '_') || '_on_' || host) FILTER (WHERE ord = hit) AS extraction_method,
  count(*) FILTER (WHERE hit IS NULL OR ord <= hit) AS attempts_made,
  count(*) FILTER (WHERE (hit IS NULL OR ord < hit) AND status = 404) AS answered_404,
  count(*) FILTER (WHERE (hit IS NULL OR ord < hit) AND status = 200) AS invalid_200,
  count(*) FILTER (WHERE ord = hit) AS successes
  FROM landed l JOIN hits h ON h.page_id = l.page_id GROUP BY l.page_id)"""
CHECKS["llm_resolve_sites"] = query(
    f"""WITH {RESOLVED} SELECT DISTINCT scheme || '://' || host AS site, found, llm_txt_url, extraction_method,
  octet_length(encode(content)) AS size_bytes, attempts_made FROM resolved JOIN origins USING (page_id)""",
    "geo_site_files",
)
CHECKS["llm_resolve"] = query(
    f"""WITH {RESOLVED} SELECT page_id, found, llm_txt_url, extraction_method,
  octet_length(encode(content)) AS size_bytes, attempts_made, answered_404, invalid_200, successes FROM resolved""",
    "geo_site_files",
)

_COMMENTS = """SELECT page_id, trim(unnest(l)) AS content, generate_subscripts(l, 1) AS ord
  FROM (SELECT page_id, regexp_extract_all(rendered_html, '(?s)<!--(.*?)-->', 1) AS l FROM geo_pages)"""
_METAS = """SELECT page_id, unnest(l) AS m, generate_subscripts(l, 1) AS ord
  FROM (SELECT page_id, regexp_extract_all(html, '<meta [^>]*>') AS l FROM bare)"""
_ALL_TEXT = unescape("regexp_replace(html, '<[/!a-zA-Z][^>]*>', '', 'g')")
FINDS = f"""f1 AS (SELECT page_id, ord, content, 'html_comment' AS source FROM ({_COMMENTS})
  WHERE {contains_any('lower(content)', fixed.LLM_COMMENT_WORDS)} AND {valid('content')}),
f2 AS (SELECT page_id, ord, content, 'meta_tag_' || name AS source FROM (SELECT page_id, ord,
    regexp_extract(m, 'content="([^"]*)"', 1) AS content,
    coalesce(nullif(regexp_extract(m, 'name="([^"]*)"', 1), ''), regexp_extract(m, 'property="([^"]*)"', 1)) AS name FROM ({_METAS}))
  WHERE ({contains_any('lower(name)', fixed.LLM_META_NAME_WORDS)} OR {contains_any('lower(content)', fixed.LLM_META_CONTENT_WORDS)}) AND {valid('content')}),
f3 AS (SELECT page_id, 1 AS ord, content, 'element_[class*="llm"]' AS source FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '<div class="llm-note"[^>]*>([^<]*)</div>', 1)) AS content FROM bare) WHERE {valid('content')}),
f4 AS (SELECT page_id, ord, body AS content, 'json_ld' AS source FROM scripts
  WHERE json_valid(body) AND {contains_any('lower(body)', fixed.LLM_JSON_LD_WORDS)} AND {valid('body')}),
f5 AS (SELECT page_id, 1 AS ord, content, 'hidden_element' AS source FROM (SELECT page_id,
    unnest(regexp_extract_all(html, '<div style="display:none">([^<]*)</div>', 1)) AS content FROM bare) WHERE {valid('content')}),
f6 AS (SELECT page_id, ord, trim(content, chr(32) || chr(10)) AS content, 'text_pattern' AS source FROM (
    SELECT page_id, unnest(l) AS content, generate_subscripts(l, 1) AS ord FROM (SELECT page_id, list_concat(
      regexp_extract_all(t, '(?im)(?:^|\n)\\s*(?:ai|llm|model|assistant):\\s*.+'), list_concat(
      regexp_extract_all(t, '(?im)(?:^|\n)\\s*#\\s*(?:ai|llm|model|assistant)\\s+.+'), list_concat(
      regexp_extract_all(t, '(?i)instructions?\\s+for\\s+(?:ai|llm|model|assistant)'),
      regexp_extract_all(t, '(?i)(?:ai|llm|model|assistant)\\s+(?:instructions?|guidelines?|rules?)')))) AS l
      FROM (SELECT page_id, {_ALL_TEXT} AS t FROM bare))) WHERE {valid('content')})"""
for _number, _op in enumerate(
    [
        "llm_from_comments", "llm_from_meta", "llm_from_elements", "llm_from_json_ld",
        "llm_from_hidden", "llm_from_text",
    ],
    start=1,
):
    CHECKS[_op] = query(
        f"""WITH {FINDS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS pos,
  content, source FROM f{_number}""",
        "bare", "scripts",
    )
_UNION = " UNION ALL ".join(f"SELECT {n} AS m, * FROM f{n}" for n in range(1, 7))
EMBEDDED = f"""{FINDS},
joined AS (SELECT page_id, string_agg(content, chr(10) || chr(10) ORDER BY m, ord) AS content,
    count(*) AS n, string_agg(source, '|' ORDER BY m, ord) AS sources FROM ({_UNION}) GROUP BY page_id),
embedded AS (SELECT p.page_id, coalesce({valid('j.content')}, false) AS found, j.content, j.n, j.sources
    FROM geo_pages p LEFT JOIN joined j ON j.page_id = p.page_id)"""
CHECKS["llm_embedded"] = query(
    f"""WITH {EMBEDDED} SELECT page_id, found, CASE WHEN found THEN content ELSE '' END AS content,
  CASE WHEN found THEN 'html_embedded_' || n || '_sources' END AS method,
  CASE WHEN found THEN sources ELSE '' END AS sources FROM embedded""",
    "bare", "scripts",
)


def _sections(source: str) -> str:
    """CTEs that put every line of ``source(page_id, content)`` into a section."""
    chain = " ".join(
        f"WHEN {contains_any('lower(line)', words)} THEN '{name}'"
        for name, words in fixed.LLM_SECTION_WORDS
    )
    return f"""lines AS (SELECT id, page_id, trim(unnest(l)) AS line, generate_subscripts(l, 1) AS ord
  FROM (SELECT row_number() OVER () AS id, page_id, string_split(content, chr(10)) AS l FROM {source})),
labelled AS (SELECT *, CASE WHEN line = '' THEN NULL WHEN starts_with(line, '#') THEN 'headers' {chain} END AS section FROM lines),
sectioned AS (SELECT id, page_id, {', '.join(
    f"coalesce(string_agg(line, '|' ORDER BY ord) FILTER (WHERE section = '{s}'), '') AS {s}" for s in fixed.LLM_SECTIONS)},
  count(section) AS items FROM labelled GROUP BY id, page_id)"""


_POINTS = " + ".join(
    f"CASE WHEN {name} <> '' THEN {points} ELSE 0 END"
    for name, points in fixed.LLM_SCORE_SECTION.items()
)
SCORE = f"""CAST(least(CASE WHEN items > 0 THEN {fixed.LLM_SCORE_ANY} ELSE 0 END + {_POINTS}
  + CASE WHEN items > 10 THEN 10 WHEN items > 5 THEN 5 ELSE 0 END, {fixed.LLM_SCORE_MAX}) AS BIGINT)"""
CHECKS["llm_sections"] = query(
    f"WITH {ANY_TEXTS}, {_sections('any_texts')} SELECT page_id, {', '.join(fixed.LLM_SECTIONS)} FROM sectioned",
    "geo_site_files",
)
CHECKS["llm_score"] = query(
    f"WITH {ANY_TEXTS}, {_sections('any_texts')} SELECT page_id, {SCORE} AS geo_relevance_score FROM sectioned",
    "geo_site_files",
)
LLM_TXT = f"""{EMBEDDED}, {RESOLVED},
merged AS (SELECT e.page_id, e.found OR r.found AS llm_txt_found,
  CASE WHEN NOT e.found THEN r.llm_txt_url END AS llm_txt_url,
  CASE WHEN e.found THEN e.content ELSE r.content END AS content,
  CASE WHEN e.found THEN 'html_embedded_' || e.n || '_sources' ELSE r.extraction_method END AS extraction_method,
  CASE WHEN e.found THEN 0 ELSE r.attempts_made END AS attempts_made,
  CASE WHEN e.found THEN e.sources ELSE '' END AS sources, CASE WHEN e.found THEN e.n ELSE 0 END AS n_sources
  FROM embedded e JOIN resolved r ON r.page_id = e.page_id),
llm AS (SELECT *, coalesce(octet_length(encode(content)), 0) AS size_bytes FROM merged)"""
_LLM_VIEWS = ("bare", "scripts", "geo_site_files")
CHECKS["llm_txt"] = query(
    f"""WITH {LLM_TXT}, {_sections('llm')}
SELECT l.page_id, llm_txt_found, llm_txt_url, size_bytes AS llm_txt_size_bytes, extraction_method, attempts_made, sources,
  coalesce({SCORE}, 0) AS geo_relevance_score FROM llm l LEFT JOIN sectioned s ON s.page_id = l.page_id""",
    *_LLM_VIEWS,
)

# ---------------------------------------------------------------------------------
# structure audit


def _count(pattern: str, x: str = "html") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


_FAQ_SQL = [
    ('(?i)<div[^>]*class="[^"]*faq[^"]*"[^>]*>', False),
    ('(?i)<section[^>]*class="[^"]*faq[^"]*"[^>]*>', False),
    ("(?i)<h[1-6][^>]*>[^<]*[?][^<]*</h[1-6]>", True),
    ("(?i)<dt[^>]*>[^<]*[?][^<]*</dt>", True),
    ('(?i)<p[^>]*class="[^"]*question[^"]*"[^>]*>', False),
    ('(?i)<div[^>]*class="[^"]*question[^"]*"[^>]*>', False),
]
_SCHEMA_SQL = {
    "json_ld": '(?i)<script[^>]*type="application/ld[+]json"[^>]*>',
    "microdata": "(?i)itemscope|itemtype|itemprop",
    "rdfa": "(?i)property=|typeof=|vocab=",
    "faq_schema": '(?i)"@type":\\s*"FAQ',
    "article_schema": '(?i)"@type":\\s*"Article',
    "organization_schema": '(?i)"@type":\\s*"Organization',
    "breadcrumb_schema": '(?i)"@type":\\s*"BreadcrumbList',
}
_HEADS = [f"h{n}" for n in fixed.HEADING_LEVELS]


def _missing(pairs) -> str:
    parts = ", ".join(f"CASE WHEN {condition} THEN '{label}' END" for label, condition in pairs)
    return f"concat_ws('|', {parts})"


AUDIT = f"""measured AS (SELECT t.page_id, t.url,
  len(regexp_extract_all(clean_text, '[^ \t\n\r]+')) AS word_count,
  len([x FOR x IN string_split(clean_text, chr(10) || chr(10)) IF regexp_matches(x, '[^ \t\n\r]')]) AS paragraph_count,
  length(clean_text) AS content_length,
  {', '.join(_count(f'(?is)<{h}[^>]*>(.*?)</{h}>') + f' AS {h}' for h in _HEADS)},
  {', '.join(_count(f'(?i)<{tag}[^>]*>') + f' AS {tag}' for tag in fixed.SEMANTIC_TAGS)},
  {' + '.join(_count(p) for p, _ in _FAQ_SQL)} AS faq_sections,
  {' + '.join(_count(p) for p, q in _FAQ_SQL if q)} AS question_patterns,
  {_count('(?i)Q:|A:|Question:|Answer:')} AS qa_indicators,
  {', '.join(_count(p) + f' AS {n}' for n, p in _SCHEMA_SQL.items())},
  regexp_matches(clean_text, '(?i)faq|frequently.*asked|common.*questions')
    AND NOT regexp_matches(html, '(?i)<[^>]*class="[^"]*faq[^"]*"[^>]*>') AS faq_unmarked
  FROM texts t),
audited AS (SELECT m.*, {' + '.join(_HEADS)} AS total_headings,
  CASE WHEN h1 = 0 THEN 'missing_h1' WHEN h1 > 1 THEN 'multiple_h1' ELSE '' END AS heading_issues,
  ({' + '.join(f'CAST({t} > 0 AS INT)' for t in fixed.SEMANTIC_TAGS)}) / 6.0::DOUBLE AS semantic_score,
  {_missing([(t, f'{t} = 0') for t in fixed.SEMANTIC_TAGS])} AS missing_elements,
  (CAST(has_title AS INT) + CAST(has_description AS INT)) / 2.0::DOUBLE AS critical_completeness,
  (CAST(og_title AS INT) + CAST(og_description AS INT) + CAST(og_image AS INT)) / 3.0::DOUBLE AS social_completeness,
  {_missing([('title', 'NOT has_title'), ('description', 'NOT has_description')])} AS missing_critical,
  {_missing([('og:title', 'NOT og_title'), ('og:description', 'NOT og_description'), ('og:image', 'NOT og_image')])} AS missing_social,
  faq_sections > 0 OR question_patterns > 3 OR qa_indicators > 6 AS has_faq,
  json_ld + microdata + rdfa AS total_markup,
  {' + '.join(fixed.SCHEMA_SPECIFIC)} AS specific_schemas,
  json_ld > 0 OR {' + '.join(fixed.SCHEMA_SPECIFIC)} > 0 AS has_structured_data,
  {_missing([('insufficient_content', 'word_count < 300'), ('missing_title', 'NOT has_title'),
             ('missing_description', 'NOT has_description'), ('missing_article_tags', 'article = 0'),
             ('missing_main_tag', 'main = 0'), ('missing_faq_structure', 'faq_unmarked'),
             ('missing_schema_markup', 'json_ld = 0')])} AS structural_issues
  FROM measured m JOIN presence p ON p.page_id = m.page_id)"""
_AUDIT_VIEWS = ("texts", "presence")
_CONTENT = ["word_count", "paragraph_count", "content_length"]
_HEADINGS = [*_HEADS, "total_headings", "heading_issues"]
_SEMANTIC = [*fixed.SEMANTIC_TAGS, "semantic_score", "missing_elements"]
_META = [
    "critical_completeness", "social_completeness", "missing_critical", "missing_social",
]
_FAQ = ["faq_sections", "question_patterns", "qa_indicators", "has_faq"]
_SCHEMA = [*_SCHEMA_SQL, "total_markup", "specific_schemas", "has_structured_data"]
for _op, _columns in {
    "content_metrics": _CONTENT,
    "heading_structure": _HEADINGS,
    "semantic_elements": _SEMANTIC,
    "meta_completeness": _META,
    "faq_structure": _FAQ,
    "schema_markup": _SCHEMA,
    "structural_issues": ["structural_issues"],
}.items():
    CHECKS[_op] = query(
        f"WITH {AUDIT} SELECT page_id, {', '.join(_columns)} FROM audited", *_AUDIT_VIEWS
    )

_SUMMARY = """llm_txt_found AS has_llm_txt, llm_txt_url, extraction_method,
  size_bytes AS content_size, n_sources AS sources_found, attempts_made"""
CHECKS["llm_summary"] = query(
    f"WITH {LLM_TXT} SELECT page_id, {_SUMMARY} FROM llm", *_LLM_VIEWS
)
_FULL = f"{LLM_TXT}, {AUDIT}, full_audit AS (SELECT a.*, {_SUMMARY} FROM audited a JOIN llm ON llm.page_id = a.page_id)"
_FULL_VIEWS = (*_LLM_VIEWS, *_AUDIT_VIEWS)
CHECKS["structure_analysis"] = query(
    f"""WITH {_FULL} SELECT page_id, url, {', '.join(_CONTENT + _HEADINGS + _SEMANTIC + _META + _FAQ + _SCHEMA)},
  structural_issues, has_llm_txt, llm_txt_url, extraction_method, content_size, sources_found, attempts_made
FROM full_audit""",
    *_FULL_VIEWS,
)
CHECKS["site_overview"] = query(
    f"""WITH {_FULL} SELECT page_id, word_count, total_headings, h1, h2, has_structured_data AS has_schema,
  has_faq, has_llm_txt, CAST(floor(semantic_score * 100 + 0.5) AS BIGINT) AS semantic_percent FROM full_audit""",
    *_FULL_VIEWS,
)

# ---------------------------------------------------------------------------------
# recommendations


def _rule(name: str, condition: str, value: str | None = None) -> str:
    title, description, priority = fixed.RULES[name]
    if value:
        before, after = description.split("{}")
        text = f"concat('{before}', {value}, '{after}')"
    else:
        text = f"'{description}'"
    return f"SELECT page_id, {{n}} AS rule, '{title}' AS title, {text} AS description, '{priority}' AS priority FROM full_audit WHERE {condition}"


_RULES = [
    _rule("llm_txt", "NOT has_llm_txt"),
    _rule("meta", "missing_critical <> ''", "replace(missing_critical, '|', ', ')"),
    _rule("no_h1", "h1 = 0"),
    _rule("many_h1", "h1 > 1", "h1 - 1"),
    _rule("few_headings", "h1 = 1 AND total_headings < 3", "total_headings"),
    _rule("short", "word_count < 300", "word_count"),
    _rule("semantic", "article = 0 OR section = 0"),
    _rule("json_ld", "json_ld = 0"),
    _rule("faq", "NOT has_faq AND word_count > 500"),
]
RECS = (
    _FULL
    + ", found AS ("
    + " UNION ALL ".join(r.replace("{n}", str(n)) for n, r in enumerate(_RULES))
    + "), recs AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY rule) - 1 AS pos,"
    " title, description, priority FROM found)"
)
CHECKS["rule_recommendations"] = query(f"WITH {RECS} SELECT * FROM recs", *_FULL_VIEWS)
_FILLERS = ", ".join(
    f"({i}, '{t}', '{d}', '{p}')" for i, (t, d, p) in enumerate(fixed.FILLERS)
)
CHECKS["fill_recommendations"] = query(
    f"""WITH {RECS}, fillers(pos, title, description, priority) AS (VALUES {_FILLERS})
SELECT p.page_id, CAST(f.pos AS BIGINT) AS pos, coalesce(r.title, f.title) AS title,
  coalesce(r.description, f.description) AS description, coalesce(r.priority, f.priority) AS priority
FROM geo_pages p CROSS JOIN fillers f
LEFT JOIN recs r ON r.page_id = p.page_id AND r.pos = f.pos""",
    *_FULL_VIEWS,
)
CHECKS["fill_all_recommendations"] = CHECKS["fill_recommendations"]
_PARSED = """parsed(page_id, pos, title, description, priority) AS (
  SELECT page_id, 0, concat('Add title ', page_id), concat('Write a title that names page ', page_id, ' clearly.'), 'High' FROM pages WHERE page_id % 7 = 0
  UNION ALL SELECT page_id, 0, concat('One ', page_id), 'Use headings that a model can follow.', 'Low' FROM pages WHERE page_id % 7 = 1
  UNION ALL SELECT page_id, 0, concat('T ', page_id), 'Describe the purpose of the page first.', 'Medium' FROM pages WHERE page_id % 7 = 2
  UNION ALL SELECT page_id, 1, 'U', 'Link the sources the page relies on.', 'Medium' FROM pages WHERE page_id % 7 = 2)"""
CHECKS["parse_recommendations"] = (
    f"WITH {_PARSED} SELECT page_id, CAST(pos AS BIGINT) AS pos, title, description, priority FROM parsed"
)
_LOOSE = """SELECT page_id, CAST(0 AS BIGINT) AS pos, concat('Loose ', page_id) AS title,
  'short' AS description, 'Medium' AS priority FROM pages WHERE page_id % 7 = 3"""
CHECKS["parse_recommendations_loose"] = _LOOSE
CHECKS["choose_recommendations"] = query(
    f"""WITH {RECS}, {_PARSED}, loose AS ({_LOOSE}),
model AS (SELECT * FROM parsed UNION ALL SELECT * FROM loose),
counted AS (SELECT page_id, count(*) AS n, min(title) FILTER (WHERE pos = 0) AS title FROM model GROUP BY page_id)
SELECT p.page_id, c.n IS NOT NULL AS from_model, coalesce(c.n, 4) AS entries,
  coalesce(c.title, r.title, '{fixed.FILLERS[0][0]}') AS first_title
FROM geo_pages p LEFT JOIN counted c ON c.page_id = p.page_id
LEFT JOIN recs r ON r.page_id = p.page_id AND r.pos = 0""",
    *_FULL_VIEWS,
)


def _listing(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN '[]' ELSE concat('[''', replace({x}, '|', ''', '''), ''']') END"


def _shown(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'True' ELSE 'False' END"


_PROMPT = f"""concat('Findings of a page audit for citation by AI systems:', chr(10),
  '- Missing meta tags: ', {_listing('missing_critical')}, chr(10), '- Word count: ', word_count, chr(10),
  '- H1 tags: ', h1, chr(10), '- Total headings: ', total_headings, chr(10),
  '- Missing elements: ', {_listing('missing_elements')}, chr(10), '- FAQ structure: ', {_shown('has_faq')}, chr(10),
  '- Schema markup: ', {_shown('has_structured_data')}, chr(10), '- LLM.txt file: ', {_shown('has_llm_txt')}, chr(10),
  'Give {fixed.RECOMMENDATIONS_KEPT} short recommendations, one about the LLM.txt file if it is missing.', chr(10),
  'Answer with a JSON array of objects with the keys "title", "description" and "priority" (High, Medium or Low), nothing else.')"""
CHECKS["structure_prompt"] = query(
    f"WITH {_FULL} SELECT page_id, md5({_PROMPT}) AS prompt_md5, length({_PROMPT}) AS prompt_length FROM full_audit",
    *_FULL_VIEWS,
)

# ---------------------------------------------------------------------------------
# query sets

_QUOTA = "CAST(greatest(1, round_even(n * share, 0)) AS BIGINT)"
CHECKS["query_quota"] = f"""WITH r AS (SELECT page_id, page_id % 50 + 1 AS n,
  CASE WHEN page_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS share FROM pages)
SELECT page_id, n AS num_queries, share AS direct_share, {_QUOTA} AS direct_count,
  n - {_QUOTA} AS generic_count FROM r"""
_QUESTION = f"""concat('Write questions that people could ask an AI assistant about the topics of the website text below.',
  chr(10), chr(10), 'TEXT:', chr(10), clean_text, chr(10), chr(10), 'Write exactly ', n, ' questions: ', {_QUOTA},
  ' of type "Direct" (they name the company or brand that owns the website) and ', n - {_QUOTA},
  ' of type "Generic" (they do not). When in doubt a question is Generic.', chr(10),
  'Answer with a JSON object {{"queries": [{{"query": "...", "type": "Direct"}}]}} and nothing else.')"""
CHECKS["query_prompt"] = query(
    f"""WITH r AS (SELECT page_id, clean_text, page_id % 50 + 1 AS n, 0.1::DOUBLE AS share FROM texts)
SELECT page_id, md5({_QUESTION}) AS prompt_md5, length({_QUESTION}) AS prompt_length FROM r""",
    "texts",
)
CHECKS["fallback_queries"] = query(
    f"""SELECT page_id, query, type FROM site_queries
UNION ALL SELECT page_id, '{fixed.FALLBACK_QUERY}', 'Generic' FROM pages
WHERE page_id NOT IN (SELECT page_id FROM site_queries)""",
    "site_queries",
)
CHECKS["query_list"] = query("SELECT query_id, query FROM geo_queries", "geo_queries")
CHECKS["queries_structured"] = query(
    "SELECT query_id, query, type FROM geo_queries", "geo_queries"
)


def _types(source: str, by: str = "") -> str:
    direct = "count(*) FILTER (WHERE type = 'Direct')"
    generic = "count(*) FILTER (WHERE type <> 'Direct')"
    return f"""SELECT {by + ',' if by else ''} count(*) AS total, {direct} AS direct, {generic} AS generic,
  {percent(direct, 'count(*)')} AS direct_percentage, {percent(generic, 'count(*)')} AS generic_percentage
FROM {source} {'GROUP BY ' + by if by else ''}"""


CHECKS["query_type_summary"] = query(_types("geo_queries"), "geo_queries")
CHECKS["query_type_summary_by_site"] = query(
    _types("site_queries", "page_id"), "site_queries"
)

# ---------------------------------------------------------------------------------
# citations

CHECKS["resolve_chunks"] = query(
    """SELECT c.query_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.title, c.redirect_url, r.actual_url
FROM chunks c LEFT JOIN redirects r ON r.redirect_url = c.redirect_url
WHERE c.redirect_url IS NOT NULL""",
    "chunks", "redirects",
)
CHECKS["ground_segments"] = query(
    """SELECT s.query_id, CAST(s.segment_pos AS BIGINT) AS segment_pos, s.text,
  CAST(s.start_index AS BIGINT) AS start_index, CAST(s.end_index AS BIGINT) AS end_index,
  g.link_pos, g.title, g.redirect_url
FROM supports s LEFT JOIN grounded g ON g.query_id = s.query_id AND g.segment_pos = s.segment_pos""",
    "grounded",
)
CHECKS["has_grounding"] = query(
    "SELECT query_id, query_id % 6 <> 5 AS has_grounding FROM turns", "turns"
)
CHECKS["grounded_domains"] = query(
    f"""SELECT coalesce(nullif({domain('g.title')}, ''), nullif({domain(netloc('r.actual_url'))}, '')) AS domain, count(*) AS count
FROM grounded g LEFT JOIN redirects r ON r.redirect_url = g.redirect_url
GROUP BY 1 HAVING domain IS NOT NULL""",
    "grounded", "redirects",
)
_DOMAIN = f"CASE WHEN title <> '' THEN {domain('title')} ELSE {domain(netloc('actual_url'))} END"
_HOST = f"CASE WHEN title <> '' THEN lower(title) ELSE lower({netloc('actual_url')}) END"
for _op, _grain in [("extract_domains", _DOMAIN), ("extract_hosts", _HOST)]:
    CHECKS[_op] = query(
        f"""SELECT query_id, segment_pos, CAST(link_pos AS BIGINT) AS link_pos, {_grain} AS domain FROM geo_links""",
        "geo_links",
    )


def _counted(grain: str = _DOMAIN) -> str:
    return f"""cited AS (SELECT *, {grain} AS domain FROM geo_links),
counts AS (SELECT query_id, domain, count(*) AS count, min(segment_pos * 10 + link_pos) AS seen FROM cited GROUP BY query_id, domain)"""


_CITATION_VIEWS = ("geo_queries", "geo_links")
CHECKS["domain_counts"] = query(
    f"""WITH {_counted()} SELECT query_id, domain, count, seen // 10 AS first_segment, seen % 10 AS first_link,
  row_number() OVER (PARTITION BY query_id ORDER BY count DESC, seen, domain) AS rank FROM counts""",
    *_CITATION_VIEWS,
)
CHECKS["analyze_queries"] = query(
    f"""WITH {_counted()} SELECT q.query_id, q.query, q.type AS query_type,
  q.query_id IN (SELECT query_id FROM answer_turns WHERE role = 'assistant') AS answered, c.domain, c.count
FROM geo_queries q LEFT JOIN counts c ON c.query_id = q.query_id""",
    *_CITATION_VIEWS,
)
CHECKS["domain_percentages"] = query(
    f"""WITH {_counted()}, total AS (SELECT count(*) AS n FROM geo_queries)
SELECT domain, count(DISTINCT query_id) AS query_count, {percent('count(DISTINCT query_id)', 'max(n)')} AS percentage
FROM counts CROSS JOIN total GROUP BY domain""",
    *_CITATION_VIEWS,
)


def _breakdown(by: str = "", grain: str = _DOMAIN) -> str:
    """Rows of queries by first result of equal text, then counts per domain."""
    keys = f"{by}, " if by else ""
    source = f"(SELECT *, {by} FROM geo_queries)" if by else "geo_queries"
    run = "query_id % 3 AS run"
    source = f"(SELECT *, {run} FROM geo_queries)" if by else "geo_queries"
    part = f"PARTITION BY {keys}query" if by else "PARTITION BY query"
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN sizes s ON s.{by} = l.{by}" if by else "CROSS JOIN sizes s"
    kinds = {
        "direct": "count(*) FILTER (WHERE lower(type) = 'direct')",
        "generic": "count(*) FILTER (WHERE lower(type) <> 'direct')",
        "total": "count(*)",
    }
    counts = ", ".join(f"{x} AS {k}_count" for k, x in kinds.items())
    shares = ", ".join(f"{percent(x, 'max(s.n)')} AS {k}_percentage" for k, x in kinds.items())
    return f"""{_counted(grain)},
listed AS (SELECT *, min(query_id) OVER ({part}) AS result_id FROM {source}),
sizes AS (SELECT {keys}count(*) AS n FROM listed {group}),
breakdown AS (SELECT {'l.' + keys if by else ''}c.domain, {counts}, {shares}
  FROM listed l JOIN counts c ON c.query_id = l.result_id {join} GROUP BY {'l.' + keys if by else ''}c.domain)"""


CHECKS["domain_breakdown"] = query(
    f"WITH {_breakdown()} SELECT * FROM breakdown", *_CITATION_VIEWS
)
CHECKS["host_breakdown_by_group"] = query(
    f"WITH {_breakdown('run', _HOST)} SELECT * FROM breakdown", *_CITATION_VIEWS
)
CHECKS["domain_totals"] = query(
    f"WITH {_counted()} SELECT domain, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY domain",
    *_CITATION_VIEWS,
)
CHECKS["query_details"] = query(
    f"""WITH cited AS (SELECT g.query_id, g.segment_pos, g.link_pos,
    coalesce(nullif({domain('g.title')}, ''), nullif({domain(netloc('r.actual_url'))}, '')) AS domain
  FROM grounded g LEFT JOIN redirects r ON r.redirect_url = g.redirect_url),
c AS (SELECT query_id, domain, count(*) AS n, min(segment_pos * 1000 + link_pos) AS seen FROM cited
  WHERE domain IS NOT NULL GROUP BY query_id, domain),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, seen, domain) AS rank FROM c),
d AS (SELECT query_id, string_agg(concat(rank, ' ', domain, ' ', n), '|' ORDER BY rank) AS domains FROM ranked GROUP BY query_id),
s AS (SELECT query_id, count(*) AS n, string_agg(text, '|' ORDER BY segment_pos) AS texts FROM supports GROUP BY query_id),
l AS (SELECT query_id, count(*) AS n FROM grounded GROUP BY query_id)
SELECT t.query_id, 'Generic' AS query_type, t.response_text, coalesce(s.n, 0) AS segments, coalesce(l.n, 0) AS links,
  coalesce(s.texts, '') AS segment_texts, coalesce(d.domains, '') AS domains
FROM turns t LEFT JOIN s ON s.query_id = t.query_id LEFT JOIN l ON l.query_id = t.query_id LEFT JOIN d ON d.query_id = t.query_id""",
    "grounded", "redirects", "turns",
)
CHECKS["top_domains"] = query(
    f"""WITH {_breakdown('', _HOST)} SELECT domain, direct_percentage, generic_percentage FROM breakdown
ORDER BY total_percentage DESC, domain LIMIT {fixed.CHART_DOMAINS}""",
    *_CITATION_VIEWS,
)
CHECKS["top_hosts_by_group"] = query(
    f"""WITH {_breakdown('run', _HOST)} SELECT run, domain, direct_percentage, generic_percentage FROM breakdown
QUALIFY row_number() OVER (PARTITION BY run ORDER BY total_percentage DESC, domain) <= {fixed.CHART_DOMAINS}""",
    *_CITATION_VIEWS,
)
CHECKS["query_domain_chart"] = query(
    f"WITH {_counted()} SELECT query_id, domain, count AS mentions FROM counts",
    *_CITATION_VIEWS,
)
_NULLS = "CAST(NULL AS DOUBLE)"
CHECKS["aggregate_results"] = query(
    f"""WITH {_breakdown()}, types AS ({_types('geo_queries')})
SELECT 'query' AS section, query AS item, type AS kind, query_id, CAST(NULL AS BIGINT) AS direct_count, CAST(NULL AS BIGINT) AS generic_count,
  CAST(NULL AS BIGINT) AS total_count, {_NULLS} AS direct_percentage, {_NULLS} AS generic_percentage, {_NULLS} AS total_percentage FROM geo_queries
UNION ALL SELECT 'query_types', NULL, NULL, NULL, direct, generic, total, direct_percentage, generic_percentage, NULL FROM types
UNION ALL SELECT 'domain_percentages', domain, NULL, NULL, NULL, NULL, count(*), NULL, NULL,
  {percent('count(*)', '(SELECT count(*) FROM geo_queries)')} FROM counts GROUP BY domain
UNION ALL SELECT 'domain_breakdown', domain, NULL, NULL, direct_count, generic_count, total_count,
  direct_percentage, generic_percentage, total_percentage FROM breakdown""",
    *_CITATION_VIEWS,
)

CHECKS["crawl_record"] = query(
    f"""WITH {LLM_TXT}, {_sections('llm')},
l AS (SELECT page_id, count(*) AS n, md5(string_agg(href || ' ' || text, '|' ORDER BY pos)) AS m
  FROM links GROUP BY page_id),
i AS (SELECT page_id, count(*) AS n, md5(string_agg(CASE WHEN contains(tag, 'src="data:') THEN regexp_extract(tag, 'src="([^"]*)"', 1)
  ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(tag, 'src="([^"]*)"', 1) END, '|' ORDER BY pos)) AS m FROM imgs GROUP BY page_id),
s AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE json_valid(body)) AS parsed FROM scripts GROUP BY page_id),
w AS (SELECT page_id, {_latest("$.author", "author", _name("$.author"))} FROM typed GROUP BY page_id)
SELECT p.page_id, coalesce(h.final_url, p.url) AS final_url, CAST(h.status_code AS BIGINT) AS status_code,
  length(p.raw_html) AS raw_length, length(p.rendered_html) AS rendered_length,
  trim({unescape("regexp_extract(b.html, '<title>([^<]*)</title>', 1)")}) AS title,
  regexp_extract(b.html, '<meta name="description" content="([^"]*)"', 1) AS description,
  nullif(regexp_extract(b.html, '<html lang="([^"]*)"', 1), '') AS html_lang, h.content_language AS header_language,
  coalesce(s.n, 0) AS json_ld_count, len(regexp_extract_all(b.html, '<[a-z]+ itemscope')) AS microdata_count,
  coalesce(s.parsed, 0) AS parsed_items, w.author, coalesce(l.m, md5('')) AS links_md5,
  coalesce(i.m, md5('')) AS images_md5, coalesce(l.n, 0) AS link_count,
  len(regexp_extract_all(t.clean_text, '[^ \t\n\r]+')) AS word_count,
  CAST(CASE WHEN p.page_id % 10 = 2 AND contains(p.rendered_html, 'llm-note') THEN 1 ELSE 0 END AS BIGINT) AS added_ids,
  m.llm_txt_found, coalesce({SCORE}, 0) AS geo_relevance_score
FROM geo_pages p JOIN bare b ON b.page_id = p.page_id JOIN texts t ON t.page_id = p.page_id
JOIN llm m ON m.page_id = p.page_id LEFT JOIN http_info h ON h.page_id = p.page_id
LEFT JOIN l ON l.page_id = p.page_id LEFT JOIN i ON i.page_id = p.page_id LEFT JOIN s ON s.page_id = p.page_id
LEFT JOIN w ON w.page_id = p.page_id LEFT JOIN sectioned x ON x.page_id = p.page_id""",
    *_LLM_VIEWS, "texts", "links", "imgs", "typed", "http_info",
)

CHECKS["write_results"] = query(
    f"""WITH {_counted()} SELECT q.query_id, q.type AS query_type, c.domain, c.count
FROM geo_queries q LEFT JOIN counts c ON c.query_id = q.query_id""",
    *_CITATION_VIEWS,
)

_RUNS = f"""asked AS (
  SELECT query_id, concat('q ', query_id % 40) AS query, CASE WHEN query_id % 5 = 0 THEN 'Direct' ELSE 'Generic' END AS type, query_id % 20 AS run_id, true AS answered FROM turns
  UNION ALL SELECT query_id, query, type, abs(query_id) % 20, false FROM geo_queries WHERE query_id < 0),
linked AS (SELECT g.query_id, g.segment_pos, g.link_pos, r.actual_url,
    coalesce(nullif({domain('g.title')}, ''), nullif({domain(netloc('r.actual_url'))}, '')) AS domain
  FROM grounded g LEFT JOIN redirects r ON r.redirect_url = g.redirect_url),
c AS (SELECT query_id, domain, count(*) AS n, min(segment_pos * 1000 + link_pos) AS seen FROM linked
  WHERE domain IS NOT NULL GROUP BY query_id, domain)"""
_RUN_VIEWS = ("grounded", "redirects", "turns", "geo_queries")
CHECKS["saved_runs"] = query(
    f"""WITH {_RUNS},
d AS (SELECT query_id, string_agg(concat(domain, ' ', n), '|' ORDER BY n DESC, seen, domain) AS links FROM c GROUP BY query_id),
s AS (SELECT query_id, count(*) AS n FROM supports GROUP BY query_id),
u AS (SELECT query_id, string_agg(coalesce(actual_url, '-'), '|' ORDER BY segment_pos, link_pos) AS urls FROM linked GROUP BY query_id)
SELECT i.i AS run_id, concat('https://site', i.i, '.example.org') AS url, i.i * 2 AS queries_to_run, '2024-01-01 00:00:00' AS saved_at,
  a.query, a.type AS query_type, CASE WHEN a.query_id IS NOT NULL THEN coalesce(d.links, '') END AS links,
  a.answered IS NULL OR NOT a.answered AS failed, CASE WHEN a.answered THEN s.n IS NOT NULL END AS has_grounding,
  CASE WHEN a.answered THEN coalesce(s.n, 0) END AS segments,
  CASE WHEN a.answered THEN md5(coalesce(u.urls, '')) END AS urls_md5
FROM range(0, 21) AS i(i) LEFT JOIN asked a ON a.run_id = i.i LEFT JOIN d ON d.query_id = a.query_id
LEFT JOIN s ON s.query_id = a.query_id LEFT JOIN u ON u.query_id = a.query_id""",
    *_RUN_VIEWS,
)
CHECKS["run_state_breakdown"] = query(
    f"""WITH {_RUNS},
listed AS (SELECT *, min(query_id) OVER (PARTITION BY run_id, query) AS result_id FROM asked)
SELECT domain, count(*) FILTER (WHERE type = 'Direct') AS direct_count, count(*) FILTER (WHERE type <> 'Direct') AS generic_count, count(*) AS total_count,
  {percent("count(*) FILTER (WHERE type = 'Direct')", '(SELECT count(*) FROM asked)')} AS direct_percentage,
  {percent("count(*) FILTER (WHERE type <> 'Direct')", '(SELECT count(*) FROM asked)')} AS generic_percentage,
  {percent('count(*)', '(SELECT count(*) FROM asked)')} AS total_percentage
FROM listed l JOIN c ON c.query_id = l.result_id GROUP BY domain""",
    *_RUN_VIEWS,
)
CHECKS["checked_answers"] = query(
    """SELECT CAST(query_id AS VARCHAR) AS query, CASE WHEN query_id % 7 <> 3 THEN length(response_text) END AS length,
  query_id % 7 = 3 AS is_broken FROM turns""",
    "turns",
)
CHECKS["normalize_domain_by_rules"] = f"""WITH {HOSTS},
rules AS (SELECT s.s || '.' || c.c AS rule FROM (SELECT unnest([{_quoted(fixed.SECOND_LEVEL_LABELS)}]) AS s) s, (SELECT unnest([{_quoted(fixed.COUNTRY_CODES)}]) AS c) c
  UNION SELECT CASE page_id % 5 WHEN 0 THEN array_to_string(string_split(lower(host), '.')[-3:], '.')
    WHEN 1 THEN '*.' || array_to_string(string_split(lower(host), '.')[-2:], '.') WHEN 2 THEN '!' || lower(host) END FROM hosts),
names AS (SELECT DISTINCT host, string_split(regexp_replace(lower(host), '^www[.]', ''), '.') AS l FROM hosts),
ends AS (SELECT host, l, k, array_to_string(l[-k:], '.') AS s FROM names, unnest(range(1, len(l) + 1)) AS r(k)),
met AS (SELECT host, k AS suffix, 0 AS kind FROM ends JOIN rules ON rule = s
  UNION ALL SELECT host, k + 1, 0 FROM ends JOIN rules ON rule = '*.' || s WHERE k < len(l)
  UNION ALL SELECT host, k - 1, 1 FROM ends JOIN rules ON rule = '!' || s),
suffixes AS (SELECT host, coalesce(max(suffix) FILTER (WHERE kind = 1), max(suffix)) AS suffix FROM met GROUP BY host)
SELECT page_id, h.host, array_to_string(n.l[-(coalesce(suffix, 1) + 1):], '.') AS domain
FROM hosts h JOIN names n ON n.host = h.host LEFT JOIN suffixes s ON s.host = h.host"""
