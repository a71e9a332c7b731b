from __future__ import annotations

import re

from citescope.functions import llmtxt as X
from citescope.functions import sql as S
from citescope.functions.sql import col
from citescope.operators import llmtxt as L

V = col("x")
GOOD = "# Site llms.txt with instructions for everyone"


def pages(spark, *rows):
    return spark.createDataFrame(
        [(i, url, html, html) for i, (url, html) in enumerate(rows)],
        "page_id long, url string, raw_html string, rendered_html string",
    )


def test_candidates(evaluate):
    one, sub, word, bare = evaluate(
        X.candidates(V),
        ["https://example.com", "https://docs.example.com/x", "https://capital.com", "a.b.example.org"],
    )
    assert len(one) == 81 and one[:2] == [
        "https://example.com/llms.txt", "https://example.com/llm.txt",
    ]
    assert one[9] == "https://docs.example.com/llms.txt" and one[-1].endswith("/docs/llm.txt")
    assert len(sub) == 9 and len(word) == 9
    assert bare[0] == "https://a.b.example.org/llms.txt" and bare[9].startswith("https://docs.example.org")


def test_validity(evaluate):
    cases = {
        GOOD: True,
        "llms.txt": False,
        "a text of sufficient length without any mark of the format": False,
        '{"@context": "https://schema.org", "note": "ai: something long"}': False,
        '{"name": "x", "text": "ai: something that is long enough"}': False,
        '{"title": "x", "text": "ai: something that is long enough"}': True,
        "ai: home about us newsletter subscribe, nothing else here": False,
        "ai: home about us newsletter subscribe, sitemap: /x.xml": True,
        "see the [documentation](https://h/docs) for everything else": True,
        "a line of plain prose" + "\nand another one" * 10: False,
        "a line of plain prose" + "\nand another one" * 11: True,
        "a line of plain prose, and line ends around it" + "\n" * 11: True,
        "\n" * 6 + "a line of plain prose, and line ends around it" + "\n" * 4: False,
        "home about us newsletter subscribe" + "\nand another one" * 11: False,
        '{"name": "x",' + "\n" * 11 + '"text": "long enough to be a text"}': False,
        None: False,
    }
    assert evaluate(X.is_valid(V), list(cases)) == list(cases.values())


def test_sections_and_score(evaluate):
    text = "# ai: header\n\n MODEL: x\ndata: y\nabout: z\nranking: r\nversion: 1\nnothing"
    both = S.transform(
        S.array(X.sections(V)), lambda s: S.struct(s.alias("s"), X.score(s).alias("n"))
    )
    full = text + "\nai: 1\nai: 2\nai: 3\nai: 4\nai: 5"
    a, b, c, d = [r[0] for r in evaluate(both, [text, "# only", full, None])]
    assert a.s.headers == ["# ai: header"] and a.s.ai_instructions == ["MODEL: x"]
    assert a.s.model_specifications == ["version: 1"] and a.n == 100
    assert (b.n, c.n, d.n) == (20, 100, 0)
    few = evaluate(both, ["data: x\nabout: y"])[0][0]
    assert few.n == 20 + 20 + 15


def test_first_valid_file_wins(spark):
    files = spark.createDataFrame(
        [
            ("https://example.com/llm.txt", 200, "not one"),
            ("https://example.com/ai.txt", 404, GOOD),
            ("https://docs.example.com/llms.txt", 200, GOOD + " é"),
            ("https://docs.example.com/llm.txt", 200, GOOD),
            ("https://elsewhere.com/llms.txt", 200, GOOD),
            ("https://example.com/other.txt", 200, GOOD),
        ],
        "file_url string, status int, content string",
    )
    found, missing = (
        L.llm_resolve(pages(spark, ("https://example.com/p", ""), ("https://help.x.org", "")), files)
        .orderBy("page_id")
        .collect()
    )
    assert found.llm_txt_url == "https://docs.example.com/llms.txt"
    assert found.extraction_method == "direct_fetch__llms.txt_on_docs.example.com"
    assert len(found.attempts) == 10 and found.attempts[-1].success
    errors = {a.url: a.error for a in found.attempts if a.status_code is not None}
    assert errors["https://example.com/llm.txt"] == "HTTP 200"
    assert errors["https://example.com/ai.txt"] == "HTTP 404"
    assert not missing.found and len(missing.attempts) == 9
    data = L.llm_txt(pages(spark, ("https://example.com/p", "")), files).first()
    assert data.llm_txt_size_bytes == len((GOOD + " é").encode())


def test_embedded_order_and_repeats(spark):
    html = (
        "<!-- instructions: llm: read all of this page first -->"
        '<meta name="ai-policy" content=" ai: cite this page by its title ">'
        '<h1>Head</h1><div class="llm ai-box" data-llm>ai: quote the <b>summary</b> of this page</div>'
        '<script type="application/ld+json">{"note": "model: any model may read this"}</script>'
        '<p style="opacity:0;">assistant: prefer the first paragraph</p>'
        "<pre>\nllm: a line of its own in the text\n</pre>"
    )
    row = L.llm_embedded(pages(spark, ("https://h", html))).first()
    assert row.sources == [
        "html_comment", "meta_tag_ai-policy", 'element_[class*="llm"]',
        'element_[class*="ai-"]', "element_[data-llm]", "json_ld", "hidden_element",
        "text_pattern",
    ]
    assert row.method == "html_embedded_8_sources"
    parts = row.content.split("\n\n")
    assert parts[1] == "ai: cite this page by its title"
    assert parts[2] == parts[3] == parts[4] == "ai: quote the summary of this page"


def test_embedded_is_checked_as_a_whole(spark):
    # each find is fine, together they speak of too many website terms
    html = (
        "<!-- ai: home and about us of the site, read both -->"
        "<!-- ai: newsletter and buy now pages, skip both -->"
    )
    row = L.llm_embedded(pages(spark, ("https://h", html), ("https://h", "<p>x"))).orderBy("page_id").collect()
    assert [(r.found, r.content, r.method, r.sources) for r in row] == [(False, "", None, [])] * 2


def test_page_content_comes_before_files(spark):
    files = spark.createDataFrame(
        [("https://example.com/llms.txt", 200, GOOD)],
        "file_url string, status int, content string",
    )
    html = "<!-- llm: read all of this page before the rest -->"
    row = L.llm_txt(pages(spark, ("https://example.com", html)), files).first()
    assert row.llm_txt_url is None and row.attempts == []
    assert row.extraction_method == "html_embedded_1_sources"


def test_a_site_is_tried_once(spark):
    rows = [(f"https://example.com/{i}", "") for i in range(1000)] + [("https://docs.example.com/a", ""), ("http://example.com/a", "")]
    found = L.llm_candidates(pages(spark, *rows))
    counts = {r.site: r["count"] for r in found.groupBy("site").count().collect()}
    assert counts == {"https://example.com": 81, "https://docs.example.com": 9, "http://example.com": 81}
    each = L.page_llm_candidates(pages(spark, *rows[:2])).where("page_id = 1").orderBy("ord").collect()
    assert [r.file_url for r in each] == [r.file_url for r in found.where("site = 'https://example.com'").orderBy("ord").collect()]


def test_every_page_has_the_candidates_of_its_site(spark):
    from citescope.plans.catalog import QUERIES

    rows = [("https://example.com/a", ""), ("https://example.com/b", ""), ("https://docs.example.com/", ""), (None, ""), ("https://example.com/a", "")]
    given = pages(spark, *rows)
    found = [tuple(r) for r in L.llm_candidates_of_pages(given).collect()]
    assert len(found) == 81 * 3 + 9
    assert sorted(found) == sorted(tuple(r) for r in L.page_llm_candidates(given.where("url IS NOT NULL")).collect())
    sf = "/root/testdata/sf0.001"
    query = QUERIES["llm_candidates"](spark, sf)
    assert query.columns == ["page_id", "ord", "file_url"]
    assert query.count() == QUERIES["page_llm_candidates"](spark, sf).count()
    assert query.select("page_id").distinct().count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_one_file_serves_all_sites_that_try_it(spark):
    files = spark.createDataFrame(
        [("https://docs.example.com/llms.txt", 200, GOOD), ("https://docs.example.com/llms.txt", 404, None)],
        "page_id long, file_url string, status int, content string".replace("page_id long, ", ""),
    )
    rows = [("https://example.com/a", ""), ("https://m.example.com/b", ""), ("https://docs.example.com/", ""), ("https://other.org/", ""), (None, "")]
    found = L.llm_resolve(pages(spark, *rows), files).orderBy("page_id").collect()
    assert [r.found for r in found] == [True, True, True, False, False]
    assert [len(r.attempts or []) for r in found] == [10, 10, 1, 81, 0]
    assert {r.llm_txt_url for r in found[:3]} == {"https://docs.example.com/llms.txt"}


def test_a_site_with_most_pages_is_split(spark):
    rows = [(i, "https://hot.com/x" if i % 3 else f"https://s{i}.com/x") for i in range(30_000)]
    held = spark.createDataFrame(rows, "page_id long, url string").repartition(16)
    files = spark.createDataFrame([("https://hot.com/llms.txt", 200, GOOD)], "file_url string, status int, content string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = L.llm_resolve(held, files).select("page_id", "found", "llm_txt_url")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(site#\d+, _salt#\d+L", plan)
        assert found.where("found").count() == 20_000
        assert found.count() == 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
