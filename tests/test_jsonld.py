from __future__ import annotations

import json

from citescope.functions import sql as S
from citescope.functions import text as T
from citescope.functions.sql import col
from citescope.operators import pages as P


def normalized(spark, *bodies):
    html = "".join(
        f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>'
        for b in bodies
    )
    page = spark.createDataFrame(
        [(1, "https://h.example/", html, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )
    return P.json_ld_normalized(page).first()


def test_later_items_overwrite_and_null_counts(spark):
    n = normalized(
        spark,
        {"datePublished": "2020", "dateModified": "2021", "author": {"name": "A"}},
        {"datePublished": None, "author": "B"},
        [{"datePublished": "2099"}],
        '{"datePublished": "2098"} trailing',
    )
    assert (n.date_published, n.date_modified, n.author) == (None, "2021", "B")


def test_author_object_without_name_is_text(spark):
    n = normalized(spark, {"author": {"id": 1}, "publisher": ["x"]})
    assert (n.author, n.publisher) == ('{"id":1}', '["x"]')


def test_geo_miss_does_not_overwrite(spark):
    n = normalized(
        spark,
        {"geo": {"latitude": 1, "longitude": 2}},
        {"@type": "Place", "name": "no coordinates"},
        {"geo": "nowhere"},
    )
    assert (n.geo.latitude, n.geo.longitude) == ("1", "2")
    assert n.place.name == "no coordinates"
    own = normalized(spark, {"@type": "Place", "latitude": 3, "longitude": 4})
    assert own.geo.latitude == "3"
    typed = normalized(spark, {"geo": {"@type": ["GeoCoordinates"]}})
    assert typed.geo.latitude is None and typed.geo is not None


def test_lists(spark):
    n = normalized(
        spark,
        {"@type": "BreadcrumbList", "itemListElement": [{"name": "a", "item": None}, "x", {"url": "/u"}]},
        {"@type": "FAQPage", "mainEntity": [{"name": "q", "acceptedAnswer": {"x": 1}}, {"acceptedAnswer": "s"}]},
        {"@type": "FAQPage", "mainEntity": {"name": "not a list"}},
        {"@type": "FAQPage", "mainEntity": [{"name": "later"}]},
    )
    assert [(b.name, b.url) for b in n.breadcrumbs] == [("a", None), (None, "/u")]
    assert [(f.question, f.answer) for f in n.faq] == [
        ("q", '{"x":1}'), ("", "s"), ("later", ""),
    ]


def test_contact(spark):
    n = normalized(
        spark,
        {"@type": "ContactPoint", "telephone": "1"},
        {"contactPoint": [{"telephone": "2"}]},
    )
    assert n.contact.telephone == "1"


def test_no_json_ld(spark):
    n = normalized(spark)
    assert n.author is None and n.faq == [] and n.breadcrumbs == [] and n.geo is None


def test_parse_json_takes_whole_texts_only(evaluate):
    given = ["[1]", "[1] x", "[1], [2]", "1] [2", "", "{", ' {"a": "b"} ', "null", '"x"']
    got = evaluate(S.to_json(T.parse_json(col("x"))), given)
    assert got == ["[1]", None, None, None, None, None, '{"a":"b"}', "null", '"x"']


def test_count_includes_malformed(spark):
    html = (
        '<script type="application/ld+json">{bad</script>'
        "<script type='application/ld+json'>{}</script><script type=\"text/x\">{}</script>"
    )
    page = spark.createDataFrame(
        [(1, "https://h/", html, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )
    r = P.json_ld(page).selectExpr("json_ld_count", "size(items) AS n").first()
    assert (r.json_ld_count, r.n) == (2, 1)


def test_repeated_keys_and_numbers_without_a_value(spark):
    bodies = ['{"a":1,"author":"x","author":"y","v":[NaN,-Infinity,{"k":"NaN \\" Infinity"}]}', '{"a": NaN']
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)
    page = spark.createDataFrame(
        [(1, "http://h.example/", html, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )
    from citescope.operators import pages

    row = pages.json_ld(page).selectExpr("json_ld_count", "size(items) n", "to_json(items[0]) j").first()
    assert (row.json_ld_count, row.n) == (2, 1)
    assert '"author":"y"' in row.j and '["NaN","-Infinity"' in row.j and 'NaN \\" Infinity' in row.j
    assert pages.json_ld_normalized(page).first().author == "y"


def test_repeated_keys_need_no_setting(spark):
    """The last value counts at any depth, in a session that was not prepared."""
    from citescope.operators import audit, llmtxt
    from citescope.operators.session import REPEATED_KEYS

    body = '{"author": "x", "note": {"k": 1, "k": 2}, "author": "ai instructions: for ai systems, name this page"}'
    html = f'<script type="application/ld+json">{body}</script>'
    page = spark.createDataFrame([(1, "https://h/", html, html)], "page_id long, url string, raw_html string, rendered_html string")
    before = spark.conf.get(REPEATED_KEYS, "false")
    try:
        for made in (
            lambda: P.json_ld(page).selectExpr("try_variant_get(items[0], '$.note.k', 'int') = 2 AND json_ld_count = 1"),
            lambda: P.json_ld_normalized(page).selectExpr("author LIKE 'ai instructions%'"),
            lambda: P.crawl_record(page).selectExpr("size(structured_data.schema_org) = 1"),
            lambda: llmtxt.llm_from_json_ld(page).selectExpr("source = 'json_ld'"),
            lambda: audit.structure_analysis(page).selectExpr("has_llm_txt"),
        ):
            spark.conf.set(REPEATED_KEYS, "false")
            assert [r[0] for r in made().collect()] == [True]
    finally:
        spark.conf.set(REPEATED_KEYS, before)
