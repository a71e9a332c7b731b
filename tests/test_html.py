from __future__ import annotations

import html as stdlib
from html.parser import HTMLParser

from citescope.functions import extract as E
from citescope.functions import html as H
from citescope.functions import sql as S
from citescope.functions import text as T
from citescope.functions.sql import col
from citescope.operators import pages as P

X = col("x")


class Recorder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append(("start", tag, [(k, v or "") for k, v in attrs]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in ("script", "style"):
            self.out.append(("end", tag, None))

    def handle_comment(self, data):
        self.out.append(("comment", None, None))


def recorded(text):
    parser = Recorder()
    parser.feed(text)
    parser.close()
    return parser.out


def marks():
    """Tags and comments of a page in the recorder's form."""
    tokens = S.filter(H.tokens(X), lambda t: ~t["kind"].isin("text", "decl"))
    return S.transform(
        tokens,
        lambda t: S.struct(
            S.when(t["kind"] == "raw", "start").otherwise(t["kind"]).alias("kind"),
            t["tag"],
            S.when(t["kind"].isin("start", "raw"), H.attributes(t["raw"])).alias("attrs"),
        ),
    )


def read_marks(rows):
    return [
        (
            t.kind,
            t.tag,
            None if t.attrs is None else [(a.name, a.value) for a in t.attrs],
        )
        for t in rows
    ]


SNIPPETS = [
    "<a href=foo/bar title='x>y' b>t</a>",
    "<p title=it's>x</p><a href='z'>",
    '<IMG SRC="a.png"/><br/>',
    "<a\nhref = \"q&amp;a&#39;&#x41;&euro;&nope;\" HREF=two>",
    "a < b <c",
    "<!-- x > y --><b>",
    "<script>if(a<b){'<p>'}</script><i>",
    '<div class="a"id="b">',
    "<a href=>x</a>",
    "<!DOCTYPE html><p a=1 a=2>",
    "<style>p>a{}</style ><p>",
    "<a-b c:d=e>",
]


def test_tokens_follow_the_standard_library(evaluate):
    for snippet, got in zip(SNIPPETS, evaluate(marks(), SNIPPETS), strict=True):
        assert read_marks(got) == recorded(snippet), snippet


def test_tokens_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.selectExpr("html AS x").select("x", marks().col("m")).collect()
    assert all(read_marks(r.m) == recorded(r.x) for r in rows)


def test_tokens_keep_every_character(spark, evaluate):
    whole = S.array_join(S.transform(H.tokens(X), lambda t: t["raw"]), "")
    assert evaluate(whole, SNIPPETS) == SNIPPETS


def test_very_long_tag_does_not_overflow(evaluate):
    text = "<a " + "x " * 200_000 + "href='u'>t</a>"
    assert evaluate(S.size(H.tokens(X)), [text]) == [3]


def test_unescape(evaluate):
    given = [
        "&amp;lt; &lt; &#38; &#x1F600; &#128; &#xD800; &#99999999999; &copy 2 &eacute;x",
        "&bogus; & x &; &#; &#x;",
        "plain",
    ]
    assert evaluate(T.unescape(X), given) == [stdlib.unescape(x) for x in given]


def _spans(*tags):
    return S.transform(
        S.transform(
            S.array(H.tokens(X)),
            lambda t: S.transform(
                H.spans(t, lambda e, i: e["tag"].isin(list(tags))),
                lambda s: H.span_text(t, s["pos"], s["close"]),
            ),
        ),
        lambda found: found,
    )


def test_spans_close_with_their_parent(evaluate):
    cases = {
        "<a>x</a>": ["x"],
        "<div><a>open</div>later": ["open"],
        "<a>1<a>2</a>3</a>": ["123", "2"],
        "<a>x</b>y</a>z": ["xy"],
        "<a>to the end": ["to the end"],
        "<div><a>1</div><a>2</a>": ["1", "2"],
        "<a>t<script>var x='<a>'</script><!-- c -->u</a>": ["tu"],
        "<p>no anchor": [],
    }
    assert [r[0] for r in evaluate(_spans("a"), list(cases))] == list(cases.values())


def _page(spark, html, raw=None, url="https://h.example/d/p"):
    return spark.createDataFrame(
        [(1, url, html if raw is None else raw, html)],
        "page_id long, url string, raw_html string, rendered_html string",
    )


def test_links(spark):
    html = (
        '<a href=" /x#a#b " rel="nofollow  me" title="T"> é <b>b</b> </a><a>no</a>'
        '<a href="JavaScript:x">kept</a><a href="tel:1">no</a><a href="">no</a>'
        '<a href="https://other.example/">' + "y" * 300 + "</a>"
    )
    rows = P.page_links(_page(spark, html)).orderBy("pos").collect()
    assert [(r.href, r.rel, r.is_internal, r.anchor_hash, r.title) for r in rows] == [
        ("https://h.example/x#a#b", ["nofollow", "me"], True, "b", "T"),
        ("JavaScript:x", [], True, None, ""),
        ("https://other.example/", [], False, None, ""),
    ]
    assert rows[0].text == "é b" and len(rows[2].text) == 300
    assert len(P.page_links(_page(spark, html), text_length=200).collect()[2].text) == 200


def test_meta(spark):
    html = (
        "<html lang=''><title> A &amp; B </title><title>second</title>"
        '<meta name="description"><meta name="description" content="late">'
        '<link rel="x canonical" href="/c"><link rel="alternate"><link rel="alternate" hreflang="de">'
        '<meta property="og:title" content="1"><meta property="og:title" content="2">'
        '<meta property="og:image" content=""><meta name="twitter:card" content="s">'
    )
    page = _page(spark, html)
    m = P.meta_scalars(page).first()
    assert (m.title, m.description, m.canonical, m.robots) == ("A & B", "", "/c", "")
    assert [(r.hreflang, r.href) for r in P.meta_hreflang(page).collect()] == [("de", None)]
    assert [(r.key, r.value) for r in P.meta_open_graph(page).collect()] == [("title", "2")]
    assert [(r.key, r.value) for r in P.meta_twitter(page).collect()] == [("card", "s")]
    assert P.page_language(page).first().html_lang is None


def test_dom_diff(spark):
    before = '<i id="a"><i id="b"><i id="b">'
    after = '<i id="b"><script id="n1"></script>' + "".join(
        f'<i id="m{i:02}">' for i in range(12)
    )
    d = P.dom_diff(_page(spark, after, before)).first()
    assert (d.added_nodes_count, d.removed_nodes_count) == (13, 1)
    assert d.added_selectors == [f"m{i:02}" for i in range(12)] + ["n1"]
    assert d.removed_selectors == ["a"]
    few = P.dom_diff(_page(spark, after, before), sample=10).first()
    assert few.added_selectors == [f"m{i:02}" for i in range(10)]
    assert d.has_significant_changes
    same = P.dom_diff(_page(spark, before)).first()
    assert (same.added_nodes_count, same.has_significant_changes) == (0, False)
    scripts = P.dom_diff(_page(spark, "<p><script></script>", "<p>")).first()
    assert (scripts.added_nodes_count, scripts.has_significant_changes) == (0, True)


def test_scripts(evaluate):
    given = ["", "<p>", "<script></script>", "<script async></script>", "<SCRIPT>" * 6]
    found = evaluate(E.js_detection(X), given)
    assert [(r.javascript_executed, r.javascript_modified_dom) for r in found] == [
        (False, False), (True, False), (True, False), (True, True), (True, True),
    ]


def test_word_count_uses_unicode_space(evaluate):
    given = ["a b c\x1cd\x85e", "  ", None, ""]
    assert evaluate(T.word_count(X), given) == [5, 0, 0, 0]


def test_record_keeps_all_unless_told(spark):
    html = "".join(f'<a href="/{i}">x</a>' for i in range(130)) + '<img src="a.png">' * 60
    r = P.crawl_record(_page(spark, html)).first()
    assert (len(r.links), len(r.images)) == (130, 60)
    r = P.crawl_record(_page(spark, html), max_links=100, max_images=50).first()
    assert (len(r.links), len(r.images)) == (100, 50)
    assert (r.content_stats.link_count, r.content_stats.image_count) == (130, 60)


def test_record_has_one_llm_txt_schema(spark):
    page = _page(spark, "<p>x")
    files = spark.createDataFrame([], "file_url string, status int, content string")
    bare, joined = P.crawl_record(page), P.crawl_record(page, site_files=files)
    assert bare.schema["llm_txt"].dataType.names == joined.schema["llm_txt"].dataType.names
    assert bare.first().llm_txt.llm_txt_found is False


def test_ids_without_a_space_before_them(spark):
    d = P.dom_diff(_page(spark, '<p class="a"id="x">..<p id="y">', "<p>")).first()
    assert d.added_selectors == ["x", "y"]


def test_elements_marked_by_character_references(spark):
    from citescope.operators import llmtxt

    text = "ai instructions: for ai systems, name this page"
    html = f'<div class="&#108;lm">{text} 1</div><div id="a&#105;-x">{text} 2</div>'
    assert llmtxt.llm_from_elements(_page(spark, html)).count() == 2


def test_time_follows_the_length_of_the_page(spark):
    import time

    for piece in ("<p><a href='/%d'>t</a></p>", "<p><a href='/%d'>t</a>"):
        seconds = []
        for n in (2000, 2000, 4000, 8000):
            page = _page(spark, "".join(piece % i for i in range(n)))
            start = time.perf_counter()
            assert P.page_links(page).count() == n
            seconds.append(time.perf_counter() - start)
        assert seconds[3] < 2.5 * max(seconds[2], 1.0) and seconds[2] < 2.5 * max(seconds[1], 1.0)


def test_odd_tag_names(evaluate):
    given = ["<x|1><a>t</x|1>u</a>", "<h1><a>1</h1>2", "<p><a>1<b 7><a>2</p>3"]
    assert [r[0] for r in evaluate(_spans("a"), given)] == [["t"], ["1"], ["12", "2"]]


def test_all_named_references(evaluate):
    from html.entities import html5

    given = [f"&{name}" for name in html5 if name.endswith(";")]
    read = evaluate(H.joined_text(H.tokens(X)), given)
    assert read == [stdlib.unescape(x) for x in given]
    tagged = [f'<i title="{x}">' for x in given[:200]]
    title = H.attribute(H.attributes(S.get(H.tokens(X), 0)["raw"]), "title")
    assert evaluate(title, tagged) == [stdlib.unescape(x) for x in given[:200]]


def test_templates_and_ruby_notes_are_not_read(spark):
    html = (
        "<body><p>seen</p><template><p>ai: hidden <b>rule</b> for all models here</p></template>"
        "<ruby>base<rp>(</rp><rt>note</rt><rp>)</rp></ruby><p>end</p>"
    )
    assert P.page_text(_page(spark, html)).first().clean_text == "seen\n\nbase\n\nend"
    from citescope.operators import llmtxt

    assert llmtxt.llm_from_text(_page(spark, html)).count() == 0
