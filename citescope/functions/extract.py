"""What a page's tokens say: meta data, links, images, language, scripts."""

from __future__ import annotations


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions import html as H
from citescope.functions.text import (
    any_of,
    contains_any,
    first,
    last,
    let,
    split_words,
    strip,
    word_count,
)
from citescope.functions.urls import is_internal, resolve_link, url_netloc


def _or_empty(text: Expr) -> Expr:
    return F.coalesce(text, F.lit(""))


# ---------------------------------------------------------------------------------
# meta data


def _metas(head_array: Expr) -> Expr:
    return H.pick(head_array, "meta", "name", "property", "content")


def _link_tags(head_array: Expr) -> Expr:
    return H.pick(head_array, "link", "rel", "href", "hreflang")


def _has_rel(link: Expr, value: str) -> Expr:
    return F.array_contains(split_words(_or_empty(link["rel"])), value)


def _named(metas: Expr, name: str) -> Expr:
    """Content of the first meta tag of a name, filled or not."""
    return _or_empty(first(F.filter(metas, lambda m: m["name"] == name))["content"])


def meta_scalars(token_array: Expr, head_array: Expr) -> Expr:
    """First title, description, canonical, robots and viewport; empty when absent."""
    canonical = first(
        F.filter(_link_tags(head_array), lambda x: _has_rel(x, "canonical"))
    )
    return let(
        _metas(head_array),
        lambda metas: F.struct(
            _or_empty(H.title_text(token_array)).alias("title"),
            _named(metas, "description").alias("description"),
            _or_empty(canonical["href"]).alias("canonical"),
            _named(metas, "robots").alias("robots"),
            _named(metas, "viewport").alias("viewport"),
        ),
    )


def meta_presence(token_array: Expr, head_array: Expr) -> Expr:
    """struct of booleans: which audited tags have a non-empty value."""
    return let(
        _metas(head_array),
        lambda metas: F.struct(
            (_or_empty(H.title_text(token_array)) != "").alias("title"),
            (_named(metas, "description") != "").alias("description"),
            *[
                F.coalesce(
                    F.exists(
                        metas,
                        lambda m, t=tag: (m["property"] == t) & (m["content"] != ""),
                    ),
                    False,
                ).alias(tag.replace(":", "_"))
                for tag in fixed.SOCIAL_TAGS
            ],
        ),
    )


def hreflang(head_array: Expr) -> Expr:
    """array<struct<hreflang, href>> of the alternate-language links."""
    return F.transform(
        F.filter(
            _link_tags(head_array),
            lambda x: _has_rel(x, "alternate") & x["hreflang"].isNotNull(),
        ),
        lambda x: F.struct(x["hreflang"], x["href"]),
    )


def _prefixed(head_array: Expr, key: str, prefix: str) -> Expr:
    """map of meta tags whose ``key`` has a prefix; the last of equal names wins."""
    entries = F.filter(
        F.transform(
            F.filter(_metas(head_array), lambda m: m[key].startswith(prefix)),
            lambda m: F.struct(
                F.replace(m[key], prefix, "").alias("key"),
                _or_empty(m["content"]).alias("value"),
            ),
        ),
        lambda e: (e["key"] != "") & (e["value"] != ""),
    )
    return let(
        entries,
        lambda found: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(found, lambda e: e["key"])),
                lambda k: F.struct(
                    k.alias("key"),
                    last(F.filter(found, lambda e: e["key"] == k))["value"].alias(
                        "value"
                    ),
                ),
            )
        ),
    )


def open_graph(head_array: Expr) -> Expr:
    return _prefixed(head_array, "property", "og:")


def twitter(head_array: Expr) -> Expr:
    return _prefixed(head_array, "name", "twitter:")


def html_lang(head_array: Expr) -> Expr:
    lang = first(H.pick(head_array, "html", "lang"))["lang"]
    return F.when(lang != "", lang)


# ---------------------------------------------------------------------------------
# links and images


def raw_links(token_array: Expr, text_length: int | None = None) -> Expr:
    """array<struct<href, text, rel, title>> of usable links, addresses as written.

    ``text_length`` cuts link texts; by default they are whole.
    """
    anchors = F.transform(
        H.spans(
            token_array,
            lambda t, i: (t["tag"] == "a") & F.lower(t["raw"]).contains("href"),
        ),
        lambda s: F.struct(
            s.alias("span"),
            H.attributes(F.get(token_array, s["pos"])["raw"]).alias("attrs"),
        ),
    )
    read = F.transform(
        anchors,
        lambda a: F.struct(
            a["span"].alias("span"),
            strip(H.attribute(a["attrs"], "href")).alias("href"),
            H.attribute(a["attrs"], "rel").alias("rel"),
            H.attribute(a["attrs"], "title").alias("title"),
        ),
    )
    usable = F.filter(
        read,
        lambda a: (a["href"] != "")
        & ~any_of(a["href"].startswith(p) for p in fixed.SKIPPED_LINK_PREFIXES),
    )

    def text(span):
        whole = strip(H.span_text(token_array, span["pos"], span["close"]))
        return whole if text_length is None else F.substring(whole, 1, text_length)

    return F.transform(
        usable,
        lambda a: F.struct(
            a["href"].alias("href"),
            text(a["span"]).alias("text"),
            split_words(_or_empty(a["rel"])).alias("rel"),
            _or_empty(a["title"]).alias("title"),
        ),
    )


def resolved_links(raw: Expr, base_url: Expr) -> Expr:
    """array<struct<href, text, rel, is_internal, anchor_hash, title>>."""
    return F.transform(
        F.transform(
            raw,
            lambda a: F.struct(
                a.alias("a"), resolve_link(base_url, a["href"]).alias("target")
            ),
        ),
        lambda r: F.struct(
            r["target"].alias("href"),
            r["a"]["text"].alias("text"),
            r["a"]["rel"].alias("rel"),
            is_internal(r["target"], url_netloc(base_url)).alias("is_internal"),
            F.when(
                r["a"]["href"].contains("#"), F.substring_index(r["a"]["href"], "#", -1)
            ).alias("anchor_hash"),
            r["a"]["title"].alias("title"),
        ),
    )


def links(token_array: Expr, base_url: Expr, text_length: int | None = None) -> Expr:
    return resolved_links(raw_links(token_array, text_length), base_url)


def raw_images(head_array: Expr) -> Expr:
    """array<struct<src, alt, width, height, title>>, addresses as written."""
    found = F.filter(
        H.pick(head_array, "img", "src", "alt", "width", "height", "title"),
        lambda i: strip(i["src"]) != "",
    )
    return F.transform(
        found,
        lambda i: F.struct(
            strip(i["src"]).alias("src"), i["alt"], i["width"], i["height"], i["title"]
        ),
    )


def resolved_images(raw: Expr, base_url: Expr) -> Expr:
    """array<struct<src, alt, width, height, title, is_data_uri>>."""
    return F.transform(
        raw,
        lambda p: F.struct(
            F.when(
                p["src"].startswith("data:") | p["src"].startswith("http"), p["src"]
            )
            .otherwise(resolve_link(base_url, p["src"]))
            .alias("src"),
            _or_empty(p["alt"]).alias("alt"),
            p["width"].alias("width"),
            p["height"].alias("height"),
            _or_empty(p["title"]).alias("title"),
            p["src"].startswith("data:").alias("is_data_uri"),
        ),
    )


def images(head_array: Expr, base_url: Expr) -> Expr:
    return resolved_images(raw_images(head_array), base_url)


def content_stats(text: Expr, link_array: Expr, image_array: Expr) -> Expr:
    internal = F.size(F.filter(link_array, lambda x: x["is_internal"]))
    return F.struct(
        word_count(text).alias("word_count"),
        F.size(link_array).alias("link_count"),
        F.size(image_array).alias("image_count"),
        internal.alias("internal_link_count"),
        (F.size(link_array) - internal).alias("external_link_count"),
    )


# ---------------------------------------------------------------------------------
# scripts and document changes


def microdata_count(token_array: Expr) -> Expr:
    return F.size(
        F.filter(
            token_array,
            lambda t: t["kind"].isin("start", "raw")
            & F.lower(t["raw"]).contains("itemscope")
            & H.attribute(H.attributes(t["raw"]), "itemscope").isNotNull(),
        )
    )


def element_ids(token_array: Expr) -> Expr:
    """Distinct ids of elements."""
    marked = F.filter(
        token_array,
        lambda t: t["kind"].isin("start", "raw") & F.lower(t["raw"]).contains("id"),
    )
    return F.array_distinct(
        F.filter(
            F.transform(marked, lambda t: H.attribute(H.attributes(t["raw"]), "id")),
            lambda i: i.isNotNull(),
        )
    )


def script_count(token_array: Expr) -> Expr:
    return F.size(H.elements(token_array, "script"))


def dom_diff(original: Expr, rendered: Expr, sample: int | None = None) -> Expr:
    """Ids gained and lost between two token arrays of one page, in order.

    ``sample`` keeps the first so many of each list; by default all are kept.

    An empty ``original`` or ``rendered`` counts as no change, as do equal sources
    (callers pass the same column then).
    """
    unchanged = (F.size(original) == 0) | (F.size(rendered) == 0)

    def only_in(a, b):
        return F.when(unchanged, F.empty("array<string>")).otherwise(
            F.array_except(a, b)
        )

    def listed(ids):
        ids = F.array_sort(ids)
        return ids if sample is None else F.slice(ids, 1, sample)

    return let(
        F.struct(
            element_ids(original).alias("before"), element_ids(rendered).alias("after")
        ),
        lambda ids: let(
            F.struct(
                only_in(ids["after"], ids["before"]).alias("added"),
                only_in(ids["before"], ids["after"]).alias("removed"),
            ),
            lambda d: F.struct(
                F.size(d["added"]).alias("added_nodes_count"),
                F.size(d["removed"]).alias("removed_nodes_count"),
                listed(d["added"]).alias("added_selectors"),
                listed(d["removed"]).alias("removed_selectors"),
                (
                    (F.size(d["added"]) > 0)
                    | (F.size(d["removed"]) > 0)
                    | (
                        ~unchanged & (script_count(rendered) > script_count(original))
                    )
                ).alias("has_significant_changes"),
            ),
        ),
    )


def js_detection(html: Expr) -> Expr:
    """struct<javascript_executed, javascript_modified_dom> from the original source."""
    lowered = F.lower(F.coalesce(html, F.lit("")))
    return let(
        F.struct(
            lowered.alias("html"), F.regexp_count(lowered, F.lit("<script")).alias("n")
        ),
        lambda p: F.struct(
            (p["html"] != "").alias("javascript_executed"),
            (
                (p["n"] > fixed.MANY_SCRIPTS)
                | (
                    (p["n"] > 0)
                    & contains_any(
                        p["html"], fixed.FRAMEWORK_MARKERS + fixed.LAZY_MARKERS
                    )
                )
            ).alias("javascript_modified_dom"),
        ),
    )
