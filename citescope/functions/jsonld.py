"""JSON-LD scripts of a page and the fields read from them.

Scripts are parsed to VARIANT.  All functions work on the array of items of one page, so
nothing is shuffled.  For scalar fields a later item overwrites an earlier one; lists
of all items are joined.  A key whose value is JSON null counts as present.
"""

from __future__ import annotations


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions.html import attribute, raw_body
from citescope.functions.text import last, parse_json, strip


def script_bodies(head_array: Expr) -> Expr:
    """Bodies of all JSON-LD scripts, in order."""
    scripts = F.filter(
        head_array,
        lambda h: (h["tag"] == "script")
        & (attribute(h["attrs"], "type") == "application/ld+json"),
    )
    return F.transform(scripts, lambda h: strip(raw_body(h["raw"])))


def parsed(bodies: Expr) -> Expr:
    """VARIANT of every script that is valid JSON."""
    return F.filter(
        F.transform(bodies, parse_json), lambda v: v.isNotNull()
    )


def text(item: Expr, path: str) -> Expr:
    return F.try_variant_get(item, path, "string")


def has(item: Expr, path: str) -> Expr:
    return F.try_variant_get(item, path, "variant").isNotNull()


def _is(item: Expr, path: str, kind: str) -> Expr:
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(item, path, "variant")).startswith(kind),
        F.lit(False),
    )


def is_object(item: Expr, path: str = "$") -> Expr:
    return _is(item, path, "OBJECT")


def objects(items: Expr) -> Expr:
    """Items whose top level is an object; arrays and their members do not count."""
    return F.filter(items, lambda v: is_object(v))


def item_type(item: Expr) -> Expr:
    return text(item, "$['@type']")


def _latest(items: Expr, present, value) -> Expr:
    """``value`` of the last item for which ``present`` holds."""
    return last(
        F.transform(F.filter(items, present), lambda v: F.struct(value(v).alias("v")))
    )["v"]


def latest_text(items: Expr, path: str) -> Expr:
    return _latest(items, lambda v: has(v, path), lambda v: text(v, path))


def latest_name(items: Expr, path: str) -> Expr:
    """Name of a nested object, else the value itself as text (author, publisher)."""
    name = f"{path}.name"
    return _latest(
        items,
        lambda v: has(v, path),
        lambda v: F.when(has(v, name), text(v, name)).otherwise(text(v, path)),
    )


def _typed(item: Expr, types) -> Expr:
    return F.coalesce(item_type(item).isin(types), F.lit(False))


def _point(source: Expr) -> Expr:
    """Coordinates of a geo object, null when it has none."""
    marked = F.coalesce(text(source, "$['@type']").contains("GeoCoordinates"), F.lit(False))
    both = has(source, "$.latitude") & has(source, "$.longitude")
    return F.when(
        is_object(source) & (marked | both),
        F.struct(
            text(source, "$.latitude").alias("latitude"),
            text(source, "$.longitude").alias("longitude"),
        ),
    )


def geo(items: Expr) -> Expr:
    source = F.transform(
        F.filter(items, lambda v: has(v, "$.geo") | _typed(v, fixed.GEO_TYPES)),
        lambda v: F.when(
            has(v, "$.geo"), F.try_variant_get(v, "$.geo", "variant")
        ).otherwise(v),
    )
    return last(F.filter(F.transform(source, _point), lambda p: p.isNotNull()))


def place(items: Expr) -> Expr:
    return last(
        F.transform(
            F.filter(items, lambda v: _typed(v, fixed.PLACE_TYPES)),
            lambda v: F.struct(
                text(v, "$.name").alias("name"),
                item_type(v).alias("type"),
                text(v, "$.address").alias("address"),
                text(v, "$.telephone").alias("telephone"),
                text(v, "$.url").alias("url"),
            ),
        )
    )


def contact(items: Expr) -> Expr:
    """Contact data; a ``contactPoint`` that is a list gives no value."""
    source = F.transform(
        F.filter(
            items,
            lambda v: has(v, "$.contactPoint")
            | F.coalesce(item_type(v) == "ContactPoint", F.lit(False)),
        ),
        lambda v: F.when(
            has(v, "$.contactPoint"), F.try_variant_get(v, "$.contactPoint", "variant")
        ).otherwise(v),
    )
    return last(
        F.transform(
            F.filter(source, lambda v: is_object(v)),
            lambda v: F.struct(
                text(v, "$.telephone").alias("telephone"),
                text(v, "$.email").alias("email"),
                text(v, "$.contactType").alias("contact_type"),
                text(v, "$.areaServed").alias("area_served"),
            ),
        )
    )


def _members(items: Expr, of_type: str, path: str) -> Expr:
    """Object members of a list-valued key over all items of a type, in order."""
    lists = F.transform(
        F.filter(items, lambda v: _typed(v, [of_type]) & _is(v, path, "ARRAY")),
        lambda v: F.try_variant_get(v, path, "array<variant>"),
    )
    return F.filter(F.flatten(lists), lambda v: is_object(v))


def breadcrumbs(items: Expr) -> Expr:
    return F.transform(
        _members(items, "BreadcrumbList", "$.itemListElement"),
        lambda v: F.struct(
            text(v, "$.name").alias("name"),
            F.when(has(v, "$.item"), text(v, "$.item"))
            .otherwise(text(v, "$.url"))
            .alias("url"),
            text(v, "$.position").alias("position"),
        ),
    )


def faq_answer(entry: Expr) -> Expr:
    """Answer text: empty for a missing or empty answer, ``text`` of an object."""
    path = "$.acceptedAnswer"
    return (
        F.when(has(entry, path + ".text"), text(entry, path + ".text"))
        .when(text(entry, path).isin("", "{}", "[]", "0", "false"), F.lit(""))
        .otherwise(F.coalesce(text(entry, path), F.lit("")))
    )


def faq(items: Expr) -> Expr:
    return F.transform(
        _members(items, "FAQPage", "$.mainEntity"),
        lambda v: F.struct(
            F.when(has(v, "$.name"), text(v, "$.name")).otherwise("").alias("question"),
            faq_answer(v).alias("answer"),
        ),
    )


def normalized(items: Expr) -> Expr:
    """All fields of a page's JSON-LD objects in one struct."""
    return F.struct(
        latest_text(items, "$.datePublished").alias("date_published"),
        latest_text(items, "$.dateModified").alias("date_modified"),
        latest_name(items, "$.author").alias("author"),
        latest_name(items, "$.publisher").alias("publisher"),
        geo(items).alias("geo"),
        breadcrumbs(items).alias("breadcrumbs"),
        faq(items).alias("faq"),
        contact(items).alias("contact"),
        place(items).alias("place"),
        latest_text(items, "$.address").alias("address"),
    )
