"""URL and domain functions."""

from __future__ import annotations


from citescope.functions import sql as F
from citescope.functions.sql import Expr
from citescope.functions import fixed_values as fixed
from citescope.functions.text import let

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
# scheme, authority with its slashes, path, query with its mark, fragment with its mark
_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def normalize_url(url: Expr) -> Expr:
    return F.when(
        url.startswith("http://") | url.startswith("https://"), url
    ).otherwise(F.concat(F.lit("https://"), url))


def url_netloc(url: Expr) -> Expr:
    """Authority as written, with port and user; empty when there is none."""
    netloc = F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit(""))
    return F.when(netloc.contains("[") == netloc.contains("]"), netloc).otherwise("")


def url_origin(url: Expr) -> Expr:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def is_valid_url(url: Expr) -> Expr:
    return F.coalesce(
        (F.regexp_extract(url, _SCHEME, 1) != "") & (url_netloc(url) != ""),
        F.lit(False),
    )


def url_domain_bare(url: Expr) -> Expr:
    return F.replace(url_netloc(url), F.lit("www."), F.lit(""))


def normalize_domain(domain: Expr) -> Expr:
    """Registrable domain by suffix rule; null gives an empty string.

    ``substring_index`` leaves names with fewer labels as they are, so names of one or
    two labels need no case of their own.
    """
    bare = F.regexp_replace(F.lower(domain), r"^www\.", "")
    top = F.substring_index(bare, ".", -1)
    second = F.substring_index(F.substring_index(bare, ".", -2), ".", 1)
    keep_three = top.isin(fixed.COUNTRY_CODES) & second.isin(fixed.SECOND_LEVEL_LABELS)
    return F.coalesce(
        F.when(keep_three, F.substring_index(bare, ".", -3)).otherwise(
            F.substring_index(bare, ".", -2)
        ),
        F.lit(""),
    )


def root_domain(netloc: Expr) -> Expr:
    """Last two labels, whatever the suffix."""
    return F.substring_index(netloc, ".", -2)


def is_internal(url: Expr, base_netloc: Expr) -> Expr:
    return let(url_netloc(url), lambda host: (host == base_netloc) | (host == ""))


def split_url(url: Expr) -> Expr:
    """struct<scheme, authority, path, query, fragment>, marks kept with their part."""
    parts = [
        F.regexp_extract(url, _PARTS, i).alias(name)
        for i, name in enumerate(
            ["scheme", "authority", "path", "query", "fragment"], start=1
        )
    ]
    return F.struct(*parts)


def _drop_dot_segments(segments: Expr) -> Expr:
    """Resolve ``.`` and ``..`` in a list of path segments."""
    kept = F.aggregate(
        segments,
        F.empty("array<string>"),
        lambda done, seg: F.when(seg == ".", done)
        .when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(seg))),
    )
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def _join_path(base: Expr, path: Expr) -> Expr:
    """Reference path against base path."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    merged = F.when(path.startswith("/"), path).otherwise(
        # a relative reference also loses repeated slashes
        F.regexp_replace(F.concat(F.lit("/"), folder, path), r"/{2,}", "/")
    )
    return let(
        merged,
        lambda whole: F.when(
            whole.rlike(r"/\.\.?(?:/|$)"),
            let(
                F.array_join(_drop_dot_segments(F.split(whole, "/")), "/"),
                lambda clean: F.when(clean.startswith("/"), clean).otherwise(
                    F.concat(F.lit("/"), clean)
                ),
            ),
        ).otherwise(whole),
    )


def _resolve(base: Expr, ref: Expr, href: Expr) -> Expr:
    scheme = F.lower(ref["scheme"])
    base_scheme = F.lower(base["scheme"])
    query = F.when(ref["query"] == "?", "").otherwise(ref["query"])
    fragment = F.when(ref["fragment"] == "#", "").otherwise(ref["fragment"])
    has_authority = ref["authority"] != ""
    empty_path = ref["path"] == ""
    path = F.when(has_authority, ref["path"]).otherwise(
        F.when(empty_path, base["path"]).otherwise(
            _join_path(base["path"], ref["path"])
        )
    )
    joined = F.concat(
        base_scheme,
        F.lit(":"),
        F.when(has_authority, ref["authority"]).otherwise(base["authority"]),
        path,
        F.when(~has_authority & empty_path & (query == ""), base["query"]).otherwise(
            query
        ),
        fragment,
    )
    own_scheme = (ref["scheme"] != "") & (scheme != base_scheme)
    return F.when(own_scheme, href).otherwise(joined)


def resolve_link(base_url: Expr, href: Expr) -> Expr:
    """Absolute form of ``href`` seen from ``base_url`` (RFC 3986 section 5).

    A reference of another scheme is returned as written.
    """
    return let(
        F.struct(split_url(base_url).alias("base"), split_url(href).alias("ref")),
        lambda both: F.when(href == "", base_url).otherwise(
            _resolve(both["base"], both["ref"], href)
        ),
    )
