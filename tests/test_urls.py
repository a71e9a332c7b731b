from __future__ import annotations

from urllib.parse import urljoin

from citescope.functions import urls as U
from citescope.functions.sql import col, lit

X = col("x")


def test_normalize_domain(evaluate):
    cases = {
        "www.cnn.com": "cnn.com",
        "en.wikipedia.org": "wikipedia.org",
        "finance.yahoo.com": "yahoo.com",
        "news.google.com": "google.com",
        "www.bbc.co.uk": "bbc.co.uk",
        "news.bbc.co.uk": "bbc.co.uk",
        "x.or.jp": "or.jp",
        "Example.COM": "example.com",
        "": "",
        None: "",
        "en.example.com:8080": "example.com:8080",
        "A. B. C": " b. c",
        "localhost": "localhost",
        "co.uk": "co.uk",
    }
    assert evaluate(U.normalize_domain(X), list(cases)) == list(cases.values())


def test_root_domain_ignores_suffixes(evaluate):
    assert evaluate(U.root_domain(X), ["www.bbc.co.uk"]) == ["co.uk"]


def test_netloc(evaluate):
    cases = {
        "http://user@a.b:80/x": "user@a.b:80",
        "https://a b/x": "a b",
        "a.b/x": "",
        "http://[::1/x": "",
        "//h/x": "h",
        None: "",
    }
    assert evaluate(U.url_netloc(X), list(cases)) == list(cases.values())


def test_validity_and_scheme(evaluate):
    given = ["http://a", "https://", "a.b", None]
    assert evaluate(U.is_valid_url(X), given) == [True, False, False, False]
    assert evaluate(U.normalize_url(X), ["a.b", "http://a", "HTTP://a"]) == [
        "https://a.b", "http://a", "https://HTTP://a",
    ]
    assert evaluate(U.url_domain_bare(X), ["http://www.a.www.b/"]) == ["a.b"]


def test_resolution_follows_the_standard_library(evaluate):
    bases = [
        "http://a/b/c/d;p?q", "https://x.com", "https://x.com/a/b/?z=1#f",
        "https://x.com/a//b/c.html",
    ]
    refs = [
        "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "", ".",
        "./", "..", "../", "../g", "../..", "../../../g", "/./g", "/../g", "g.", "..g",
        "./../g", "./g/.", "g/../h", "http:g", "https://e.org/a/../b", "a//b", "/a//b",
        "mailto:x@y", "g#", "g?", "é x",
    ]
    for base in bases:
        expected = [urljoin(base, ref) for ref in refs]
        assert evaluate(U.resolve_link(lit(base), X), refs) == expected
