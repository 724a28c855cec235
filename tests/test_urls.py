"""Url canonicalisation, one group of cases for each rule: (url, page, expected url, expected canonical url)."""

import pytest
from pyspark.sql import functions as F

from feedlake.functions import urls as U

PAGE = "https://shop.example.org/catalog/spring/lamps?view=grid"
# What may stand around a url: white space and control characters, as such or escaped in either case.
EDGES = ["\t", "\n", "\x0b", "\x0c", "\r", "\x00", " ", "%20", "%09", "%0a", "%0B", "%0c", "%0D", "%00"]

RULES = {
    "schemes": [
        *((f"{s}://news.example.com/today", PAGE, f"{s}://news.example.com/today", "news.example.com/today") for s in ("http", "https")),
        *((f"{s}://news.example.com/today", PAGE, None, None) for s in ("ftp", "file", "ws")),
        *((u, PAGE, None, None) for u in ("mailto:desk@example.com", "javascript:void(0)", "tel:5550100", ":8", ":", "https:", "https:news.example.com/x")),
    ],
    "relative to the page": [
        ("desk", PAGE, "https://shop.example.org/catalog/spring/desk", "shop.example.org/catalog/spring/desk"),
        ("./desk", PAGE, "https://shop.example.org/catalog/spring/desk", "shop.example.org/catalog/spring/desk"),
        ("../desk", PAGE, "https://shop.example.org/catalog/desk", "shop.example.org/catalog/desk"),
        ("../../desk", PAGE, "https://shop.example.org/desk", "shop.example.org/desk"),
        ("/desk", PAGE, "https://shop.example.org/desk", "shop.example.org/desk"),
        ("/desk?page=4", PAGE, "https://shop.example.org/desk?page=4", "shop.example.org/desk?page=4"),
        ("//shop.example.org/desk", PAGE, "https://shop.example.org/desk", "shop.example.org/desk"),
        ("/desk", "http://shop.example.org:8080/a", "http://shop.example.org:8080/desk", "shop.example.org:8080/desk"),
    ],
    "ports": [
        ("http://example.net:80/p", PAGE, "http://example.net/p", "example.net/p"),
        ("https://example.net:443/p", PAGE, "https://example.net/p", "example.net/p"),
        ("http://example.net:443/p", PAGE, "http://example.net:443/p", "example.net:443/p"),
        ("https://example.net:9000/p", PAGE, "https://example.net:9000/p", "example.net:9000/p"),
        ("https://example.net:port/p", PAGE, None, None),
    ],
    "fragments and empty paths": [
        ("https://example.net/p#top", PAGE, "https://example.net/p", "example.net/p"),
        ("https://example.net", PAGE, "https://example.net", "example.net"),
        ("https://example.net/", PAGE, "https://example.net/", "example.net"),
        ("https://example.net/?page=1", PAGE, "https://example.net/?page=1", "example.net/?page=1"),
        ("https://example.net//p///q", PAGE, "https://example.net/p//q", "example.net/p//q"),
    ],
    "queries keep what pages by": [
        *((f"https://example.net/p?{k}=3", PAGE, f"https://example.net/p?{k}=3", f"example.net/p?{k}=3")
          for k in ("page", "year", "m", "start", "offset", "skip", "sort", "order", "format", "listpage")),
        *((f"https://example.net/p?{k}=3", PAGE, f"https://example.net/p?{k}=3", "example.net/p") for k in ("ref", "q", "pag", "utm_source")),
        ("https://example.net/p?ref=a&start=2&q=b&page", PAGE, "https://example.net/p?ref=a&start=2&q=b&page", "example.net/p?start=2&page"),
        ("https://example.net/p?page=", PAGE, "https://example.net/p?page=", "example.net/p?page="),
        ("https://example.net/p?sort=a+b", PAGE, "https://example.net/p?sort=a%2Bb", "example.net/p?sort=a%2Bb"),
    ],
    "edges and line breaks": [
        *((f"{e}https://example.net/p{e}", PAGE, "https://example.net/p", "example.net/p") for e in EDGES),
        ("".join(EDGES) + "https://example.net/p" + "".join(EDGES), PAGE, "https://example.net/p", "example.net/p"),
        ("https://example.net/one\ntwo", PAGE, "https://example.net/onetwo", "example.net/onetwo"),
    ],
    "escapes": [
        ("/two words", PAGE, "https://shop.example.org/two%20words", "shop.example.org/two%20words"),
        ("/gr\u00fcn", PAGE, "https://shop.example.org/gr%C3%BCn", "shop.example.org/gr%C3%BCn"),
        ("/gr%C3%BCn", PAGE, "https://shop.example.org/gr%C3%BCn", "shop.example.org/gr%C3%BCn"),
        ("/\u00e9%C3%A9", PAGE, "https://shop.example.org/%C3%A9%C3%A9", "shop.example.org/%C3%A9%C3%A9"),
        ("/\u00e9%", PAGE, "https://shop.example.org/%C3%A9%25", "shop.example.org/%C3%A9%25"),
        ("/%25C3", PAGE, "https://shop.example.org/%25C3", "shop.example.org/%25C3"),
        # Not valid as UTF-8: the sign itself is escaped.
        ("/caf%E9 bar", PAGE, "https://shop.example.org/caf%25E9%20bar", "shop.example.org/caf%25E9%20bar"),
    ],
    "no host to speak of": [
        *((u, PAGE, None, None) for u in ("https://user@example.net/p", "https://two words.example.net", "https://example.net:${port}/p")),
    ],
}
CASES = [case for cases in RULES.values() for case in cases]


@pytest.fixture(scope="module")
def canonical(spark):
    df = spark.createDataFrame([(u, b) for u, b, *_ in CASES], "url string, base string").distinct()
    return {(r.url, r.base): (r.link_url, r.canonical) for r in U.with_canonical(df, "url", "base").collect()}


@pytest.mark.parametrize("rule", RULES)
def test_rule(canonical, rule):
    wrong = [(url, canonical[url, base]) for url, base, *want in RULES[rule] if canonical[url, base] != tuple(want)]
    assert not wrong


def test_canonicalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "url string, base string")
    once = U.with_canonical(df, "url", "base").selectExpr("link_url as u").where("u is not null")
    twice = U.with_canonical(once, "u").selectExpr("u", "link_url as v")
    # A literal %25 is unescaped, and a run of slashes halved, once per pass: only urls without them are stable.
    assert twice.where("u <> v and not u like '%\\%25%' and not u rlike '[^:]//'").count() == 0


def test_trailing_slashes_only_matter_for_comparison(spark):
    rows = [("https://a.b/",), ("https://a.b//",), ("https://a.b",), ("https://a.b/a",), ("https://a.b/a/",), ("https://a.b/a//",)]
    df = spark.createDataFrame(rows, "url string")
    keys = [r.key for r in U.with_canonical(df, "url").collect()]
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] == keys[5] and keys[0] != keys[3]


def test_same_hosts_and_post_paths(spark):
    df = spark.createDataFrame([("https://a.b/post/12/name",), ("https://www.a.b/post/12",), ("https://a.b:81/post/12",)], "url string")
    df = U.with_canonical(df, "url")
    parts = F.col("parts")
    hosts = F.array(F.lit("a.b"), F.lit("www.a.b"))
    rows = df.select(U.canonical_key(parts, hosts, F.lit(True)).alias("k"),
                     U.equality_key(parts, hosts, F.lit(True)).alias("e")).collect()
    assert rows[0].k == rows[1].k != rows[2].k
    assert rows[0].e == rows[1].e == rows[2].e


def test_stored_rules_have_the_columns_the_operators_read(spark):
    from feedlake.operators.urls import canonical_key
    from feedlake.sources.tables import schema_of

    rules = spark.createDataFrame([(1, ["a.example", "www.a.example"], True)], schema_of("blog_canonical_equality_configs"))
    links = U.with_canonical(spark.createDataFrame([(1, "https://www.a.example/post/4/x"), (2, "https://b.example/post/4/x")], "blog_id long, url string"), "url")
    keys = {r.blog_id: r.key for r in canonical_key(links, rules).collect()}
    assert keys == {1: ":same_hosts//post/4?", 2: "b.example//post/4/x?"}


def test_simple_urls_read_as_all_others(spark, monkeypatch):
    hosts = ["http://a.example.com", "https://B.example.com", "HTTP://a.b", "http://a.b:80", "http://me@a.b", "http://", "//c.d", "ftp://a.b", "http:/a", ""]
    paths = ["", "/", "/p", "/p/", "/p/q.html", "//p", "/p//q", "/p//", "/./p", "/p/../q", "/.p", "/p.", "/p/.", "/~me/x_y-z", "/a%20b", "/é", "/p?page=2", "/p?x=1", "/p#top", "/p\n", "/p ",
             "p/q", "/10", "/abc", "/http://a.b/c", "/p:q", "/a+b", "/2019/01/02/x/"]
    bases = ["http://h.example.com/a/b", "https://H.example.com", "HTTPS://h.i/", "http://h.i:8080/x", "http://u@h.i/", "http://h.i/?q", "ftp://h.i/", "h.i/x", "", "http://h.i\n", None]
    rows = [(h + p, b) for h in hosts for p in paths for b in bases] + [(None, b) for b in bases]
    df = spark.createDataFrame(rows, "url string, page string")
    plans = []
    simple_url = U.SIMPLE_URL
    for simple in (simple_url, "(?!)"):
        monkeypatch.setattr(U, "SIMPLE_URL", simple)
        plans.append((U.with_canonical(df, "url", "page", "x_"), U.with_canonical(df, "url")))
    for fast, slow in zip(*plans, strict=True):
        assert fast.columns == slow.columns
        assert fast.exceptAll(slow).collect() == [] and slow.exceptAll(fast).collect() == []
    read = df.where(F.col("url").rlike(simple_url)).select("url").distinct().count()
    assert read > 20
