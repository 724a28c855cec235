"""Facts read from page markup whatever the order, quotes and case of attributes, and not from comments or scripts."""

import pytest

from feedlake.operators import discovery, pages, urls

HIDDEN = ["<!-- {} -->", "<script>var x = '{}';</script>", "<style>/* {} */</style>"]


def one(spark, run, html, **more):
    df = spark.createDataFrame([(1, "https://example.org/a/", html)], "page_id long, url string, html string")
    return run(df).collect()


@pytest.mark.parametrize("tag", [
    '<meta property="og:title" content="Shown">', "<meta content='Shown' property='og:title'/>", '<META CONTENT="Shown" PROPERTY=og:title>',
    '<meta data-x="a > b" property="og:title" content="Shown">',
])
def test_og_title(spark, tag):
    assert one(spark, pages.page_titles, f"<head>{tag}<title>Plain</title></head>")[0].title == "Shown"
    for hidden in HIDDEN:
        assert one(spark, pages.page_titles, f"<head>{hidden.format(tag)}<title>Plain</title></head>")[0].title == "Plain"


@pytest.mark.parametrize("tag", [
    '<meta http-equiv="refresh" content="3; url=/b">', "<meta content='3; URL=/b' http-equiv='Refresh'>", "<META content='0;url=/b' http-equiv=refresh>",
])
def test_meta_refresh(spark, tag):
    def edges(body):
        df = spark.createDataFrame([("https://example.org/a", "200", "text/html", None, body)], "fetch_url string, code string, content_type string, location string, body string")
        return urls.redirect_edges(df).collect()

    assert [r.target for r in edges(f"<html>{tag}</html>")] == ["https://example.org/b"]
    assert all(not edges(hidden.format(tag)) for hidden in HIDDEN)


@pytest.mark.parametrize("tag", [
    '<link rel="alternate" type="application/rss+xml" title="News" href="/feed">', "<LINK href='/feed' title='News' type='application/rss+xml' rel='alternate'>",
])
def test_advertised_feeds(spark, tag):
    assert [(r.feed_url, r.title) for r in one(spark, discovery.advertised_feeds, tag)] == [("https://example.org/feed", "News")]
    assert all(not one(spark, discovery.advertised_feeds, hidden.format(tag)) for hidden in HIDDEN)


def test_platforms(spark):
    def marks(html):
        return [k for k, v in one(spark, discovery.detect_platform, html)[0].asDict().items() if v is True]

    assert marks("<button data-n='1' class='a load-more'>x</button>") == ["has_load_more"]
    assert marks("<META content=@buttondown name='twitter:site'>") == ["is_newsletter"]
    assert marks("<link href='https://medium.com/feed' type='application/rss+xml'>" + "<article>x</article>" * 10) == ["is_article_list"]
    for hidden in HIDDEN:
        assert marks(hidden.format("<button class='load-more'>x</button>")) == []


def test_deeply_nested_page_finishes():
    from feedlake.functions.dom import _Nodes

    depth = 3000
    parser = _Nodes()
    parser.feed("<body>" + "<div>" * depth + '<a href="/x">in<b>side</b></a>' + "text</div>" * depth + '<a href="/y"></a></body>')
    links = [r for r in parser.rows if r[0] == "a"]
    assert [(r[3], r[6], r[7]) for r in links] == [("/x", "inside", False), ("/y", None, True)]
    assert links[1][1] == "/body[1]/a[1]"
